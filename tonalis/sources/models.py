"""Response models on disk: one folder of JSON for each camera and profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators.planner import RESPONSE

MODEL = f"camera string, model_profile string, {RESPONSE}"


def file_key(camera: Column, profile: Column) -> Column:
    """A name for the model of a camera and a profile that is safe in a path."""
    return F.regexp_replace(F.replace(scalars.model_key(camera, profile), F.lit("|"), F.lit("__")), r"[/\\ :*?\"<>=%]", "_")


def save(models: DataFrame, folder: str) -> None:
    """Writes models (``MODEL``), each to its own part of ``folder``; other cameras' and profiles' models stay."""
    spark = models.sparkSession
    kept = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        models.withColumn("file", file_key(F.col("camera"), F.col("model_profile"))).write.mode("overwrite").partitionBy("file").json(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", kept)


def load(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The models of the wanted ``camera`` and ``model_profile``; nulls, that is priors, where there is none or it can't be read."""
    read = spark.read.schema(f"{MODEL}, _corrupt_record string, file string").option("mode", "PERMISSIVE").json(folder)
    good = read.where("_corrupt_record IS NULL AND camera IS NOT NULL").drop("_corrupt_record", "camera", "model_profile")
    asked = wanted.select("camera", "model_profile").distinct().withColumn("file", file_key(F.col("camera"), F.col("model_profile")))
    return asked.join(good.dropDuplicates(["file"]), "file", "left").drop("file")
