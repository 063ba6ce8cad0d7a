"""Catalogues: derived paths, tolerant CSV reading, look-ups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars


def bundle(catalog: Column) -> list[Column]:
    """Preview database folder and smart-preview folder of a catalogue file."""
    stem = F.regexp_replace(catalog, r"\.lrcat$", "")
    return [F.concat(stem, F.lit(" Previews.lrdata")), F.concat(stem, F.lit(" Smart Previews.lrdata"))]


def csv_rows(spark: SparkSession, path: str, numbers: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, all rows whose ``numbers`` can be read, and the columns ``keep`` as they are."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*keep, *[F.col(c).try_cast("double").alias(c) for c in numbers]).dropna(subset=numbers)


def csv_features(spark: SparkSession, path: str, numbers: list[str], key: str = "photo") -> DataFrame:
    """A CSV with a header; of the rows of a ``key`` the last in the file counts."""
    raw = spark.read.csv(path, header=True).select(key, *[F.col(c).try_cast("double").alias(c) for c in numbers], F.monotonically_increasing_id().alias("_at"))
    last = raw.groupBy(key).agg(F.max_by(F.struct(*numbers), "_at").alias("_"))
    return last.select(key, *[f"_.{c}" for c in numbers])


def catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue files below a folder, in order of their paths."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.lrcat").load(folder).select("path").orderBy("path")


def base_names(files: DataFrame) -> DataFrame:
    """The distinct names of a catalogue's files (``baseName``)."""
    return files.select(F.col("baseName").alias("photo")).distinct()


def image_paths(images: DataFrame, files: DataFrame, folders: DataFrame, roots: DataFrame) -> DataFrame:
    """``id_global`` and ``path`` of each picture: root, folder, name and ending."""
    j = images.join(files, F.col("rootFile") == files["id_local"]).join(folders, F.col("folder") == folders["id_local"]).join(roots, F.col("rootFolder") == roots["id_local"])
    return j.select("id_global", F.concat("absolutePath", "pathFromRoot", "baseName", F.lit("."), "extension").alias("path"))


def local_ids(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """Wanted ``id_global`` with their ``id_local``, null where unknown."""
    return wanted.join(images.select("id_global", "id_local"), "id_global", "left")


def develop_settings(files: DataFrame, images: DataFrame, develop: DataFrame) -> DataFrame:
    """``photo`` (a file's name) with exposure, temperature, tint and white-balance mode of its last settings text; unset ones are null."""
    j = files.join(images, F.col("rootFile") == files["id_local"]).join(develop, develop["image"] == images["id_local"])
    rows = j.select(F.col("baseName").alias("photo"), develop["id_local"].alias("at"), scalars.develop_map(F.coalesce("text", F.lit(""))).alias("m"))
    number = lambda k: F.element_at("m", k).try_cast("double")
    each = rows.select("photo", "at", F.struct(number("Exposure2012").alias("exposure"), number("Temperature").alias("temperature"), number("Tint").alias("tint"), F.element_at("m", "WhiteBalance").alias("mode")).alias("s"))
    return each.groupBy("photo").agg(F.max_by("s", "at").alias("s")).select("photo", "s.*")


def capture_profiles(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """Every wanted ``src`` with the ``profile`` that a metadata reader listed for it (``path``, ``profile``); null where it has none.

    Paths match but for slashes and case, else by name, as such readers rewrite them.
    """
    of = listed.select("path", F.nullif(F.trim("profile"), F.lit("")).alias("profile"))
    return match_paths(wanted, of).join(of, "path", "left").select("src", "profile")


def match_paths(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """``src`` with the ``path`` that equals it but for slashes and case, else the first of the same file name."""
    plain = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    name = lambda c: F.element_at(F.split(plain(c), "/"), -1)
    exact = paths.groupBy(plain(F.col("path")).alias("k")).agg(F.min("path").alias("exact"))
    named = paths.groupBy(name(F.col("path")).alias("n")).agg(F.min("path").alias("named"))
    keyed = wanted.withColumn("k", plain(F.col("src"))).withColumn("n", name(F.col("src")))
    return keyed.join(exact, "k", "left").join(named, "n", "left").select("src", F.coalesce("exact", "named").alias("path"))


def first_catalog(photos: DataFrame, names: DataFrame) -> DataFrame:
    """``photo`` with the first ``catalog``, in order, that lists its name; ``?`` if none does."""
    first = names.groupBy("photo").agg(F.min("catalog").alias("catalog"))
    return photos.join(first, "photo", "left").select("photo", F.coalesce("catalog", F.lit("?")).alias("catalog"))


def resolve(wanted: DataFrame, selection: DataFrame, catalog: DataFrame) -> DataFrame:
    """Where each wanted ``photo_id`` was found: in the selection, in the catalogue, or nowhere."""
    s, c = selection.select("photo_id").distinct().withColumn("in_s", F.lit(1)), catalog.select("photo_id").distinct().withColumn("in_c", F.lit(1))
    where = F.when(F.col("in_s").isNotNull(), "selection").when(F.col("in_c").isNotNull(), "catalog").otherwise("missing")
    return wanted.join(s, "photo_id", "left").join(c, "photo_id", "left").select("photo_id", where.alias("found"))
