"""Picture files: the JPEG stream within a container, previews by size, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package


def jpeg_stream(content: Column) -> Column:
    """The bytes from the first JPEG start marker on; null if there is none."""
    at = F.call_function("locate", F.lit(bytearray(b"\xff\xd8\xff")), content)
    return F.when(at > 0, F.call_function("substring", content, at))


def preview_folder(uuid: Column) -> Column:
    """Where a photo's previews lie."""
    return F.concat_ws("/", F.substring(uuid, 1, 1), F.substring(uuid, 1, 4))


def largest_preview(files: DataFrame) -> DataFrame:
    """The file of each ``uuid`` with the largest number behind the last underscore of its ``name``; else the one without."""
    size = F.coalesce(F.regexp_extract("name", r"_(\d+)$", 1).try_cast("long"), F.lit(-1))
    return files.groupBy("uuid").agg(F.max(F.struct(size.alias("size"), "name")).alias("_")).select("uuid", F.col("_.name").alias("name"), F.col("_.size").alias("size"))


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Pictures that the JVM can read (``path``, ``height``, ``width``, ``data`` as RGB by rows); a file that can't be read is a row of nulls."""
    found = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return as_rgb(found.select(F.col("origin").alias("path"), "height", "width", "nChannels", "data"))


def as_rgb(images: DataFrame) -> DataFrame:
    """Decoded pictures of one, three (BGR) or four (BGRA) channels as RGB; nulls for those without pixels."""
    schema = "path string, height int, width int, data binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            out = []
            for path, h, w, n, data in zip(*(batch[c].to_pylist() for c in ("path", "height", "width", "nChannels", "data")), strict=True):
                ok = data and n in (1, 3, 4) and h and w and len(data) == h * w * n
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n) if ok else None
                rgb = None if raw is None else np.repeat(raw, 3, axis=2) if n == 1 else raw[..., 2::-1]
                out.append({"path": path, "height": h if ok else None, "width": w if ok else None, "data": rgb.tobytes() if ok else None})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    ship_package(images.sparkSession)
    return images.mapInArrow(work, schema)


def wanted_pictures(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """Every wanted ``path`` with its picture, nulls where there is none or it can't be read."""
    return wanted.join(pictures(spark, path), "path", "left")


def first_readable(*candidates: tuple[str, DataFrame]) -> DataFrame:
    """For each ``photo_id`` the first of several named sources (``photo_id``, ``height``, ``width``, ``data``) whose picture can be read, as ``channel``; ``none`` if no source can.

    A source that names a picture that can't be read is passed over.
    """
    parts = [df.select("photo_id", F.struct(F.lit(i).alias("order"), F.lit(name).alias("channel"), "height", "width", "data").alias("s"), F.col("data").isNotNull().alias("ok")) for i, (name, df) in enumerate(candidates)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    best = both.groupBy("photo_id").agg(F.min_by("s", F.when(F.col("ok"), F.col("s.order"))).alias("s"))
    return best.select("photo_id", F.coalesce("s.channel", F.lit("none")).alias("channel"), "s.height", "s.width", "s.data")


def channel_report(found: DataFrame) -> str:
    """Why no picture could be measured, by what was found for each photo (``channel``)."""
    n = {r["channel"]: r["count"] for r in found.groupBy("channel").count().collect()}
    return f"no render of {sum(n.values())} photos: " + ", ".join(f"{k} {v}" for k, v in sorted(n.items()))
