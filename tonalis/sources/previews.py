"""A catalogue's preview cache: from a photo to its rendered preview and its smart preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import images


def keys(wanted: DataFrame, photos: DataFrame, entries: DataFrame) -> DataFrame:
    """Wanted ``id_global`` with the cache's ``uuid`` and ``digest``, by way of ``id_local``; nulls where a step is missing.

    ``photos`` have ``id_global``, ``id_local``; ``entries`` have ``imageId``, ``uuid``, ``digest``.
    """
    local = wanted.join(photos.select("id_global", "id_local"), "id_global", "left")
    return local.join(entries.select(F.col("imageId").alias("id_local"), "uuid", "digest"), "id_local", "left").select("id_global", "uuid", "digest")


def rendered(keyed: DataFrame, files: DataFrame) -> DataFrame:
    """``id_global`` and the ``path`` of its largest rendered preview, else of its packed one (``.lrfprev``); null where there is neither.

    ``files`` lists the cache (``folder``, ``name``); a photo's lie in the folder of
    its ``uuid`` and begin with that.
    """
    mine = keyed.where("uuid IS NOT NULL").select("id_global", "uuid", images.preview_folder(F.col("uuid")).alias("folder"))
    there = mine.join(files, "folder").where(F.col("name").startswith(F.col("uuid")))
    packed = F.col("name").endswith(".lrfprev")
    size = F.regexp_extract("name", r"_(\d+)$", 1).try_cast("long")
    best = there.where(packed | size.isNotNull()).groupBy("id_global").agg(F.max_by(F.concat_ws("/", "folder", "name"), F.struct((~packed).alias("sized"), F.coalesce(size, F.lit(-1)).alias("size"), "name")).alias("path"))
    return keyed.select("id_global").join(best, "id_global", "left")


def smart(keyed: DataFrame, files: DataFrame) -> DataFrame:
    """``id_global`` and the ``path`` of its smart preview (``uuid.dng`` in the folder of its uuid), null where the file isn't there."""
    place = F.concat_ws("/", images.preview_folder(F.col("uuid")), F.concat("uuid", F.lit(".dng")))
    there = files.select(F.concat_ws("/", "folder", "name").alias("path")).distinct()
    named = keyed.where("uuid IS NOT NULL").select("id_global", place.alias("path")).join(there, "path", "left_semi")
    return keyed.select("id_global").join(named, "id_global", "left").select("id_global", "path")


def render_paths(wanted: DataFrame, thumbnails: DataFrame, previews: DataFrame) -> DataFrame:
    """``photo_id`` with the picture to measure and its ``channel``: the thumbnail that is there, else the preview, else none.

    ``thumbnails`` and ``previews`` have ``photo_id`` and ``path``.
    """
    t, p = thumbnails.select("photo_id", F.col("path").alias("t")), previews.select("photo_id", F.col("path").alias("p"))
    channel = F.when(F.col("t").isNotNull(), "thumbnail").when(F.col("p").isNotNull(), "preview").otherwise("none")
    return wanted.select("photo_id").join(t, "photo_id", "left").join(p, "photo_id", "left").select("photo_id", F.coalesce("t", "p").alias("path"), channel.alias("channel"))


def with_raw_and_smart(paths: DataFrame, raws: DataFrame, smart_paths: DataFrame, most: int | None = None) -> DataFrame:
    """``photo``, ``id_global`` and RAW ``path`` of the pictures whose RAW is among ``raws`` (``path``) and that have a smart preview, in order of the name; the first ``most`` of them."""
    both = paths.join(raws.select("path"), "path", "left_semi").join(smart_paths.where("path IS NOT NULL").select("id_global"), "id_global", "left_semi")
    named = both.select(F.regexp_extract("path", r"([^/\\]+)\.[^.]*$", 1).alias("photo"), "id_global", "path").orderBy("photo", "id_global")
    return named.limit(most) if most else named
