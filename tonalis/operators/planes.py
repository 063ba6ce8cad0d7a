"""Measuring whole pictures: one row in, one row of statistics out, in one Arrow pass without a shuffle.

A picture is a row of ``photo_id``, ``height``, ``width`` and ``data`` with its
8-bit RGB levels in the order of rows (null: not readable).  What is measured is
what ``measure`` gives for pixels in rows; a task holds one picture at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import BANDS, Measure
from ..functions.color import BRADFORD, PROPHOTO_SRGB, PROPHOTO_XYZ, PROPHOTO_Y, SRGB_XYZ, WHITE
from ..session import ship_package

_D = pa.float64()
TONE = pa.struct([(n, _D) for n in ("median_l", "mean_l", "p05_l", "p95_l", "clipped_hi", "clipped_lo", "tonal_frac")])
NEUTRAL = pa.struct([*((n, _D) for n in ("a_bias", "b_bias", "chroma", "neutral_frac")), ("n_neutral", pa.int64())])
BAND = pa.struct([("band", pa.string()), *((n, _D) for n in ("frac", "median_hue", "median_chroma", "median_sat", "sat_clip_frac", "median_l"))])
RENDER = pa.struct([("tone", TONE), ("neutral", NEUTRAL), ("bands", pa.list_(BAND))])
MEASURED = pa.schema([("photo_id", pa.int64()), ("mask_sharp_frac", _D), ("sharp", RENDER), ("whole", RENDER)])
LIGHT = pa.struct([(n, _D) for n in ("mean_luma", "median_luma", "clipped_highlights", "clipped_shadows", "gr", "gb")])


def ddl(schema: pa.Schema | pa.StructType) -> str:
    """Spark's text of Arrow fields."""
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}

    def kind(t: pa.DataType) -> str:
        if pa.types.is_struct(t):
            return "struct<" + ", ".join(f"{f.name}: {kind(f.type)}" for f in t) + ">"
        return f"array<{kind(t.value_type)}>" if pa.types.is_list(t) else names[t]

    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


def lab(rgb: np.ndarray) -> np.ndarray:
    """L*, a*, b* of 8-bit sRGB (last axis)."""
    x = rgb / 255.0
    light = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    t = light @ np.array(SRGB_XYZ).T / np.array(WHITE)
    f = np.where(t > (6 / 29) ** 3, t ** (1 / 3), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def hue_saturation(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """HSV hue in degrees and saturation; red goes before green before blue where they tie."""
    r, g, b = np.moveaxis(rgb / 255.0, -1, 0)
    top = np.maximum(np.maximum(r, g), b)
    d = top - np.minimum(np.minimum(r, g), b)
    e = d + 1e-9
    sixth = np.where(top == r, ((g - b) / e) % 6.0, np.where(top == g, (b - r) / e + 2, (r - g) / e + 4))
    return np.where(d <= 1e-6, 0.0, (sixth * 60) % 360.0), np.where(top > 1e-6, d / (top + 1e-9), 0.0)


def edges(plane: np.ndarray) -> np.ndarray:
    """The absolute Laplacian, the edge repeated beyond it."""
    p = np.pad(plane, 1, "edge")
    return np.abs(4 * plane - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:])


def sharp_zone(lightness: np.ndarray, how: Measure) -> np.ndarray:
    """The upper part of the Laplacian, ties included; everything in a flat picture."""
    mag = edges(lightness)
    return (mag >= np.quantile(mag, how.sharp_quantile)) | (not mag.any())


def tone(rgb: np.ndarray, lightness: np.ndarray, zone: np.ndarray, how: Measure) -> dict:
    """Tone statistics of pixels (rows) in a zone."""
    high, low = (rgb >= how.highlight).any(axis=1), lightness <= how.shadow_l
    keep = zone & ~high & ~low
    used = lightness[keep] if keep.any() else lightness
    p = np.quantile(used, [0.5, 0.05, 0.95])
    return dict(zip(TONE.names, map(float, (p[0], used.mean(), p[1], p[2], high.mean(), low.mean(), keep.mean())), strict=True))


def neutral(seen: np.ndarray, chroma: np.ndarray, zone: np.ndarray, how: Measure) -> dict:
    """Cast of near-grey pixels in a zone."""
    keep = zone & (chroma < how.neutral_chroma) & (seen[:, 0] >= how.neutral_low) & (seen[:, 0] <= how.neutral_high)
    n = int(keep.sum())
    values = (np.median(seen[keep, 1]), np.median(seen[keep, 2]), np.median(chroma[keep])) if n else (0.0, 0.0, 0.0)
    return {"a_bias": float(values[0]), "b_bias": float(values[1]), "chroma": float(values[2]), "neutral_frac": n / len(keep), "n_neutral": n}


def bands(hue: np.ndarray, sat: np.ndarray, lightness: np.ndarray, chroma: np.ndarray, zone: np.ndarray, how: Measure) -> list[dict]:
    """Eight hue bands of coloured pixels in a zone; empty ones have their centre as hue, and zeros."""
    away = np.stack([np.abs((hue - c + 180.0) % 360.0 - 180.0) for _, c in BANDS])
    of = np.where(zone & (chroma >= how.neutral_chroma), away.argmin(axis=0), -1)
    out = []
    for i, (name, centre) in enumerate(BANDS):
        at = of == i
        if not at.any():
            out.append(dict(zip(BAND.names, (name, 0.0, centre, 0.0, 0.0, 0.0, 0.0), strict=True)))
        else:
            m = [float(np.median(x[at])) for x in (hue, chroma, sat, lightness)]
            out.append(dict(zip(BAND.names, (name, float(at.mean()), m[0], m[1], m[2], float((sat[at] >= how.saturated).mean()), m[3]), strict=True)))
    return out


def render(rgb: np.ndarray, how: Measure = Measure()) -> tuple[float, dict, dict]:
    """Share of the sharp zone, and the statistics of that zone and of the whole picture (height x width x 3)."""
    seen = lab(rgb.astype(np.float64))
    zone = sharp_zone(seen[..., 0], how).ravel()
    flat, seen = rgb.reshape(-1, 3), seen.reshape(-1, 3)
    hue, sat = hue_saturation(flat)
    chroma = np.sqrt(seen[:, 1] ** 2 + seen[:, 2] ** 2)
    scope = lambda z: {"tone": tone(flat, seen[:, 0], z, how), "neutral": neutral(seen, chroma, z, how), "bands": bands(hue, sat, seen[:, 0], chroma, z, how)}
    return float(zone.mean()), scope(zone), scope(np.ones(len(flat), bool))


def measured(pictures: DataFrame, how: Measure = Measure()) -> DataFrame:
    """``photo_id``, ``mask_sharp_frac`` and the ``sharp`` and ``whole`` statistics (tone, neutral, bands) of each picture; nulls for those that can't be read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for photo, h, w, data in zip(*(batch[c] for c in ("photo_id", "height", "width", "data")), strict=True):
                row = {"photo_id": photo.as_py(), "mask_sharp_frac": None, "sharp": None, "whole": None}
                if data.is_valid and h.as_py() and w.as_py():
                    rgb = np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), 3)
                    row["mask_sharp_frac"], row["sharp"], row["whole"] = render(rgb, how)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=MEASURED)

    ship_package(pictures.sparkSession)
    return pictures.select(F.col("photo_id").cast("long"), "height", "width", "data").mapInArrow(work, ddl(MEASURED))


def scopes(of: DataFrame) -> DataFrame:
    """Two rows for each measured picture, ``scope`` global and sharp, with its statistics as ``r``; none for unread ones."""
    both = F.array(*[F.struct(F.lit(name).alias("scope"), F.col(c).alias("r")) for name, c in (("global", "whole"), ("sharp", "sharp"))])
    return of.where("whole IS NOT NULL").select("photo_id", F.explode(both).alias("s")).select("photo_id", "s.scope", "s.r")


def banded(of: DataFrame) -> DataFrame:
    """A row for each picture, scope and band of ``scopes``, its number ``band_no`` beside its name."""
    return of.select("photo_id", "scope", F.posexplode("r.bands").alias("band_no", "b")).select("photo_id", "band_no", "b.band", "scope", *[f"b.{n}" for n in BAND.names if n != "band"])


# --- mosaics ------------------------------------------------------------------------------------------------

RAW = pa.schema([("photo_id", pa.int64()), ("asshot_rg", _D), ("asshot_bg", _D), ("mask_sharp_frac", _D), ("light", LIGHT), ("light_sharp", LIGHT), ("tone", TONE), ("bands", pa.list_(BAND))])
PIXEL = "photo_id long, pos int, lr double, lg double, lb double"
_MOSAIC = ("photo_id", "height", "width", "mosaic", "pattern", "sites", "wb", "black", "white", "cam_xyz")


def camera_matrix(cam_xyz: np.ndarray) -> np.ndarray:
    """Camera colours to linear ProPhoto, from XYZ (D65) to camera: the camera's white is every channel at 1."""
    to_camera = cam_xyz.reshape(3, 3) @ np.array(BRADFORD) @ np.array(PROPHOTO_XYZ)
    white = to_camera.sum(axis=1, keepdims=True)
    return np.linalg.inv(to_camera / np.where(white == 0, 1.0, white))


def balanced(mosaic: np.ndarray, site: np.ndarray, wb: np.ndarray, black: np.ndarray, white: float) -> np.ndarray:
    """Levels of a mosaic from 0 to 1 above black, times the white balance relative to green; a second green without one has the first's."""
    gain = np.where((np.arange(len(wb)) == 3) & (wb == 0), wb[1], wb)
    gain = gain / (gain[1] or 1.0)
    return np.maximum(mosaic - black[site], 0.0) / np.maximum(white - black[site], 1.0) * gain[site]


def demosaic(values: np.ndarray, channel: np.ndarray) -> np.ndarray:
    """Bilinear interpolation of a mosaic: ``channel`` says which of three each place has."""
    kernel = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], float)

    def blur(plane: np.ndarray) -> np.ndarray:
        p = np.pad(plane, 1)
        h, w = plane.shape
        return sum(kernel[i, j] * p[i : i + h, j : j + w] for i in range(3) for j in range(3))

    return np.stack([blur(values * (channel == c)) / (blur((channel == c).astype(float)) + 1e-8) for c in range(3)], axis=-1)


def developed_light(row: dict) -> np.ndarray:
    """Linear ProPhoto (height x width x 3, from 0 to 1) of a mosaic.

    ``pattern`` has the colour number of each of the four sites of a 2 x 2 cell, by
    rows, and ``sites`` the letter of each number.
    """
    h, w = row["height"], row["width"]
    y, x = np.mgrid[0:h, 0:w]
    site = np.asarray(row["pattern"])[(y % 2) * 2 + x % 2]
    values = balanced(np.asarray(row["mosaic"], float).reshape(h, w), site, np.asarray(row["wb"], float), np.asarray(row["black"], float), row["white"])
    channel = np.array(["RGB".index(c) for c in row["sites"]])[site]
    return np.clip(demosaic(values, channel) @ camera_matrix(np.asarray(row["cam_xyz"], float)).T, 0.0, 1.0)


def light(rgb: np.ndarray) -> dict:
    """Exposure and gray-world ratios of linear ProPhoto pixels (rows); zeros for none."""
    if not len(rgb):
        return dict.fromkeys(LIGHT.names, 0.0)
    y, mean = rgb @ np.array(PROPHOTO_Y), rgb.mean(axis=0) + 1e-9
    values = (y.mean(), np.median(y), (rgb >= 0.99).any(axis=1).mean(), (y <= 0.0008).mean(), mean[1] / mean[0], mean[1] / mean[2])
    return dict(zip(LIGHT.names, map(float, values), strict=True))


def to_srgb(rgb: np.ndarray) -> np.ndarray:
    """8-bit sRGB of linear ProPhoto, rounded half to even."""
    x = np.clip(rgb @ np.array(PROPHOTO_SRGB).T, 0.0, 1.0)
    return np.rint(np.where(x <= 0.0031308, 12.92 * x, 1.055 * x ** (1 / 2.4) - 0.055) * 255.0).clip(0, 255).astype(np.uint8)


def raw_measures(row: dict, how: Measure) -> dict:
    """Everything that is measured of one mosaic."""
    rgb = developed_light(row)
    share, sharp, _ = render(to_srgb(rgb), how)
    zone = sharp_zone(lab(to_srgb(rgb).astype(np.float64))[..., 0], how)
    green = row["wb"][1] or 1.0
    return {"asshot_rg": row["wb"][0] / green, "asshot_bg": row["wb"][2] / green, "mask_sharp_frac": share, "light": light(rgb.reshape(-1, 3)), "light_sharp": light(rgb[zone]), "tone": sharp["tone"], "bands": sharp["bands"]}


def raw_measured(mosaics: DataFrame, how: Measure = Measure()) -> DataFrame:
    """Light, tone and bands of each mosaic (``photo_id``, ``height``, ``width``, ``mosaic``, ``pattern``, ``sites``, ``wb``, ``black``, ``white``, ``cam_xyz``); nulls where ``mosaic`` is null, as for files that can't be read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"photo_id": r["photo_id"]} | (raw_measures(r, how) if r["mosaic"] is not None else {}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=RAW)

    ship_package(mosaics.sparkSession)
    return mosaics.select(*_MOSAIC).mapInArrow(work, ddl(RAW))


def raw_pixels(mosaics: DataFrame) -> DataFrame:
    """A row for each pixel of readable mosaics, in linear ProPhoto."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["mosaic"] is not None:
                    rgb = developed_light(r).reshape(-1, 3)
                    yield pa.RecordBatch.from_pydict({"photo_id": pa.array([r["photo_id"]] * len(rgb), pa.int64()), "pos": pa.array(np.arange(len(rgb)), pa.int32()), **{f"l{c}": rgb[:, i] for i, c in enumerate("rgb")}})

    ship_package(mosaics.sparkSession)
    return mosaics.select(*_MOSAIC).mapInArrow(work, PIXEL)


def sources(paths: DataFrame, mosaics: DataFrame, pictures: DataFrame) -> DataFrame:
    """RAW measures and the camera's own picture for the wanted ``path``s (``path``, ``need_raw``, ``need_embedded``).

    ``mosaics`` and ``pictures`` are what a decoder gives for a ``path``, with its
    ``photo_id``; a path that isn't there or can't be read has nulls.  Each of the
    two is looked at only where it is wanted.
    """
    raw = raw_measured(mosaics.join(paths.where("need_raw").select("path"), "path", "left_semi"))
    own = measured(pictures.join(paths.where("need_embedded").select("path"), "path", "left_semi"))
    names = mosaics.select("path", "photo_id").unionByName(pictures.select("path", "photo_id")).distinct()
    packed = raw.select("photo_id", F.struct(*[c for c in raw.columns if c != "photo_id"]).alias("raw"))
    return paths.join(names, "path", "left").join(packed, "photo_id", "left").join(own.select("photo_id", F.struct("mask_sharp_frac", "sharp", "whole").alias("embedded")), "photo_id", "left").select("path", "photo_id", "raw", "embedded")
