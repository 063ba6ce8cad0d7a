"""The blurred sharp zone of the studies, its light, and colour clusters within it; a picture at a time in numpy.

A picture is a row as in ``planes``, so a task holds one picture, not one
partition's pictures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.color import PROPHOTO_Y
from ..session import ship_package
from . import planes

_D = pa.float64()
REC709 = np.array([0.2126, 0.7152, 0.0722])
ZONE = pa.schema([("photo_id", pa.int64()), ("zone_px", pa.int64()), *((n, _D) for n in ("g_luma", "g_gr", "g_gb", "zm_luma", "zm_gr", "zm_gb"))])
CLUSTERS = pa.schema([*ZONE, *((n, _D) for n in ("n_luma", "n_gr", "n_gb", "n_chroma", "n_pct", "b_luma"))])
RAW_ZONE = pa.schema([("photo_id", pa.int64()), *((n, _D) for n in ("sz_ymean", "sz_ymedian", "sz_gr", "sz_gb"))])


def halved(rgb: np.ndarray) -> np.ndarray:
    """8-bit levels at half the size, each the rounded mean of four; an odd last row or column goes."""
    h, w = rgb.shape[0] // 2 * 2, rgb.shape[1] // 2 * 2
    four = rgb[:h, :w].astype(np.int64).reshape(h // 2, 2, w // 2, 2, 3)
    return ((four.sum(axis=(1, 3)) + 2) // 4).astype(np.uint8)


def mirrored_edges(plane: np.ndarray) -> np.ndarray:
    """The absolute Laplacian, mirrored beyond the edge without repeating it."""
    p = np.pad(plane, 1, "reflect")
    return np.abs(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * plane)


def blurred(plane: np.ndarray, sigma: float) -> np.ndarray:
    """A separable Gaussian of four deviations, mirrored beyond the edge."""
    radius = round(4 * sigma)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (1, 0):
        wide = [(0, 0), (0, 0)]
        wide[axis] = (radius, radius)
        p = np.pad(plane, wide, "reflect") if plane.shape[axis] > 1 else np.pad(plane, wide, "edge")
        n = plane.shape[axis]
        plane = sum(w * np.take(p, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return plane


def grey_levels(rgb: np.ndarray) -> np.ndarray:
    """Whole grey levels, halves to the even one; added from red to blue, as a matrix product's order, which moves halves, is not fixed."""
    r, g, b = (rgb[..., i].astype(np.float64) for i in range(3))
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b)


def zone(luma: np.ndarray, sigma: float, quantile: float) -> np.ndarray:
    """Where the blurred absolute Laplacian is in its upper part."""
    soft = blurred(mirrored_edges(luma), sigma)
    return soft >= np.quantile(soft, quantile)


def linear(rgb: np.ndarray) -> np.ndarray:
    """Linear light of 8-bit sRGB."""
    x = rgb / 255.0
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def _ratios(mean: np.ndarray) -> tuple[float | None, float | None]:
    return tuple(float(mean[1] / mean[i]) if mean[i] > 1e-7 else None for i in (0, 2))


def zone_light(rgb: np.ndarray, sigma: float, quantile: float, least: int) -> tuple[dict, np.ndarray] | None:
    """Light of the halved picture and of its sharp zone, and the zone's linear pixels; None where those are under ``least``."""
    small = halved(rgb)
    sharp = zone(grey_levels(small), sigma, quantile)
    if sharp.sum() < least:
        return None
    light = linear(small)
    points = light[sharp]
    out = {"zone_px": int(sharp.sum())}
    for name, mean in (("g", light.reshape(-1, 3).mean(axis=0)), ("zm", points.mean(axis=0))):
        out |= {f"{name}_luma": float(mean @ REC709)} | dict(zip((f"{name}_gr", f"{name}_gb"), _ratios(mean), strict=True))
    return out, points


def k_means(points: np.ndarray, k: int, restarts: int = 5, steps: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of the best of several runs from spread-out starts."""
    rng = np.random.default_rng(seed)
    best = (np.inf, points[:1], np.zeros(len(points), int))
    for _ in range(restarts):
        centres = points[rng.integers(len(points))][None]
        while len(centres) < k:
            d = ((points[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, points[rng.choice(len(points), p=d / d.sum()) if d.sum() else rng.integers(len(points))]])
        for _ in range(steps):
            label = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([points[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        cost = ((points - centres[label]) ** 2).sum()
        if cost < best[0]:
            best = (cost, centres, label)
    return best[1], best[2]


def clustered(points: np.ndarray, k: int) -> dict | None:
    """The most neutral cluster, that with the least spread of its channels, and the light of the brightest; None where the neutral one has no red or blue."""
    centres, label = k_means(points, k)
    spread, light = np.ptp(centres, axis=1), centres @ REC709
    i = int(spread.argmin())
    gr, gb = _ratios(centres[i])
    if gr is None or gb is None:
        return None
    bright = int(light.argmax())
    shown = float(light[bright]) if None not in _ratios(centres[bright]) else None
    return {"n_luma": float(light[i]), "n_gr": gr, "n_gb": gb, "n_chroma": float(spread[i]), "n_pct": float((label == i).mean()), "b_luma": shown}


def _each(pictures: DataFrame, columns: tuple[str, ...], schema: pa.Schema, one: Callable[[dict], dict | None]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r["photo_id"], one(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{"photo_id": n} | f for n, f in found if f is not None], schema=schema)

    ship_package(pictures.sparkSession)
    return pictures.select("photo_id", *columns).mapInArrow(work, planes.ddl(schema))


def _rgb(row: dict) -> np.ndarray | None:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3) if row["data"] else None


def zones(pictures: DataFrame, sigma: float = 8.0, quantile: float = 0.85, least: int = 200) -> DataFrame:
    """Light of each picture and of its sharp zone; none for unreadable pictures and zones of under ``least`` pixels."""
    found = lambda r: None if (rgb := _rgb(r)) is None or (f := zone_light(rgb, sigma, quantile, least)) is None else f[0]
    return _each(pictures, ("height", "width", "data"), ZONE, found)


def clusters(pictures: DataFrame, k: int = 3, sigma: float = 8.0, quantile: float = 0.85, least: int = 200) -> DataFrame:
    """``zones`` with the neutral and the bright one of ``k`` colour clusters of the zone's linear pixels."""

    def one(row: dict) -> dict | None:
        rgb = _rgb(row)
        found = None if rgb is None else zone_light(rgb, sigma, quantile, max(least, k))
        of = clustered(found[1], k) if found else None
        return found[0] | of if of else None

    return _each(pictures, ("height", "width", "data"), CLUSTERS, one)


def raw_zones(mosaics: DataFrame, sigma: float = 8.0, quantile: float = 0.85, least: int = 200) -> DataFrame:
    """Light of the sharp zone of developed mosaics: mean and median luminance, and ratios of mean green to red and blue; the zone is found in the encoded luminance."""

    def one(row: dict) -> dict | None:
        if row["mosaic"] is None:
            return None
        rgb = planes.developed_light(row)
        y = rgb @ np.array(PROPHOTO_Y)
        sharp = zone(np.clip(y, 0, 1) ** (1 / 2.2), sigma, quantile)
        if sharp.sum() < least:
            return None
        gr, gb = _ratios(rgb[sharp].mean(axis=0))
        return {"sz_ymean": float(y[sharp].mean()), "sz_ymedian": float(np.median(y[sharp])), "sz_gr": gr, "sz_gb": gb}

    return _each(mosaics, planes._MOSAIC[1:], RAW_ZONE, one)


def sampled(pictures: DataFrame, n: int, key: str = "photo_id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for one seed, in the order of their key."""
    from pyspark.sql import functions as F

    return pictures.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).orderBy(key)
