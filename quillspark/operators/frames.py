"""Distances between consecutive frames by pixel difference and structural similarity, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .ordering import BLOCK_ROWS, ranked

#: Window of the similarity, its two constants and the range of grey values (fixed values).
WINDOW, K1, K2, GREY = 3, 0.01, 0.03, 255.0
#: Frames whose mean grey difference at SMALL × SMALL is below NEAR count as alike, at distance ALIKE (fixed values).
SMALL, NEAR, ALIKE = 32, 5.0, 0.1


def _means(x: np.ndarray) -> np.ndarray:
    """Means over all WINDOW × WINDOW windows that lie inside; x: (n, height, width)."""
    h, w = x.shape[1] - WINDOW + 1, x.shape[2] - WINDOW + 1
    return sum(x[:, i : i + h, j : j + w] for i in range(WINDOW) for j in range(WINDOW)) / WINDOW**2


def ssim(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean structural similarity of each pair of frames, with sample covariances."""
    n = WINDOW**2
    c1, c2 = (K1 * GREY) ** 2, (K2 * GREY) ** 2
    ux, uy = _means(x), _means(y)
    vx, vy, vxy = (n / (n - 1) * (_means(a * b) - ua * ub) for a, b, ua, ub in ((x, x, ux, ux), (y, y, uy, uy), (x, y, ux, uy)))
    s = ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux**2 + uy**2 + c1) * (vx + vy + c2))
    return s.mean(axis=(1, 2))


def _weights(n: int) -> np.ndarray:
    """(SMALL, n): the share of each of n pixels in each of SMALL equal stretches."""
    edges = np.arange(SMALL + 1) * n / SMALL
    at = np.arange(n)
    part = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.clip(part, 0, None) * SMALL / n


def shrunk(x: np.ndarray) -> np.ndarray:
    """Frames at SMALL × SMALL by area; smaller ones as they are."""
    if x.shape[1] > SMALL:
        x = _weights(x.shape[1]) @ x
    return x @ _weights(x.shape[2]).T if x.shape[2] > SMALL else x


def distances(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Distance of each pair of frames (n, height, width): ALIKE, or mean pixel difference × (1 - similarity)."""
    near = np.abs(shrunk(now) - shrunk(before)).mean(axis=(1, 2)) < NEAR
    out = np.full(len(now), ALIKE)
    if (far := ~near).any():
        a, b = now[far], before[far]
        out[far] = np.abs(a - b).mean(axis=(1, 2)) * (1 - ssim(a, b))
    return out


def _compare(names: list[str], key: str, pixels: str, width: str):
    """Rows by (block, rank) → diff: each with the one before it, which a batch hands on to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (block, key, width, grey values) of the row before
        for batch in batches:
            block, keys, widths = (batch.column(c).to_pylist() for c in ("_block", key, width))
            grey = [np.asarray(v.values.to_numpy(zero_copy_only=False), "f8") if v.is_valid else None for v in batch.column(pixels)]
            rows = list(zip(block, keys, widths, grey, strict=True))
            pairs: dict[tuple[int, int], list[int]] = {}
            for i, (here, there) in enumerate(zip(rows, [last, *rows], strict=False)):
                if there and here[:3] == there[:3] and here[3] is not None and there[3] is not None and len(here[3]) == len(there[3]) and here[2] and len(here[3]) >= WINDOW * here[2] >= WINDOW**2:
                    pairs.setdefault((len(here[3]) // here[2], here[2]), []).append(i)
            diff = np.full(len(rows), np.nan)
            for (h, w), at in pairs.items():
                now = np.stack([rows[i][3][: h * w] for i in at]).reshape(-1, h, w)
                before = np.stack([(rows[i - 1] if i else last)[3][: h * w] for i in at]).reshape(-1, h, w)
                diff[at] = distances(now, before)
            last = rows[-1] if rows else last
            keep = pa.array([not g for g in batch.column("_ghost").to_pylist()])
            out = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(diff, mask=np.isnan(diff))], names=[*names, "diff"]).filter(keep)

    return run


def frame_distances(frames: DataFrame, key: str, order: str, pixels: str = "pixels", width: str = "width", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``frames`` with diff, the distance to the frame before of the same key by ``order``.  Frames are grey values row by row, ``width`` a
    row.  The first frame of a key, frames without pixels, of another size than the one before or below WINDOW × WINDOW have none.

    Frames are cut into blocks by rank, each block with the last frame of the block before it, so that one video may hold any share of them."""
    names, kind = frames.columns, StructType([*frames.schema.fields, StructField("diff", DoubleType())])
    placed = ranked(frames, F.asc(key), F.asc(order)).withColumn("_block", F.floor(F.col("_rank") / block_rows)).withColumn("_ghost", F.lit(False))
    ghosts = placed.where(F.col("_rank") % block_rows == block_rows - 1).withColumn("_block", F.col("_block") + 1).withColumn("_ghost", F.lit(True))
    both = placed.unionByName(ghosts).repartition("_block").sortWithinPartitions("_block", "_rank")
    return both.mapInArrow(_compare(names, key, pixels, width), kind)
