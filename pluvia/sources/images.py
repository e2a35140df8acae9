"""Radar and satellite tiles as pictures: decoding by Spark's image source, palette reads, stitching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators.kernels import NO_ECHO

SIDE = 256
#: Most opaque pixels off the palette in a radar tile.
MOST_STRANGE = 0.2
_NAME = re.compile(r"([^/]+)/(\d+)_(\d+)_(\d+)\.\w+$")
TILE = "frame string, z int, x int, y int, w int, h int, dbz binary, covered binary, fault string"


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, channels, data) of the pictures under a path; bytes are B, G, R(, A)."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def radar_tiles(found: DataFrame, palette: list[tuple[float, int, int, int, int]]) -> DataFrame:
    """(frame, z, x, y, w, h, dbz, covered, fault) of pictures named <frame>/<z>_<x>_<y>. dbz: 32-bit floats by
    the palette (dbz, r, g, b, a), a bounded list; clear pixels have no echo. covered: a byte a pixel,
    1 where it is clear, for coverage tiles. fault: not radar, if too many opaque pixels are off the
    palette, and then there is no dbz."""
    levels = np.array([p[0] for p in palette], np.float32)
    colours = np.array([p[1:] for p in palette], np.int32)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                m, a = _NAME.search(row.origin), _pixels(row)
                if m is None or row.channels < 3:
                    continue
                alpha = a[..., 3] if row.channels == 4 else np.full(a.shape[:2], 255, np.uint8)
                rgba = np.dstack([a[..., 2], a[..., 1], a[..., 0], alpha]).reshape(-1, 4)
                kinds, which = np.unique(rgba, axis=0, return_inverse=True)
                apart = ((kinds[:, None].astype(np.int32) - colours[None]) ** 2).sum(2)
                dbz = np.where(kinds[:, 3] == 0, NO_ECHO, levels[apart.argmin(1)]).astype("<f4")
                opaque = np.bincount(which.ravel(), minlength=len(kinds)) * (kinds[:, 3] > 0)
                strange = opaque[apart.min(1) > 0].sum() > MOST_STRANGE * max(1, opaque.sum())
                out.append((m[1], int(m[2]), int(m[3]), int(m[4]), row.width, row.height, None if strange else dbz[which.ravel()].tobytes(), (alpha.ravel() == 0).astype(np.uint8).tobytes(), "not radar" if strange else None))
            yield pd.DataFrame(out, columns=["frame", "z", "x", "y", "w", "h", "dbz", "covered", "fault"])

    return found.mapInPandas(read, TILE)


def grey_tiles(found: DataFrame) -> DataFrame:
    """(origin, width, height, grey): the mean of the colours, a byte a pixel."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.origin, r.width, r.height, np.round(_pixels(r)[..., : min(3, r.channels)].mean(2)).astype(np.uint8).tobytes()) for r in f.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["origin", "width", "height", "grey"])

    return found.mapInPandas(read, "origin string, width int, height int, grey binary")


def mosaics(tiles: DataFrame, centres: DataFrame, every: bool = True) -> DataFrame:
    """(region, frame, w, h, dbz, covered) of the 3x3 tiles around each centre (region, x, y); a missing tile
    has no echo and no cover, and with `every` its mosaic is left out. A tile of another size is an
    error. A group holds the nine tiles of one region and frame."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(3) for i in range(3)])).alias("o")
    wanted = centres.select("region", (F.col("x") - 1).alias("x0"), (F.col("y") - 1).alias("y0"), steps).select("region", "x0", "y0", (F.col("x0") + F.col("o.i")).alias("x"), (F.col("y0") + F.col("o.j")).alias("y"))
    met = tiles.join(wanted, ["x", "y"])

    def stitched(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["x", "y"])
        if every and (len(f) < 9 or f["dbz"].isna().any()):
            return pd.DataFrame([], columns=["region", "frame", "w", "h", "dbz", "covered"], dtype=object)
        dbz, cover = np.full((3 * SIDE, 3 * SIDE), NO_ECHO, "<f4"), np.zeros((3 * SIDE, 3 * SIDE), np.uint8)
        for r in f.itertuples(index=False):
            if (r.w, r.h) != (SIDE, SIDE):
                raise ValueError(f"tile {r.x}, {r.y} is {r.w} x {r.h}")
            at = np.s_[(r.y - r.y0) * SIDE : (r.y - r.y0 + 1) * SIDE, (r.x - r.x0) * SIDE : (r.x - r.x0 + 1) * SIDE]
            if r.dbz is not None:
                dbz[at] = np.frombuffer(r.dbz, "<f4").reshape(SIDE, SIDE)
            cover[at] = np.frombuffer(r.covered, np.uint8).reshape(SIDE, SIDE)
        return pd.DataFrame({"region": [f["region"].iloc[0]], "frame": [f["frame"].iloc[0]], "w": [3 * SIDE], "h": [3 * SIDE], "dbz": [dbz.tobytes()], "covered": [cover.tobytes()]})

    return met.groupBy("region", "frame").applyInPandas(stitched, "region string, frame string, w int, h int, dbz binary, covered binary")
