"""Raster windows as pixel tables: NPY files on any file system Spark reads, with a fallback source, and the choice of windows."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators.grid import seeded

PIXELS = "window_id string, row long, col long, vec array<double>"
METRES_PER_DEGREE, PIXEL_METRES = 111_320.0, 10.0


def read_windows(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """Pixels of every .npy window (h, w, c) under `path`; a file that can't be read gives one row with a null vector, never a failed job.

    Files are read by Spark, so that any store works; a task holds one window at a time and emits it in slices.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                window = name.as_py().rsplit("/", 1)[-1].removesuffix(".npy")
                try:
                    a = np.load(io.BytesIO(data.as_py()), allow_pickle=False)
                    h, w, c = a.shape
                except Exception:  # noqa: BLE001 - whatever a file holds, it may not end the job
                    yield pa.RecordBatch.from_arrays([pa.array([window]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.float64()))], ["window_id", "row", "col", "vec"])
                    continue
                flat = a.reshape(-1, c)
                for at in range(0, len(flat), rows):
                    part = flat[at : at + rows].astype(np.float64)
                    no = np.arange(at, at + len(part))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * c, pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([window] * len(part)), pa.array(no // w), pa.array(no % w), lists], ["window_id", "row", "col", "vec"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, PIXELS)


def prefer(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Windows of the first source, and those of the second that the first can't give; `origin` tells which."""
    good = primary.where("vec is not null")
    rest = fallback.where("vec is not null").join(good.select("window_id").distinct(), "window_id", "left_anti")
    return good.withColumn("origin", F.lit("primary")).unionByName(rest.withColumn("origin", F.lit("fallback")))


def covered(px: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """Windows whose share of pixels with a NaN is at most `most_missing`."""
    ok = px.groupBy("window_id").agg(F.avg(V.has_nan(F.col("vec")).cast("int")).alias("s")).where(F.col("s") <= most_missing).select("window_id")
    return px.join(ok, "window_id", "left_semi")


def centres(tiles: DataFrame, year: int, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """lon, lat of the year's tiles, inside an inclusive box; none at all is an error."""
    out = tiles.where(F.col("year") == year).select("lon", "lat")
    out = out.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])) if bbox else out
    if out.isEmpty():
        raise ValueError(f"no tiles of {year}" + (f" in {bbox}" if bbox else ""))
    return out


def sample_locations(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of the pool in seeded order; a smaller pool is drawn from with replacement."""
    order = pool.orderBy(seeded(key, seed), key).limit(n)
    have = order.count()
    if have >= n or have == 0:
        return order
    draws = pool.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(have)).alias("_no"))
    numbered = order.withColumn("_no", F.row_number().over(Window.orderBy(seeded(key, seed), key)) - 1)
    return draws.join(F.broadcast(numbered), "_no").drop("_no")


def window_bounds(lon: Column, lat: Column, window_px: int) -> Column:
    half = window_px * PIXEL_METRES / 2
    dlat = half / METRES_PER_DEGREE
    dlon = dlat / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    return F.struct((lon - dlon).alias("west"), (lat - dlat).alias("south"), (lon + dlon).alias("east"), (lat + dlat).alias("north"))


def bbox_size_km(bbox: tuple[float, float, float, float]) -> tuple[float, float]:
    west, south, east, north = bbox
    return abs(east - west) * 111.32 * math.cos(math.radians((south + north) / 2)), abs(north - south) * 111.32
