"""Seeded choices of windows and pixels, and samplers that read windows and report what became of each.

A reader is any function from a table of windows (window_id, west, south, east, north) to pixels (window_id, row, col, vec, origin);
a window that it cannot give has no row, or one with a null vector. No window's failure ends a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import vec as V
from .grid import seeded

HALF_TILE_DEG = 0.05
Reader = Callable[[DataFrame], DataFrame]


def unit(seed: int, salt: int, *keys: str) -> Column:
    """A seeded number from 0 up to 1 for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 40)) / float(1 << 40)


def at_most(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows at most, the first in seeded order: a distributed top-n. Whole numbers are ordered by arithmetic, other keys by a hash."""
    whole = isinstance(df.schema[key].dataType, IntegralType)
    return df.orderBy(seeded(key, seed) if whole else F.xxhash64(F.lit(seed), key), key).limit(n)


def subset_in_order(df: DataFrame, n: int, key: str, seed: int, place: str) -> DataFrame:
    """n rows at most in seeded choice, given in their original order; all of them if there are no more."""
    return at_most(df, n, key, seed).orderBy(place)


def capped_mask(df: DataFrame, mask: str, n: int, key: str, seed: int) -> DataFrame:
    """`df` with at most n of its true `mask` rows left true."""
    kept = at_most(df.where(F.col(mask)).select(key), n, key, seed).withColumn("_kept", F.lit(True))
    return df.join(kept, key, "left").withColumn(mask, F.coalesce("_kept", F.lit(False))).drop("_kept")


def jittered(centres: DataFrame, region_deg: float, seed: int) -> DataFrame:
    """window_id, west, south, east, north: a region of that size about each centre (window_id, lon, lat), moved so that it stays in the centre's tile."""
    half = region_deg / 2
    reach = HALF_TILE_DEG - half
    lon, lat = (F.col(c) + (2 * unit(seed, i, "window_id") - 1) * reach for i, c in enumerate(("lon", "lat")))
    return centres.select("window_id", lon.alias("x"), lat.alias("y")).select("window_id", (F.col("x") - half).alias("west"), (F.col("y") - half).alias("south"), (F.col("x") + half).alias("east"), (F.col("y") + half).alias("north"))


def sample_points(windows: DataFrame, read: Reader, points: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Up to `points` finite pixels of each window, and window_id, path for every window asked for.

    The path is the reader's origin, `empty` where it gave nothing, `error` where it gave a row without a vector, and `nan_skipped`
    where no pixel was finite.
    """
    px = read(windows)
    good = px.where(V.finite(F.col("vec")))
    w = Window.partitionBy("window_id").orderBy(F.xxhash64(F.lit(seed), "row", "col"), "row", "col")
    chosen = good.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= points).drop("_no")
    seen = px.groupBy("window_id").agg(F.first("origin", True).alias("origin"), F.bool_or(F.col("vec").isNotNull()).alias("any"), F.bool_or(V.finite(F.col("vec"))).alias("ok"))
    path = F.when(F.col("any").isNull(), "empty").when(~F.col("any"), "error").when(~F.col("ok"), "nan_skipped").otherwise(F.col("origin"))
    return chosen, windows.select("window_id").join(seen, "window_id", "left").select("window_id", path.alias("path"))


def path_counts(paths: DataFrame) -> DataFrame:
    return paths.groupBy("path").agg(F.count("*").alias("n"))


def isotropy_points(centres: DataFrame, read: Reader, n_windows: int = 1000, points: int = 100, region_deg: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Pixels of jittered regions about n centres in seeded order (window_id, lon, lat), and how many windows took which path. No pixel at all is an error."""
    order = at_most(centres, n_windows, "window_id", seed)
    chosen, paths = sample_points(jittered(order, region_deg, seed), read, points, seed)
    if chosen.isEmpty():
        raise ValueError("no points collected")
    return chosen, path_counts(paths)


def region_windows(spark, bbox: tuple[float, float, float, float], n: int, seed: int, tries: int = 30) -> DataFrame:
    """Candidate centres (window_id, lon, lat), uniform in the box: n * tries of them, in the order in which they are tried."""
    west, south, east, north = bbox
    ids = spark.range(n * tries).withColumnRenamed("id", "window_id")
    return ids.select("window_id", (west + unit(seed, 1, "window_id") * (east - west)).alias("lon"), (south + unit(seed, 2, "window_id") * (north - south)).alias("lat"))


def accepted(candidates: DataFrame, px: DataFrame, n: int, most_missing: float = 0.5) -> DataFrame:
    """The first n candidates (by window_id) that were read and whose share of missing pixels is at most `most_missing`: window_id, nan_share."""
    share = px.groupBy("window_id").agg(F.avg(V.has_nan(F.col("vec")).cast("int")).alias("nan_share"))
    good = share.where(F.col("nan_share") <= most_missing).join(candidates.select("window_id"), "window_id", "left_semi")
    return good.orderBy("window_id").limit(n)


def on_grid(lon: str = "lon", lat: str = "lat") -> Column:
    """Whether a place is a tile centre: both coordinates end in 0.05 degrees."""
    on = lambda c: F.round(F.pmod(F.col(c), F.lit(0.1)) * 1000) == 50
    return F.coalesce(on(lon) & on(lat), F.lit(False))


def canonical(boxes: DataFrame) -> DataFrame:
    """`boxes` (name, lon, lat, ...), all on the grid of tile centres; any that is not is an error naming it."""
    bad = boxes.where(~on_grid()).limit(5).collect()
    if bad:
        raise ValueError("not on the grid of tile centres: " + ", ".join(f"{r['name']} ({r['lon']}, {r['lat']})" for r in bad))
    return boxes


def chosen_path(boxes: DataFrame, coverage: DataFrame | None) -> DataFrame:
    """`boxes` with `path`: primary where the coverage table (name) holds them, else fallback; fallback for all without a table."""
    if coverage is None:
        return boxes.withColumn("path", F.lit("fallback"))
    held = coverage.select("name").distinct().withColumn("_held", F.lit(True))
    return boxes.join(held, "name", "left").withColumn("path", F.when(F.col("_held"), "primary").otherwise("fallback")).drop("_held")


def canonical_windows(boxes: DataFrame, primary: DataFrame, fallback: DataFrame, most_missing: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Pixels of the boxes' windows (window_id = name) from the first source that has them, and name, path for every box.

    A window of the first source with too many missing pixels, or without any readable row, falls to the second; a box that neither gives
    is `unavailable`. Rows with a null vector are failed reads.
    """
    own = boxes.select(F.col("name").alias("window_id"))
    share = primary.where("row is not null").groupBy("window_id").agg(F.avg(V.has_nan(F.col("vec")).cast("int")).alias("s")).where(F.col("s") <= most_missing).select("window_id")
    first = primary.where("row is not null").join(share, "window_id", "left_semi").join(own, "window_id", "left_semi").withColumn("path", F.lit("primary"))
    second = fallback.where("row is not null").join(share, "window_id", "left_anti").join(own, "window_id", "left_semi").withColumn("path", F.lit("fallback"))
    px = first.unionByName(second)
    found = px.groupBy("window_id").agg(F.first("path").alias("path"))
    return px, own.join(found, "window_id", "left").select(F.col("window_id").alias("name"), F.coalesce("path", F.lit("unavailable")).alias("path"))
