"""Per-tile vector quantisation: deterministic k-means, residual stages, reconstruction, 8-bit codebooks.

A tile is fitted in one Arrow group, with numpy on flat buffers: no pixel becomes a Python object. Distances are blocked matrix
products, so memory stays at a few copies of one tile.
Start: centroid i is the pixel of rank (i n) div k by (row, col). Ties go to the lowest code; an empty cluster keeps its centroid.
Tiles have equal sizes, so the one shuffle by tile has no skew. A table with a window_id has tiles for each window.

Pixels with a null vector, or one with a component that is null, NaN or infinite, have no code (-1) and a reconstruction of NaN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import vec as V
from .grid import TILE, tile_keys

#: Rows of a block of distances.
ROWS = 8192


def assign(x: np.ndarray, centres: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The nearest centroid of each row, of equally near ones the lowest.

    Blocks of |c|^2 - 2 x c in 32 bits name the candidates; where more than one lies within the error of that, exact distances decide.
    """
    code = np.zeros(len(x), np.int64)
    if len(centres) < 2:
        return code
    shift = centres.mean(axis=0)  # small numbers keep the error small
    c = centres - shift
    half = ((c * c).sum(axis=1) / 2).astype(np.float32)
    c32 = np.ascontiguousarray(c.T, np.float32)
    most = float(np.sqrt((c * c).sum(axis=1).max()))
    for lo in range(0, len(x), rows):
        part = x[lo : lo + rows]
        y = (part - shift).astype(np.float32)
        far = half - y @ c32
        every = np.arange(len(y))
        own = far.argmin(axis=1)
        best = far[every, own]
        far[every, own] = np.inf
        error = 4e-7 * np.sqrt(x.shape[1]) * most * (np.sqrt(np.einsum("ij,ij->i", y, y)) + most) + 1e-30
        tied = np.flatnonzero(far.min(axis=1) <= best + error)
        if len(tied):
            far[every, own] = best
            at, which = np.nonzero(far[tied] <= (best + error)[tied, None])
            d = np.sqrt(((part[tied[at]] - centres[which]) ** 2).sum(axis=1))
            order = np.lexsort((which, d, at))
            first = order[np.concatenate([[True], np.diff(at[order]) > 0])]
            own[tied] = which[first]
        code[lo : lo + rows] = own
    return code


def means(x: np.ndarray, code: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The mean of each code's rows; codes without rows keep their centroid."""
    order = np.argsort(code, kind="stable")
    found, starts = np.unique(code[order], return_index=True)
    out = centres.copy()
    out[found] = np.add.reduceat(x[order], starts, axis=0) / np.diff([*starts, len(x)])[:, None]
    return out


def spread(n: int, k: int) -> np.ndarray:
    """k evenly spaced ranks of n."""
    return (np.arange(k) * n) // k


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Starting centroids drawn by squared distance from those before; seeded."""
    r = np.random.default_rng(seed)
    out = [x[int(r.integers(len(x)))]]
    near = ((x - out[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = near.sum()
        pick = int(np.searchsorted(np.cumsum(near), r.random() * total)) if total > 0 else len(out) % len(x)
        out.append(x[min(pick, len(x) - 1)])
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def lloyd(x: np.ndarray, k: int, n_iter: int, cap: int | None = None, init: str = "ranks", seed: int = 42) -> np.ndarray:
    """Centroids; with `cap` fitted on that many evenly ranked rows."""
    if cap and cap < len(x):
        x = x[spread(len(x), cap)]
    k = min(k, len(x))
    centres = plus_plus(x, k, seed) if init == "k-means++" else x[spread(len(x), k)].copy()
    for _ in range(n_iter):
        centres = means(x, assign(x, centres), centres)
    return centres


def batched(x: np.ndarray, k: int, n_iter: int, batch: int = 1024, seed: int = 42) -> np.ndarray:
    """Centroids by seeded mini-batches: each moves to the running mean of the rows that it was given."""
    k, r = min(k, len(x)), np.random.default_rng(seed)
    centres, seen = x[spread(len(x), k)].copy(), np.zeros(k)
    for _ in range(n_iter * max(1, len(x) // batch)):
        part = x[r.integers(len(x), size=min(batch, len(x)))]
        code = assign(part, centres)
        count = np.bincount(code, minlength=k)
        got = count > 0
        seen += count
        share = (count[got] / seen[got])[:, None]
        centres[got] += (means(part, code, centres)[got] - centres[got]) * share
    return centres


#: Beyond so many centroids the cosine path learns by mini-batches.
MANY = 64


def quantise(x: np.ndarray, k: int, distance: str = "euclidean", n_iter: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Codebook and codes of one tile's rows by either distance; for cosine the rows, and so the codebook, are on unit scale (a zero row stays)."""
    if distance not in ("euclidean", "cosine"):
        raise ValueError(f"unknown distance {distance!r}")
    if distance == "cosine":
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(n > 0, n, 1.0)
    c = batched(x, k, n_iter, seed=seed) if min(k, len(x)) > MANY else lloyd(x, k, n_iter)
    return c, assign(x, c)


def roundtrip_uint8(c: np.ndarray) -> np.ndarray:
    """Each dimension through 0..255 between its minimum and maximum; constant ones are restored exactly."""
    return dequantise(*quantise_uint8(c))


def quantise_uint8(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and the minimum and maximum of each dimension."""
    lo, hi = c.min(axis=0), c.max(axis=0)
    span = np.where(hi > lo, hi - lo, 1.0)
    return np.where(hi > lo, np.round((c - lo) / span * 255), 0).astype(np.uint8), lo, hi


def dequantise(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.where(hi > lo, lo + q / 255 * (hi - lo), lo)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """(rows, components) of a list column; rows that are null, or shorter or longer than most, are NaN."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if not len(lengths) or lengths.max() < 1:
        return np.full((len(lengths), 1), np.nan)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    c = int(np.bincount(lengths[lengths > 0]).argmax())
    if (lengths == c).all():
        return flat.reshape(-1, c)
    out = np.full((len(lengths), c), np.nan)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    good = lengths == c
    out[good] = flat[starts[good][:, None] + np.arange(c)]
    return out


def lists(x: np.ndarray) -> pa.Array:
    n, c = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * c, pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def by_tile(px: DataFrame, kernel, fields: list[StructField], extra: tuple[str, ...] = ()) -> DataFrame:
    """Applies kernel(table) to the pixels of each tile in (row, col) order; it returns a dict of columns, to which the tile's keys are added."""
    keys = [*tile_keys(px), *extra]
    schema = StructType([px.schema[k] for k in keys] + fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("col", "ascending")])
        out = kernel(table)
        n = len(next(iter(out.values())))
        own = {k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys}
        return pa.table({**own, **out})

    return px.select(*keys, "row", "col", "vec").groupBy(*keys).applyInArrow(run, schema)


VECTOR = ArrayType(DoubleType())


def two_stages(y: np.ndarray, k1: int, k2: int | None, n_iter: int, cap: int | None, uint8: bool = False):
    """Codes, codebooks and reconstruction of finite rows; with `uint8` only the last lookup uses 8-bit codebooks."""
    c1 = lloyd(y, k1, n_iter, cap)
    a1 = assign(y, c1)
    rec = (roundtrip_uint8(c1) if uint8 else c1)[a1]
    c2 = a2 = None
    if k2:
        rest = y - c1[a1]
        c2 = lloyd(rest, k2, n_iter, cap)
        a2 = assign(rest, c2)
        rec = rec + (roundtrip_uint8(c2) if uint8 else c2)[a2]
    return c1, a1, c2, a2, rec


def vq(px: DataFrame, k1: int, k2: int | None = None, n_iter: int = 2, cap: int | None = None, uint8: bool = False, least: int = 0) -> DataFrame:
    """Codes and reconstruction of every pixel; tiles with `least` finite pixels or fewer, and pixels that are not finite, have none.

    Stage 2 works on the residuals of stage 1; with `uint8` only the last lookup uses 8-bit codebooks.
    """

    def kernel(table: pa.Table) -> dict:
        x = matrix(table.column("vec"))
        ok = np.isfinite(x).all(axis=1)
        one, two = np.full(len(x), -1), np.full(len(x), -1)
        rec = np.full_like(x, np.nan)
        if ok.sum() > least:
            _, one[ok], _, a2, rec[ok] = two_stages(x if ok.all() else x[ok], k1, k2, n_iter, cap, uint8)
            if k2:
                two[ok] = a2
        return {"row": table.column("row"), "col": table.column("col"), "vec": table.column("vec"), "code1": pa.array(one), "code2": pa.array(two), "rec": lists(rec)}

    fields = [StructField("row", LongType()), StructField("col", LongType()), StructField("vec", VECTOR), StructField("code1", LongType()), StructField("code2", LongType()), StructField("rec", VECTOR)]
    return by_tile(_long(px), kernel, fields)


def _long(px: DataFrame) -> DataFrame:
    return px.withColumns({c: F.col(c).cast("long") for c in (*TILE, "row", "col")} | {"vec": F.col("vec").cast("array<double>")})


def codebook(px: DataFrame, k: int, n_iter: int = 2, cap: int | None = None) -> DataFrame:
    """tile, code, centroid of stage 1, from the finite pixels."""

    def kernel(table: pa.Table) -> dict:
        x = matrix(table.column("vec"))
        x = x[np.isfinite(x).all(axis=1)]
        c = lloyd(x, k, n_iter, cap) if len(x) else np.zeros((0, 1))
        return {"code": pa.array(np.arange(len(c))), "centroid": lists(c)}

    return by_tile(_long(px), kernel, [StructField("code", LongType()), StructField("centroid", VECTOR)])


def cosine_vq(px: DataFrame, k: int, n_iter: int = 20, seed: int = 42, distance: str = "cosine") -> DataFrame:
    """Codes of every pixel and the vector of its centroid, by `quantise`: for cosine on unit scale."""

    def kernel(table: pa.Table) -> dict:
        x = matrix(table.column("vec"))
        ok = np.isfinite(x).all(axis=1)
        code, rec = np.full(len(x), -1), np.full_like(x, np.nan)
        if ok.any():
            c, code[ok] = quantise(x[ok], k, distance, n_iter, seed)
            rec[ok] = c[code[ok]]
        return {"row": table.column("row"), "col": table.column("col"), "vec": table.column("vec"), "code1": pa.array(code), "rec": lists(rec)}

    fields = [StructField("row", LongType()), StructField("col", LongType()), StructField("vec", VECTOR), StructField("code1", LongType()), StructField("rec", VECTOR)]
    return by_tile(_long(px), kernel, fields)


def codebook_uint8(cb: DataFrame) -> DataFrame:
    """tile, code, dim, q, lo, hi: affine 8-bit codes per tile and dimension, rounded half to even."""
    keys = tile_keys(cb)
    cells = cb.select(*keys, "code", F.posexplode("centroid").alias("dim", "x"))
    span = cells.groupBy(*keys, "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    q = F.when(F.col("hi") > F.col("lo"), F.bround((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0.0)
    return cells.join(span, [*keys, "dim"]).select(*keys, "code", F.col("dim").cast("long").alias("dim"), q.cast("long").alias("q"), "lo", "hi", "x")


def errors(done: DataFrame) -> DataFrame:
    """Adds l2 and cosine distance of each pixel to its reconstruction."""
    return done.withColumns({"l2": V.distance(F.col("vec"), F.col("rec")), "cosine": V.cosine_distance(F.col("vec"), F.col("rec"))})


def quantiles(col: str, at: tuple = (0.1, 0.5, 0.9, 0.99)) -> list[Column]:
    return [F.round(F.percentile(col, F.lit(p)), 6).alias(f"{'cos' if col == 'cosine' else col}_p{round(p * 100)}") for p in at]


def recon_metrics(done: DataFrame, by: list[str]) -> DataFrame:
    """Relative error mean and quantiles, R2 (residual not centred), pixels, for each group.

    SStot is centred by dimension: per group the components' sums travel, C numbers for each task's share of a group.
    """
    rel = V.distance(F.col("vec"), F.col("rec")) / V.or_one(V.norm(F.col("vec")))
    each = done.withColumns({"rel": rel, "ss": V.dot(V.minus(F.col("vec"), F.col("rec")), V.minus(F.col("vec"), F.col("rec")))})
    at = [F.percentile("rel", F.lit(p)).alias(f"rel_p{round(p * 100)}") for p in (0.5, 0.9, 0.99)]
    sums = each.groupBy(*by).agg(F.avg("rel").alias("rel_mean"), *at, F.sum("ss").alias("res"), F.count("*").alias("n_px"))
    tot = done.select(*by, F.posexplode("vec").alias("d", "x")).groupBy(*by, "d").agg((F.var_pop("x") * F.count("*")).alias("s")).groupBy(*by).agg(F.sum("s").alias("tot"))
    return sums.join(tot, by).select(*by, "rel_mean", "rel_p50", "rel_p90", "rel_p99", F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0).alias("r2"), "n_px")


def aggregate_metrics(per_tile: DataFrame, by: list[str], names: tuple = ("rel_mean", "rel_p50", "rel_p90", "rel_p99", "r2")) -> DataFrame:
    """Mean and sample deviation (0 for one tile) of each metric over tiles, tiles and pixels."""
    cols = [c for n in names for c in (F.avg(n).alias(f"{n}_mean"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"{n}_sd"))]
    return per_tile.groupBy(*by).agg(*cols, F.count("*").alias("n_tiles"), F.sum("n_px").alias("n_px"))

