"""Histograms, tails, normality, transport, Gram matrices and spectra.

Null and NaN values are left out of quantiles, tails and histograms; empty inputs give the rows that each function names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import vec as V
from .quantize import matrix

#: Rows up to which quantiles are taken at once; beyond that their places are narrowed down first.
AT_ONCE = 200_000
NARROW = 4096
_LONG = LongType()
#: The largest sample that the double sum of a normality test takes.
PAIRS = 20_000


def order_statistics(df: DataFrame, value: str, ranks: list[int], at_once: int = AT_ONCE) -> list[float]:
    """The values of those ranks (from 0), exactly: each rank's bracket is cut into NARROW parts by counts until it holds at most `at_once` rows or one value.

    One pass over the data serves all ranks of a level; what is gathered at the end is bounded.
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, lo, hi = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    brackets = {r: (lo, hi, 0, n) for r in ranks}
    while True:
        wide = {b for b in brackets.values() if b[3] > at_once and b[0] < b[1]}
        if not wide:
            break
        cases = F.array(*[F.when((F.col("x") >= a) & (F.col("x") <= b), F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col("x") - a) / (b - a) * NARROW), F.lit(NARROW - 1)).alias("part"))) for i, (a, b, _, _) in enumerate(sorted(wide))])
        counts = x.select("x", F.explode(cases).alias("c")).where("c is not null").groupBy("c.i", "c.part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for i, b in enumerate(sorted(wide)):
            parts, below = sorted((r["lo"], r["hi"], r["n"]) for r in counts if r["i"] == i), b[2]
            for a, z, m in parts:
                for r in [r for r, own in brackets.items() if own == b and below <= r < below + m]:
                    brackets[r] = (a, z, below, m)
                below += m
    out = []
    plain = {r: b for r, b in brackets.items() if b[0] is not None and b[0] < b[1]}
    if plain:
        cols = [F.expr(f"percentile(if(x >= {b[0]!r}D and x <= {b[1]!r}D, x, null), {(r - b[2]) / max(b[3] - 1, 1)!r}D)") for r, b in plain.items()]
        plain = dict(zip(plain, x.agg(*cols).first(), strict=True))
    for r in ranks:
        out.append(plain[r] if r in plain else brackets[r][0])
    return out


def quantile_row(df: DataFrame, value: str, at: list[float], at_once: int = AT_ONCE) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, of a whole table, exactly and in bounded memory; None for no rows."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = x.count()
    if not n:
        return [None] * len(at)
    if n <= at_once:
        return list(x.agg(F.percentile("x", F.array(*map(F.lit, at)))).first()[0])
    places = [(n - 1) * p for p in at]
    ranks = sorted({r for h in places for r in (math.floor(h), min(math.floor(h) + 1, n - 1))})
    found = dict(zip(ranks, order_statistics(df, value, ranks, at_once), strict=True))
    return [found[math.floor(h)] + (h - math.floor(h)) * (found[min(math.floor(h) + 1, n - 1)] - found[math.floor(h)]) for h in places]


def bin_edge(df: DataFrame, value: str, p: float = 0.99) -> DataFrame:
    """One row `hi`: the upper edge of histograms from 0, the quantile p of a first sample; 1 if that is not positive, 30 without any value."""
    hi = quantile_row(df, value, [p])[0]
    return df.sparkSession.createDataFrame([(30.0 if hi is None else hi if hi > 0 else 1.0,)], "hi double")


def histogram(df: DataFrame, value: str, by: list[str], edges: DataFrame, n_bins: int) -> DataFrame:
    """by, bin_index, bin_low, bin_high, density, overflow over every bin of [0, hi], with `hi` from the one-row table `edges`.

    The last bin is closed; overflow is the share outside. A `hi` of zero or below, or none, counts as 1.
    """
    edges = edges.select(F.when(F.col("hi") > 0, F.col("hi").cast("double")).otherwise(1.0).alias("hi"))
    x, hi = F.col(value), F.col("hi")
    at = F.least(F.floor(x / hi * n_bins), F.lit(n_bins - 1))
    # The quotient may round over an edge; the edges decide.
    at = F.when(x < at * hi / n_bins, at - 1).when((x >= (at + 1) * hi / n_bins) & (at < n_bins - 1), at + 1).otherwise(at)
    rows = df.where(x.isNotNull() & ~F.isnan(x)).crossJoin(F.broadcast(edges)).select(*by, F.when((x >= 0) & (x <= hi), at).alias("bin_index"))
    counts = rows.groupBy(*by, "bin_index").agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("n_total"), (F.sum(F.when(F.col("bin_index").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("overflow"))
    bins = total.crossJoin(df.sparkSession.range(n_bins).select(F.col("id").alias("bin_index"))).crossJoin(F.broadcast(edges))
    ends = [(hi * F.col("bin_index") / n_bins).alias("bin_low"), (hi * (F.col("bin_index") + 1) / n_bins).alias("bin_high")]
    return bins.join(counts, [*by, "bin_index"], "left").select(*by, "bin_index", *ends, (F.coalesce("n", F.lit(0)) / F.col("n_total")).alias("density"), "overflow")


def across(hist: DataFrame, by: list[str]) -> DataFrame:
    """One row for each cell and bin over all boxes: mean and sample deviation (0 for one box) of density and overflow, and the boxes."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return hist.groupBy(*by, "bin_index").agg(
        F.first("bin_low").alias("bin_low"), F.first("bin_high").alias("bin_high"), F.avg("density").alias("mean_density"), sd("density").alias("sd_density"),
        F.avg("overflow").alias("overflow_frac_mean"), sd("overflow").alias("overflow_frac_sd"), F.count("*").alias("n_bboxes"),
    )


def wide(long: DataFrame, by: list[str], n_bins: int) -> DataFrame:
    """One row for each cell: bin_NN_mean and bin_NN_sd of every bin, and the overflow."""
    cells = long.groupBy(*by).pivot("bin_index", list(range(n_bins))).agg(F.first("mean_density").alias("mean"), F.first("sd_density").alias("sd"))
    over = long.where("bin_index = 0").select(*by, "overflow_frac_mean", "overflow_frac_sd")
    named = [F.col(f"{i}_{s}").alias(f"bin_{i:02d}_{s}") for i in range(n_bins) for s in ("mean", "sd")]
    return cells.join(over, by).select(*by, *named, "overflow_frac_mean", "overflow_frac_sd")


def bounded_histogram(df: DataFrame, value: str, n_bins: int) -> DataFrame:
    """bin_low, bin_high, bin_index, n over [min, max]; equal ends move half a unit apart, at least two bins, no rows for no values."""
    n_bins = max(2, n_bins)
    x = df.select(F.col(value).alias("x")).where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo is not null")
    ends = ends.select(F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"), F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins), F.lit(n_bins - 1))
    counts = x.crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin_index")).agg(F.count("*").alias("n"))
    bins = ends.crossJoin(df.sparkSession.range(n_bins).select(F.col("id").alias("bin_index")))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / n_bins
    return bins.join(counts, "bin_index", "left").select("bin_index", edge(F.col("bin_index")).alias("bin_low"), edge(F.col("bin_index") + 1).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("n"))


def tail_summary(df: DataFrame, value: str, at_once: int = AT_ONCE) -> DataFrame:
    """mean, quantiles, max and the shares over twice and five times the median (0 if that is not positive); zeros for no rows."""
    at = (0.5, 0.9, 0.95, 0.99, 0.999)
    names = [f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}" for p in at]
    found = [0.0 if q is None else q for q in quantile_row(df, value, list(at), at_once)]
    over = lambda k: F.coalesce(F.avg((F.col(value) > k * found[0]).cast("int")) if found[0] > 0 else F.lit(0.0), F.lit(0.0))
    stats = df.where(F.col(value).isNotNull() & ~F.isnan(value)).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.max(value), F.lit(0.0)).cast("double").alias("max"), over(2).alias("over_2x"), over(5).alias("over_5x"), F.count("*").alias("n"))
    return stats.select("mean", *[F.lit(float(q)).alias(n) for q, n in zip(found, names, strict=True)], "max", "over_2x", "over_5x", "n")


def tails(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """tail_summary of each group, for groups of a bounded size (one value a tile)."""
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    stats = df.groupBy(*by).agg(F.count("*").alias("n_tiles"), F.avg(value).alias("mean"), *[F.percentile(value, F.lit(p)).alias(n) for n, p in at.items()], F.max(value).alias("max"))
    share = lambda k: F.avg(F.when((F.col("p50") > 0) & (F.col(value) > k * F.col("p50")), 1.0).otherwise(0.0))
    over = df.join(F.broadcast(stats.select(*by, "p50")), by).groupBy(*by).agg(share(2).alias("frac_gt_2x_median"), share(5).alias("frac_gt_5x_median"))
    return stats.join(over, by)


def moments(px: DataFrame, by: list[str] | None = None, vec: str = "vec") -> DataFrame:
    """by, i, j, s (i <= j): sums of products of components; i = -1: sums of component j; i = j = -1: rows. Rows without a vector are left out.

    Each task multiplies whole Arrow batches and sends one row for each pair of components (and group), so what is shuffled does not grow with
    the pixels. Groups are few (cells of a study).
    """
    by = by or []
    names = [*by, "i", "j", "s"]
    schema = StructType([*(px.schema[k] for k in by), StructField("i", _LONG), StructField("j", _LONG), StructField("s", DoubleType())])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = matrix(pa.Table.from_batches([batch]).column(vec))
            whole = np.hstack([np.ones((len(x), 1)), x])
            parts = {(): slice(None)}
            if by:
                parts = pd.DataFrame({k: batch.column(i).to_pandas() for i, k in enumerate(by)}).groupby(by, dropna=False).indices
            for key, at in parts.items():
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0) + whole[at].T @ whole[at]
        for key, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(i), schema_type) for k, schema_type in zip(key, kinds, strict=True)), pa.array(i - 1), pa.array(j - 1), pa.array(m[i, j])], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(px.schema[k].dataType) for k in by]
    return px.where(F.col(vec).isNotNull()).select(*by, vec).mapInArrow(run, schema).groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def dim_stats(px: DataFrame, ratio: float) -> DataFrame:
    """dim, mean, variance (population) and whether that is below `ratio` times the median variance.

    Each task sends its mean and squared deviations for each dimension; they are merged about the common mean.
    """

    def run(batches):
        n, mean, m2 = 0, 0.0, 0.0
        for batch in batches:
            x = matrix(pa.Table.from_batches([batch]).column("vec"))
            if len(x):
                own = x.mean(axis=0)
                gap = own - mean
                m2 = m2 + ((x - own) ** 2).sum(axis=0) + gap * gap * n * len(x) / (n + len(x))
                mean = mean + gap * len(x) / (n + len(x))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean))), pa.array([n] * len(mean), pa.int64()), pa.array(mean), pa.array(m2)], ["dim", "n", "mean", "m2"])

    parts = px.where("vec is not null").select("vec").mapInArrow(run, "dim long, n long, mean double, m2 double")
    total = parts.groupBy("dim").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("rows"))
    d = parts.join(total, "dim").groupBy("dim").agg(F.first("m").alias("mean"), (F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("m")) ** 2) / F.first("rows")).alias("variance"))
    return d.crossJoin(F.broadcast(d.agg(F.percentile("variance", F.lit(0.5)).alias("med")))).select("dim", "mean", "variance", (F.col("variance") < ratio * F.col("med")).alias("collapsed"))


def standardise(px: DataFrame) -> DataFrame:
    """z: components minus their mean over their deviation (0 counts as 1); the statistics are one row of 2 C numbers."""
    d = dim_stats(px, 0.0).select("dim", F.col("mean").alias("m"), F.sqrt("variance").alias("s"))
    one = d.agg(F.array_sort(F.collect_list(F.struct("dim", "m", V.or_one(F.col("s")).alias("s")))).alias("st"))
    return px.crossJoin(F.broadcast(one)).withColumn("z", F.zip_with("vec", "st", lambda x, s: (x - s["m"]) / s["s"])).drop("st")


def epps_pulley_statistic(x: np.ndarray, rows: int = 1024) -> float:
    """The statistic of one sample, standardised by its mean and population deviation; the double sum goes in blocks."""
    n, scale = len(x), x.std()
    if n < 8 or not scale > 0:
        raise ValueError("the test needs eight values that differ")
    y = (x - x.mean()) / scale
    pairs = sum(float(np.exp(-((y[i : i + rows, None] - y[None, :]) ** 2) / 2).sum()) for i in range(0, n, rows))
    return pairs / n - math.sqrt(2) * float(np.exp(-y * y / 4).sum()) + n / math.sqrt(3)


def epps_pulley(df: DataFrame, value: str, by: list[str], most: int = PAIRS) -> DataFrame:
    """The statistic of each group of eight values or more that differ. A group over `most` values is an error: sample it first, as the sum has its square of terms."""
    schema = StructType([*(df.schema[k] for k in by), StructField("statistic", DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        if len(x) > most:
            raise ValueError(f"a sample of {len(x)} values; draw {most} of them at most")
        out = pdf[by].iloc[:1].copy()
        out["statistic"] = epps_pulley_statistic(x)
        return out

    real = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    kept = real.groupBy(*by).agg(F.count("*").alias("_n"), F.stddev_pop(value).alias("_s")).where("_n >= 8 and _s > 0").select(*by)
    return real.select(*by, value).join(kept, by, "left_semi").groupBy(*by).applyInPandas(run, schema)


def wasserstein1(a: DataFrame, b: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distance between two samples in each group that has both, of any sizes: the area between their distribution functions."""
    both = a.select(*by, F.col(value).alias("x"), F.lit(1.0).alias("u"), F.lit(0.0).alias("v")).unionByName(b.select(*by, F.col(value).alias("x"), F.lit(0.0).alias("u"), F.lit(1.0).alias("v")))
    # Equal values fold first, so that what is sorted are distinct ones.
    steps = both.groupBy(*by, "x").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
    sizes = both.groupBy(*by).agg(F.sum("u").alias("nu"), F.sum("v").alias("nv")).where("nu > 0 and nv > 0")
    w = Window.partitionBy(*by).orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    gaps = steps.select(*by, (F.lead("x").over(w) - F.col("x")).alias("gap"), F.sum("u").over(run).alias("fu"), F.sum("v").over(run).alias("fv"))
    return gaps.join(F.broadcast(sizes), by).groupBy(*by).agg(F.sum(F.coalesce(F.col("gap"), F.lit(0.0)) * F.abs(F.col("fu") / F.col("nu") - F.col("fv") / F.col("nv"))).alias("w1"))


def unit_directions(n: int, dim: int, seed: int) -> np.ndarray:
    """(n, dim) random unit vectors."""
    g = np.random.default_rng(seed).standard_normal((n, dim))
    return g / np.linalg.norm(g, axis=1, keepdims=True)


def project(px: DataFrame, directions: np.ndarray, vec: str = "vec", keep: tuple = ()) -> DataFrame:
    """keep, direction, x: every row's product with each direction, by blocks; rows without a vector are left out."""
    sent = np.ascontiguousarray(directions.T)
    n = len(directions)
    schema = StructType([*(px.schema[k] for k in keep), StructField("direction", _LONG), StructField("x", DoubleType())])

    def run(batches):
        for batch in batches:
            out = matrix(pa.Table.from_batches([batch]).column(vec)) @ sent
            rows = pa.array(np.repeat(np.arange(len(out)), n))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keep))), pa.array(np.tile(np.arange(n), len(out))), pa.array(out.ravel())], [*keep, "direction", "x"])

    return px.where(F.col(vec).isNotNull()).select(*keep, vec).mapInArrow(run, schema)


def wasserstein1_projected(a: DataFrame, b: DataFrame, directions: np.ndarray, vec: str = "vec") -> DataFrame:
    """One row: the mean distance of two vector samples over unit directions."""
    return wasserstein1(project(a, directions, vec), project(b, directions, vec), "x", ["direction"]).agg(F.avg("w1").alias("w1"))


def direction_normality(px: DataFrame, directions: np.ndarray, threshold: float, alpha: float, vec: str = "vec", most: int = PAIRS) -> DataFrame:
    """Both normality tests on every direction's projection of a bounded sample: direction, sw_stat, sw_p, ep_stat, sw_reject, ep_reject."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(float)
        if len(x) > most:
            raise ValueError(f"a sample of {len(x)} values; draw {most} of them at most")
        w, p = shapiro_w(x)
        ep = epps_pulley_statistic(x)
        return pd.DataFrame({"direction": pdf["direction"].iloc[:1], "sw_stat": [w], "sw_p": [p], "ep_stat": [ep], "sw_reject": [bool(p < alpha)], "ep_reject": [bool(ep > threshold)]})

    schema = "direction long, sw_stat double, sw_p double, ep_stat double, sw_reject boolean, ep_reject boolean"
    return project(px, directions, vec).groupBy("direction").applyInPandas(run, schema)


def rejection_shares(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.col("sw_reject").cast("int")).alias("sw_rejected"), F.avg(F.col("ep_reject").cast("int")).alias("ep_rejected"), F.count("*").alias("n_directions"))


def ep_null_threshold(spark: SparkSession, n: int, alpha: float = 0.01, reps: int = 200, seed: int = 42) -> float:
    """The 1 - alpha quantile of the statistic over `reps` normal samples of n values; one seeded draw a task row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([epps_pulley_statistic(np.random.default_rng([seed, i]).standard_normal(n)) for i in ids])], ["rep", "statistic"])

    draws = spark.range(reps).repartition(min(reps, 64)).mapInArrow(run, "rep long, statistic double")
    return draws.agg(F.percentile("statistic", F.lit(1.0 - alpha))).first()[0]


def gram(px: DataFrame) -> DataFrame:
    """i, j, sum_xy for i <= j."""
    return moments(px).where("i >= 0").select("i", "j", F.col("s").alias("sum_xy"))


def energies(pdf: pd.DataFrame, centred: bool) -> np.ndarray:
    """Eigenvalues, falling and not below zero, of the (centred) Gram matrix of one group's moments."""
    c = int(pdf["j"].max()) + 1
    m = np.zeros((c + 1, c + 1))
    m[pdf["i"] + 1, pdf["j"] + 1] = pdf["s"]
    g = m[1:, 1:] + np.triu(m[1:, 1:], 1).T
    if centred and m[0, 0] > 0:
        g = g - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
    return np.clip(np.linalg.eigvalsh(g)[::-1], 0, None)


SHARES = (0.9, 0.95, 0.99)


def rank_of(energy: np.ndarray) -> dict[str, float]:
    """Participation ratio, exponent of the entropy, and components for 90, 95 and 99 % of the energy; zeros where there is none."""
    total = float(energy.sum())
    names = [f"dims_{round(100 * t)}" for t in SHARES]
    if total <= 0:
        return {"participation_ratio": 0.0, "entropy_eff_dim": 0.0, **dict.fromkeys(names, 0)}
    p = energy / total
    some = p[p > 0]
    dims = [int(np.searchsorted(np.cumsum(energy) / total, t) + 1) for t in SHARES]
    return {"participation_ratio": total**2 / float((energy**2).sum()), "entropy_eff_dim": float(np.exp(-(some * np.log(some)).sum())), **dict(zip(names, dims, strict=True))}


RANK = "participation_ratio double, entropy_eff_dim double, dims_90 long, dims_95 long, dims_99 long"


def rank_summary(sums: DataFrame, by: list[str]) -> DataFrame:
    """by, mode (raw, centered), n_vectors, ambient_dim and the rank figures, from the moments of each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        n = pdf.loc[pdf["j"] == -1, "s"].sum()
        for mode, centred in (("raw", False), ("centered", True)):
            e = energies(pdf, centred)
            rows.append({**{k: pdf[k].iloc[0] for k in by}, "mode": mode, "n_vectors": int(n), "ambient_dim": len(e), **rank_of(e)})
        return pd.DataFrame(rows)

    schema = ", ".join([*(f"{k} {sums.schema[k].dataType.simpleString()}" for k in by), "mode string, n_vectors long, ambient_dim long", RANK])
    return sums.groupBy(*by).applyInPandas(run, schema) if by else sums.groupBy(F.lit(0)).applyInPandas(run, schema)


def spectrum(px: DataFrame, centred: bool = True) -> DataFrame:
    """idx, singular value, share and cumulative share of the energy; only C x C sums reach one task; no rows where there is no energy."""

    def eig(pdf: pd.DataFrame) -> pd.DataFrame:
        v = energies(pdf, centred)
        if v.sum() <= 0:
            v = v[:0]
        p = v / v.sum() if len(v) else v
        return pd.DataFrame({"idx": np.arange(len(v)), "singular": np.sqrt(v), "share": p, "cumulative": np.cumsum(p)})

    return moments(px).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(eig, "idx long, singular double, share double, cumulative double")


def tile_rank(cb: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Participation ratio and dimensions for 95 % of the energy of each tile's codebook, not centred."""
    by = by or ["tile_row", "tile_col"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.stack(pdf["centroid"].to_numpy())
        e = np.linalg.svd(c, compute_uv=False) ** 2
        s = e.sum()
        dims = int((np.cumsum(e) / s < 0.95).sum()) + 1 if s else min(c.shape) + 1
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in by}, "pr": [s * s / (e * e).sum() if s else 0.0], "dims95": [dims]})

    schema = ", ".join([*(f"{k} {cb.schema[k].dataType.simpleString()}" for k in by), "pr double, dims95 long"])
    return cb.groupBy(*by).applyInPandas(run, schema)


def tile_rank_summary(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Tiles, mean, median and outer deciles of the participation ratio, and the median of the dimensions."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return ranks.groupBy(*by).agg(F.count("*").alias("n_tiles"), F.avg("pr").alias("pr_mean"), q("pr", 0.5).alias("pr_median"), q("pr", 0.1).alias("pr_p10"), q("pr", 0.9).alias("pr_p90"), q("dims95", 0.5).alias("dims95_median"))


def _normal_ppf(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf(v) for v in p])


def shapiro_w(x: np.ndarray) -> tuple[float, float]:
    """Royston's approximation of the W statistic and its p-value for 12 <= n <= 5000."""
    n = len(x)
    m = _normal_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    u, mm = 1 / math.sqrt(n), float(m @ m)
    c = m / math.sqrt(mm)
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, c[-1]], u)
    prev = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, prev, -last, -prev
    y = np.sort(x)
    w = float((a @ y) ** 2 / ((y - y.mean()) ** 2).sum())
    k = math.log(n)
    mu = 0.0038915 * k**3 - 0.083751 * k**2 - 0.31082 * k - 1.5861
    sigma = math.exp(0.0030302 * k**2 - 0.082676 * k - 0.4803)
    return w, 0.5 * math.erfc((math.log(1 - w) - mu) / sigma / math.sqrt(2))


def shapiro(df: DataFrame, value: str, by: str) -> DataFrame:
    """w and p of each group, which its caller has bounded (5,000 values)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_w(pdf[value].to_numpy(float))
        return pd.DataFrame({by: pdf[by].iloc[:1], "w": [w], "p": [p]})

    return df.select(by, value).groupBy(by).applyInPandas(run, f"{by} long, w double, p double")
