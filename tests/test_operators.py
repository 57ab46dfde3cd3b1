import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqloom.functions import vec as V
from vqloom.operators import codec, grid, metrics, quantize
from vqloom.sources import sinks


def raster(spark, h, w, c=4, seed=0, bad=()):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(3, c)) * 5
    rows = [(i, j, [float("nan")] * c if (i, j) in bad else (centres[r.integers(3)] + r.normal(size=c) * 0.1).tolist()) for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "row long, col long, vec array<double>")


def test_planted_clusters_are_recovered(spark):
    done = quantize.errors(quantize.vq(grid.full_tiles(raster(spark, 16, 16), 16), 6, n_iter=10))
    assert done.agg(F.max("l2")).first()[0] < 12 and done.agg(F.avg("l2")).first()[0] < 4


def test_second_stage_never_hurts(spark):
    tiles = grid.full_tiles(raster(spark, 16, 8, seed=3), 8)
    one = quantize.errors(quantize.vq(tiles, 2)).agg(F.avg("l2")).first()[0]
    two = quantize.errors(quantize.vq(tiles, 2, 8)).agg(F.avg("l2")).first()[0]
    assert two <= one


def test_tiles_with_missing_values_or_ragged_edges_go(spark):
    px = raster(spark, 10, 13, bad={(1, 1)})
    kept = {(r["tile_row"], r["tile_col"], r["subtile"]) for r in grid.grid_tiles(px, 5).collect()}
    assert kept == {(0, 1, 0), (1, 0, 1), (1, 1, 2)}
    assert grid.grid_tiles(raster(spark, 3, 3, bad={(0, 0)}), 3).count() == 0


def test_codes_cap_at_the_number_of_points():
    x = np.arange(6.0).reshape(3, 2)
    assert len(quantize.lloyd(x, 10, 2)) == 3
    assert np.allclose(quantize.lloyd(x, 10, 2), x)


def test_uint8_roundtrip_is_within_half_a_step():
    c = np.random.default_rng(1).normal(size=(64, 16))
    c[:, 3] = 2.5
    step = (c.max(axis=0) - c.min(axis=0)) / 255
    back = quantize.roundtrip_uint8(c)
    assert (np.abs(back - c) <= step / 2 + 1e-12).all() and (back[:, 3] == 2.5).all()


def test_hilbert_steps_are_units_and_morton_inverts(spark):
    cells = spark.range(256).selectExpr("id div 16 AS row", "id % 16 AS col")
    walk = [(r["row"], r["col"]) for r in cells.select("row", "col", V.hilbert(F.col("row"), F.col("col"), 4).alias("d")).orderBy("d").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(walk, walk[1:], strict=False))
    code = V.morton(F.col("row"), F.col("col"))
    assert cells.where((V.unmorton(code, True) != F.col("row")) | (V.unmorton(code, False) != F.col("col"))).count() == 0


def test_runs_round_trip_with_nulls(spark):
    values = ["a", "a", None, None, "b", "a", "a"]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "tile int, pos long, v string")
    r = codec.runs(df, ["tile"], ["pos"], "v")
    assert sorted((x["run_id"], x["value"], x["length"]) for x in r.collect()) == [(1, "a", 2), (2, None, 2), (3, "b", 1), (4, "a", 2)]
    assert [x["value"] for x in codec.unrun(r, ["tile"]).orderBy("pos").collect()] == values


@pytest.mark.parametrize("n,want", [(1, 1), (2, 1), (256, 1), (257, 2), (65536, 2), (65537, 3)])
def test_symbol_bytes(spark, n, want):
    assert spark.range(1).select(codec.symbol_bytes(F.lit(n))).first()[0] == want


@pytest.mark.parametrize("n,want", [(1, 1), (127, 1), (128, 2), (16383, 2), (16384, 3)])
def test_varint_bytes(spark, n, want):
    assert spark.range(1).select(codec.varint_bytes(F.lit(n))).first()[0] == want


def test_perfect_and_mean_predictors(spark):
    px = raster(spark, 6, 6, seed=5).withColumns({"rec": F.col("vec"), "g": F.lit(0)})
    m = quantize.recon_metrics(px, ["g"]).first()
    assert m["rel_mean"] == 0 and math.isclose(m["r2"], 1)
    means = [px.agg(F.avg(F.element_at("vec", i + 1))).first()[0] for i in range(4)]
    m = quantize.recon_metrics(px.withColumn("rec", F.array(*map(F.lit, means))), ["g"]).first()
    assert abs(m["r2"]) < 1e-9


def test_rank_of_known_codebooks(spark):
    rows = [(0, 0, i, [float(i + 1), 2.0 * (i + 1)]) for i in range(5)] + [(0, 1, i, [float(i == j) for j in range(8)]) for i in range(8)] + [(0, 2, i, [0.0, 0.0]) for i in range(3)]
    got = {r["tile_col"]: (round(r["pr"], 6), r["dims95"]) for r in metrics.tile_rank(spark.createDataFrame(rows, "tile_row long, tile_col long, code long, centroid array<double>")).collect()}
    assert got == {0: (1.0, 1), 1: (8.0, 8), 2: (0.0, 3)}


def test_shapiro_tells_normal_from_skewed():
    r = np.random.default_rng(0)
    assert metrics.shapiro_w(r.normal(size=3000))[0] > 0.995
    w, p = metrics.shapiro_w(r.exponential(size=3000))
    assert w < 0.9 and p < 1e-6


def test_splits(spark):
    g = spark.createDataFrame([(i % 10,) for i in range(50)], "grp long")
    assert grid.group_split(g, "grp", 0.3, 1).where("is_test").count() == 3
    assert grid.group_split(g.where("grp = 1"), "grp", 0.3, 1).where("is_test").count() == 0
    sizes = sorted(r["count"] for r in grid.group_kfold(g, "grp", 4, 1).groupBy("fold").count().collect())
    assert sizes == [2, 2, 3, 3]
    assert grid.group_kfold(g.where("grp = 1"), "grp", 4, 1).count() == 0


def test_histogram_parts_and_overflow_make_one(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(0, float(x)) for x in r.random(2000)], "g int, x double")
    edges = spark.createDataFrame([(0.8,)], "hi double")
    h = metrics.histogram(df, "x", ["g"], edges, 10)
    inside, over = h.agg(F.sum("density"), F.first("overflow")).first()
    assert math.isclose(inside + over, 1) and math.isclose(over, df.where("x > 0.8").count() / 2000)


def test_provenance_and_eviction(spark, tmp_path):
    df = spark.range(3)
    sinks.save_results(df, str(tmp_path / "p"), 7, b"x")
    assert set(spark.read.parquet(str(tmp_path / "p")).columns) == {"id", "git_sha", "seed", "timestamp_utc", "config_hash"}
    entries = spark.createDataFrame([("a", 100, 1), ("b", 100, 2), ("c", 100, 3)], "key string, bytes long, at long")
    assert [r["key"] for r in sinks.evict_plan(entries, "bytes", ["at"], 250).collect()] == ["a"]


def slow_assign(x, c):
    return np.array([int(np.argmin(np.sqrt(((c - v) ** 2).sum(axis=1)))) for v in x])


@pytest.mark.parametrize("shift", [0.0, 1000.0])
def test_blocked_assignment_is_exact(shift):
    r = np.random.default_rng(7)
    x = r.integers(-3, 4, size=(3000, 5)).astype(float) + shift  # many ties
    c = np.unique(r.integers(-3, 4, size=(60, 5)).astype(float), axis=0)[r.permutation(50)] + shift
    assert (quantize.assign(x, c, 256) == slow_assign(x, c)).all()
    c = np.vstack([c, c])  # of equal centroids the first one
    assert (quantize.assign(x, c) == slow_assign(x, c)).all()


def test_a_large_tile_is_fast():
    r = np.random.default_rng(0)
    x = r.normal(size=(256 * 256, 128))
    began = time.time()
    code = quantize.assign(x, quantize.lloyd(x, 256, 20, 2000))
    assert time.time() - began < 20 and len(np.unique(code)) > 200


def test_starts_and_distances():
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(size=(40, 4)) + 20 * np.eye(4)[i] for i in range(4)])
    for c in (quantize.lloyd(x, 4, 10, init="k-means++"), quantize.batched(x, 4, 10)):
        assert np.sqrt(((x - c[quantize.assign(x, c)]) ** 2).sum(axis=1)).mean() < 15
    c, code = quantize.quantise(x, 80, "cosine")
    assert c.shape == (80, 4) and (np.sqrt((c * c).sum(axis=1)) < 1.01).all() and code.max() < 80
    with pytest.raises(ValueError):
        quantize.quantise(x, 2, "taxi")


def test_null_and_ragged_vectors(spark):
    rows = [(i, j, [float(i), float(j)]) for i in range(4) for j in range(4)]
    px = spark.createDataFrame([(i, j, None if (i, j) == (0, 1) else [1.0] if (i, j) == (2, 2) else [None, 1.0] if (i, j) == (3, 0) else v) for i, j, v in rows], "row long, col long, vec array<double>")
    assert grid.full_tiles(px, 2).select("tile_row", "tile_col").distinct().count() == 2  # a null, and a null component
    done = {(r["row"], r["col"]): r["code1"] for r in quantize.vq(grid.tiled(px, 2), 2).collect()}
    assert {k for k, v in done.items() if v < 0} == {(0, 1), (2, 2), (3, 0)}
    assert grid.nan_gate(px.withColumn("g", F.lit(1)), "g", 2 / 16).count() == 1 and grid.nan_gate(px.withColumn("g", F.lit(1)), "g", 1 / 16).count() == 0
    assert quantize.vq(grid.full_tiles(px.limit(0), 2), 2).count() == 0


def test_windows_do_not_mix(spark):
    a = raster(spark, 4, 4, seed=1).withColumn("window_id", F.lit("a"))
    b = raster(spark, 4, 4, seed=2, bad={(0, 0)}).withColumn("window_id", F.lit("b"))
    both = a.unionByName(b)
    assert {(r["window_id"], r["tile_row"], r["tile_col"], r["subtile"]) for r in grid.grid_tiles(both, 2).collect()} == {("a", 0, 0, 0), ("a", 0, 1, 1), ("a", 1, 0, 2), ("a", 1, 1, 3), ("b", 0, 1, 0), ("b", 1, 0, 1), ("b", 1, 1, 2)}
    alone = {(r["row"], r["col"]): r["code1"] for r in quantize.vq(grid.full_tiles(a, 2), 2).collect()}
    assert alone == {(r["row"], r["col"]): r["code1"] for r in quantize.vq(grid.full_tiles(both, 2), 2).where("window_id = 'a'").collect()}


def test_tiles_chosen_greedily(spark):
    px = raster(spark, 30, 40, c=2, bad={(i, 12) for i in range(30)}).withColumn("window_id", F.lit("w"))
    cand = grid.candidate_origins(grid.extents(px), 6, 24, 5)
    rows = [(r["row0"], r["col0"]) for r in cand.collect()]
    assert rows and all(0 <= a <= 24 and 0 <= b <= 34 and abs(a - 12) <= 3 and abs(b - 17) <= 3 for a, b in rows)
    got = sorted((r["row0"], r["col0"], r["finite_frac"]) for r in grid.tile_select(px, cand, 6, 0.5, 3).collect())
    want = []
    for f, a, b in sorted(((1 - (6 if b <= 12 < b + 6 else 0) / 36, a, b) for a, b in rows), reverse=True):
        if f >= 0.5 and all(abs(a - c) >= 6 or abs(b - d) >= 6 for c, d, _ in want) and len(want) < 3:
            want.append((a, b, f))
    assert got == sorted(want)
    assert grid.cut_out(px, grid.tile_select(px, cand, 6, 0.5, 1), 6).agg(F.min("row"), F.max("row"), F.count("*")).first()[:] == (0, 5, 36)
    assert grid.candidate_origins(grid.extents(px), 31).count() == 0


def test_carving_gives_one_block_where_a_tile_is_too_large(spark):
    px = raster(spark, 5, 8, c=2).withColumn("window_id", F.lit("w"))
    assert grid.carve(px, 9, 3, 1).agg(F.count("*"), F.max("row"), F.max("col")).first()[:] == (25, 4, 4)
    assert grid.carve(px, 2, 3, 1).select("tile_row", "tile_col").distinct().count() == 3


def test_quantiles_of_a_whole_table_are_exact(spark):
    r = np.random.default_rng(5)
    values = np.concatenate([r.exponential(size=3000), np.full(2000, 0.25), -r.random(50) * 1e6, [0.0] * 10])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    at = [0.0, 0.01, 0.5, 0.9, 0.99, 0.999, 1.0]
    for few in (10, 100_000):
        assert np.allclose(metrics.quantile_row(df, "x", at, few), np.quantile(values, at))
    assert metrics.quantile_row(df.limit(0), "x", at) == [None] * 7
    tail = metrics.tail_summary(df, "x", 50).first()
    assert math.isclose(tail["p50"], np.median(values)) and math.isclose(tail["over_2x"], (values > 2 * np.median(values)).mean())
    assert metrics.tail_summary(df.limit(0), "x").first()[:] == (0.0,) * 9 + (0,)


def test_edges_of_histograms(spark):
    zero = spark.createDataFrame([(0, 0.0)] * 4, "g int, x double")
    assert metrics.bin_edge(zero, "x").first()["hi"] == 1 and metrics.bin_edge(zero.limit(0), "x").first()["hi"] == 30
    h = metrics.histogram(zero, "x", ["g"], spark.createDataFrame([(0.0,)], "hi double"), 4).orderBy("bin_index").collect()
    assert [r["density"] for r in h] == [1, 0, 0, 0]
    assert [r["n"] for r in metrics.bounded_histogram(zero, "x", 2).orderBy("bin_index").collect()] == [0, 4]
    assert metrics.bounded_histogram(zero.limit(0), "x", 5).count() == 0


def test_transport_of_unequal_samples(spark):
    r = np.random.default_rng(6)
    x, y = np.round(r.normal(size=10), 1), np.round(r.normal(size=23) + 1, 1)
    frame = lambda v: spark.createDataFrame([(0, float(z)) for z in v], "g int, x double")
    grid_ = np.unique(np.concatenate([x, y]))
    want = sum((b - a) * abs((x <= a).mean() - (y <= a).mean()) for a, b in zip(grid_, grid_[1:], strict=False))
    assert math.isclose(metrics.wasserstein1(frame(x), frame(y), "x", ["g"]).first()["w1"], want)
    assert metrics.wasserstein1(frame(x), frame(x), "x", ["g"]).first()["w1"] == 0
    assert metrics.wasserstein1(frame(x), frame([]), "x", ["g"]).count() == 0


def test_moments_and_ranks_match_numpy(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(60, 5)) * [5, 2, 1, 0.1, 0] + 50
    df = spark.createDataFrame([(int(i % 2), v.tolist()) for i, v in enumerate(x)] + [(0, None)], "g long, vec array<double>").repartition(3)
    ours = {(q["g"], q["mode"]): q for q in metrics.rank_summary(metrics.moments(df, ["g"]), ["g"]).collect()}
    for g in (0, 1):
        part = x[np.arange(60) % 2 == g]
        for mode, m in (("raw", part), ("centered", part - part.mean(axis=0))):
            e = np.linalg.svd(m, compute_uv=False) ** 2
            p, row = e[e > 1e-9] / e.sum(), ours[g, mode]
            assert math.isclose(row["participation_ratio"], e.sum() ** 2 / (e**2).sum(), rel_tol=1e-6) and row["n_vectors"] == 30
            assert math.isclose(row["entropy_eff_dim"], math.exp(-(p * np.log(p)).sum()), rel_tol=1e-5)
            assert [row[f"dims_{k}"] for k in (90, 95, 99)] == [int((np.cumsum(e) / e.sum() < t).sum()) + 1 for t in (0.9, 0.95, 0.99)]
    stats = {q["dim"]: q for q in metrics.dim_stats(df, 0.01).collect()}
    assert all(math.isclose(stats[d]["mean"], x[:, d].mean()) and math.isclose(stats[d]["variance"], x[:, d].var(), abs_tol=1e-12) for d in range(5))
    assert stats[4]["collapsed"] and not stats[0]["collapsed"]
    assert metrics.rank_of(np.zeros(4)) == {"participation_ratio": 0.0, "entropy_eff_dim": 0.0, "dims_90": 0, "dims_95": 0, "dims_99": 0}


def test_known_normality_statistics():
    """Published results of the test on two small samples."""
    heights = np.arange(58.0, 73.0)
    mpg = np.array([21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4])
    for x, w, p in ((heights, 0.96359, 0.7545), (mpg, 0.94756, 0.1229)):
        got = metrics.shapiro_w(x)
        assert abs(got[0] - w) < 2e-4 and abs(got[1] - p) < 5e-3


def test_epps_pulley_refuses_what_it_cannot_take(spark):
    df = spark.createDataFrame([(0, float(i % 7)) for i in range(50)] + [(1, 1.0)] * 20 + [(2, float(i)) for i in range(5)], "g int, x double")
    assert [r["g"] for r in metrics.epps_pulley(df, "x", ["g"]).collect()] == [0]
    with pytest.raises(Exception, match="draw 40"):
        metrics.epps_pulley(df, "x", ["g"], 40).collect()
    with pytest.raises(ValueError):
        metrics.epps_pulley_statistic(np.ones(20))
    x = np.random.default_rng(0).normal(size=300)
    assert math.isclose(metrics.epps_pulley_statistic(x), metrics.epps_pulley_statistic(7 + 3 * x), rel_tol=1e-9)


def test_scan_positions_over_several_blocks(spark):
    cells = spark.range(30 * 23).selectExpr("id div 23 AS row", "id % 23 AS col")
    for name in codec.ORDERINGS:
        one = {(r["row"], r["col"]): r["pos"] for r in codec.scan_positions(cells, name).collect()}
        assert one == {(r["row"], r["col"]): r["pos"] for r in codec.scan_positions(cells, name, 64).collect()}
        assert sorted(one.values()) == list(range(690))
    with pytest.raises(ValueError):
        codec.order_key("spiral", F.lit(0), F.lit(0), 4)
