import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqloom import api
from vqloom.operators import grid, payload, quantize, sampling
from vqloom.sources import raster, sinks
from vqloom.streaming import accumulate

BOX = (0.0, 50.0, 0.02, 50.02)


def pixels(spark, h=12, w=17, hole=False):
    r = np.random.default_rng(0)
    rows = [(i, j, r.normal(size=3).tolist() if not hole else [float("nan")] * 3) for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "row long, col long, vec array<double>")


def test_structure_and_mosaic_agree(spark, tmp_path):
    engine = api.Engine(spark, lambda b, year: pixels(spark), str(tmp_path / "c"), t=5, k=3, k2=4, n_iter=3)
    s = engine.fetch_quantized_structure(BOX)
    assert s.is_rvq and (s.height, s.width) == (12, 17) and s.payload.count() == 6
    mosaic, (west, north, dx, dy), crs = engine.fetch_mosaic_for_region(BOX)
    assert mosaic.count() == 150 and mosaic.where("rec is null").count() == 0 and abs(dx - 0.02 / 17) < 1e-12 and crs == "EPSG:4326"
    one = s.codebooks1.select("tile_row", "tile_col", F.col("code").alias("code1"), F.col("centroid").alias("a"))
    two = s.codebooks2.select("tile_row", "tile_col", F.col("code").alias("code2"), F.col("centroid").alias("b"))
    back = s.codes.join(one, ["tile_row", "tile_col", "code1"]).join(two, ["tile_row", "tile_col", "code2"]).join(mosaic, ["row", "col"])
    worst = max(np.abs(np.array(r["a"]) + np.array(r["b"]) - np.array(r["rec"])).max() for r in back.collect())
    assert back.count() == 150 and worst < 1e-9
    h = engine.fetch_residual_histogram(BOX, n_bins=7)
    assert sum(h["counts"]) == h["n_pixels"] == 150 and len(h["bin_edges"]) == 8 and h["stats"]["p10"] <= h["stats"]["p99"]


@pytest.mark.parametrize("k,k2", [(3, None), (3, 4), (300, None), (3, 300)])
def test_payload_round_trip(spark, k, k2):
    """Unpacked tiles equal direct quantisation, up to 8-bit codebooks for two stages and 32 bits for one; index planes of two bytes too."""
    side = 18 if max(k, k2 or 0) > 256 else 6
    r = np.random.default_rng(1)
    px = spark.createDataFrame([(i, j, r.normal(size=3).tolist()) for i in range(side) for j in range(side)], "row long, col long, vec array<double>")
    tiles = grid.full_tiles(px, side)
    got = payload.unpack(payload.pack(tiles, side, k, k2, 3, None), 100).join(quantize.vq(tiles, k, k2, 3, uint8=bool(k2)).select("row", "col", F.col("code1").alias("c1"), F.col("code2").alias("c2"), F.col("rec").alias("want")), ["row", "col"])
    rows = got.collect()
    assert len(rows) == side * side
    assert all(x["code1"] == x["c1"] and (x["code2"] is None if k2 is None else x["code2"] == x["c2"]) for x in rows)
    assert max(np.abs(np.array(x["rec"]) - np.array(x["want"])).max() for x in rows) < 1e-5


def test_results_come_from_the_cache(spark, tmp_path):
    calls = []

    def source(b, year):
        calls.append((b, year))
        return pixels(spark)

    engine = api.Engine(spark, source, str(tmp_path / "c"), t=5, k=3, k2=None)
    total = lambda e, **k: e.fetch_mosaic_for_region(BOX, **k)[0].agg(F.sum(F.element_at("rec", 1))).first()[0]
    assert total(engine) == total(engine) and len(calls) == 1
    # Other years, distances, parameters and sources are other results.
    total(engine, year=2023)
    for other in (dict(m="cosine"), dict(k=2), dict(name="elsewhere"), dict(sample=9)):
        total(api.Engine(spark, source, str(tmp_path / "c"), **({"t": 5, "k": 3, "k2": None} | other)))
    assert len(calls) == 6


def test_cache_keeps_the_recently_used(spark, tmp_path):
    table = lambda n: spark.range(n * 1000).repartition(1)
    cache = sinks.ResultCache(spark, str(tmp_path / "r"), 1 << 40)
    for key in "abc":
        cache.get_or_compute(key, lambda: table(3))
        time.sleep(0.05)
    with pytest.raises(ZeroDivisionError):
        cache.get_or_compute("d", lambda: 1 / 0)
    assert cache.get("d") is None and len(cache.entries()) == 3
    assert cache.get("a").count() == 3000  # now the most recent
    cache.cap = cache.total_bytes() - 1
    assert [p[-8:] for p in cache.evict()] == [cache.place("b")[-8:]]
    assert cache.get("a") is not None and cache.get("b") is None and cache.get("c") is not None


def test_typed_errors(spark):
    make = lambda src, **k: api.Engine(spark, src, **({"t": 5, "k": 2, "k2": None} | k))
    good, hole = (lambda b, y: pixels(spark)), (lambda b, y: pixels(spark, hole=True))
    for engine, box, error in [(make(lambda b, y: None), BOX, api.NoData), (make(good), (0, 0, 1), api.BadRequest), (make(good), None, api.BadRequest), (make(good, k=0), BOX, api.BadRequest), (make(good, m="taxi"), BOX, api.BadRequest), (make(good), (0, 0, 1, 1), api.TooLarge), (make(hole), BOX, api.NoCoverage), (make(good, t=50), BOX, api.NoCoverage)]:
        with pytest.raises(error):
            engine.fetch_mosaic_for_region(box)
    with pytest.raises(api.BadRequest):
        make(good).fetch_quantized_structure(BOX, target_crs="EPSG:32630")
    assert make(hole).fetch_residual_histogram(BOX)["counts"] == []
    busy = make(good, slots=1)
    with busy._slot(), pytest.raises(api.Busy):
        busy.fetch_mosaic_for_region(BOX)
    assert make(good, cap_km=12.0).fetch_embedding(0.01, 50.01)[0].count() == 150


def test_windows_from_files_with_fallback(spark, tmp_path):
    for folder, names in (("a", ["w1", "w2"]), ("b", ["w2", "w3"])):
        (tmp_path / folder).mkdir()
        for n in names:
            np.save(tmp_path / folder / f"{n}.npy", np.arange(24, dtype=np.float32).reshape(3, 4, 2))
    (tmp_path / "a" / "w3.npy").write_bytes(b"broken")
    a, b = raster.read_windows(spark, str(tmp_path / "a"), 5), raster.read_windows(spark, str(tmp_path / "b"))
    got = {(r["window_id"], r["origin"]): r["count"] for r in raster.prefer(a, b).groupBy("window_id", "origin").count().collect()}
    assert got == {("w1", "primary"): 12, ("w2", "primary"): 12, ("w3", "fallback"): 12}
    assert a.where("row = 2 and col = 1 and window_id = 'w1'").first()["vec"] == [18.0, 19.0]


def test_location_samples(spark):
    pool = spark.range(10)
    assert raster.sample_locations(pool, "id", 4, 1).distinct().count() == 4
    assert raster.sample_locations(pool, "id", 25, 1).count() == 25


def test_streamed_sums_equal_batch_sums(spark, tmp_path):
    px = pixels(spark).withColumn("x", F.abs(F.element_at("vec", 1))).withColumn("g", F.col("row") % 2)
    px.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        accumulate.stream_histogram(stream(), "x", ["g"], 2.0, 8, str(tmp_path / "h"))
    got = accumulate.histogram_so_far(spark, str(tmp_path / "h"), ["g"])
    assert got.agg(F.sum("n")).first()[0] == px.count()
    assert got.where("bin_index = 8").agg(F.sum("n")).first()[0] == px.where("x > 2").count()
    accumulate.stream_gram(stream(), "vec", str(tmp_path / "g"))
    x = np.array([r["vec"] for r in px.collect()])
    want = x.T @ x
    assert all(abs(r["sum_xy"] - want[r["i"], r["j"]]) < 1e-9 for r in accumulate.gram_so_far(spark, str(tmp_path / "g")).collect())


def test_sampled_points_and_what_became_of_windows(spark):
    """Windows that fail, are empty or hold nothing finite are reported and end nothing."""
    centres = spark.createDataFrame([(f"w{i}", 0.05 + i, 50.05) for i in range(5)], "window_id string, lon double, lat double")
    nan = float("nan")

    def read(windows):
        rows = [("w0", r, c, [1.0, 2.0], "primary") for r in range(4) for c in range(4)] + [("w1", r, 0, [nan, 2.0], "primary") for r in range(3)] + [("w2", None, None, None, None), ("w3", 0, 0, [1.0, 1.0], "fallback")]
        px = spark.createDataFrame(rows, "window_id string, row long, col long, vec array<double>, origin string")
        return px.join(windows.select("window_id"), "window_id", "left_semi")

    points, counts = sampling.isotropy_points(centres, read, 5, 6)
    assert points.count() == 7 and points.where("window_id = 'w0'").count() == 6
    assert {r["path"]: r["n"] for r in counts.collect()} == {"primary": 1, "nan_skipped": 1, "error": 1, "fallback": 1, "empty": 1}
    boxes = sampling.jittered(centres, 0.01, 1).join(centres, "window_id").collect()
    assert all(abs(r["east"] - r["west"] - 0.01) < 1e-9 and r["lon"] - 0.05 <= r["west"] + 1e-9 and r["east"] <= r["lon"] + 0.05 + 1e-9 for r in boxes)
    with pytest.raises(ValueError):
        sampling.isotropy_points(centres, lambda w: read(w).where("window_id = 'w2'"), 5, 6)


def test_canonical_windows(spark):
    boxes = spark.createDataFrame([("a", 0.05, 51.25), ("b", -3.05, 10.15), ("c", 7.05, 9.95)], "name string, lon double, lat double")
    assert sampling.canonical(boxes).count() == 3
    with pytest.raises(ValueError, match="d"):
        sampling.canonical(boxes.unionByName(spark.createDataFrame([("d", 7.01, 9.95)], boxes.schema)))
    nan = float("nan")
    first = spark.createDataFrame([("a", 0, 0, [1.0]), ("b", 0, 0, [nan]), ("b", 0, 1, [nan]), ("b", 0, 2, [1.0]), ("c", None, None, None)], "window_id string, row long, col long, vec array<double>")
    second = spark.createDataFrame([("a", 0, 0, [9.0]), ("b", 0, 0, [2.0])], first.schema)
    px, paths = sampling.canonical_windows(boxes, first, second)
    assert {r["name"]: r["path"] for r in paths.collect()} == {"a": "primary", "b": "fallback", "c": "unavailable"}
    assert sorted((r["window_id"], r["vec"][0]) for r in px.collect()) == [("a", 1.0), ("b", 2.0)]
    covered = spark.createDataFrame([("b",)], "name string")
    assert {r["name"]: r["path"] for r in sampling.chosen_path(boxes, covered).collect()} == {"a": "fallback", "b": "primary", "c": "fallback"}
    assert {r["path"] for r in sampling.chosen_path(boxes, None).collect()} == {"fallback"}


def test_region_windows_by_rejection(spark):
    tried = sampling.region_windows(spark, (1.0, 2.0, 3.0, 4.0), 3, 7, tries=4)
    assert tried.where("lon between 1 and 3 and lat between 2 and 4").count() == 12
    nan = float("nan")
    px = spark.createDataFrame([(i, 0, j, [nan if i % 2 and j else 1.0]) for i in range(12) for j in range(4)], "window_id long, row long, col long, vec array<double>")
    assert [r["window_id"] for r in sampling.accepted(tried, px, 3).collect()] == [0, 2, 4]


def test_bounded_choices(spark):
    df = spark.range(50).selectExpr("id", "id % 3 = 0 AS mask")
    assert sampling.capped_mask(df, "mask", 5, "id", 1).where("mask").count() == 5
    assert sampling.capped_mask(df, "mask", 99, "id", 1).where("mask").count() == 17
    picked = [r["id"] for r in sampling.subset_in_order(df, 7, "id", 3, "id").collect()]
    assert len(picked) == 7 and picked == sorted(picked)
    assert sampling.subset_in_order(df, 70, "id", 3, "id").count() == 50


def test_sweep_tables(spark, tmp_path):
    long = spark.createDataFrame([(5, 2, 3, b, b / 2, (b + 1) / 2, 0.5, 0.1, 0.0, 0.0, 2) for b in range(2)], "t long, k1 long, k2 long, bin_index long, bin_low double, bin_high double, mean_density double, sd_density double, overflow_frac_mean double, overflow_frac_sd double, n_bboxes long")
    a, b = sinks.save_sweep(long, str(tmp_path / "s"), ["t", "k1", "k2"], 2, 42, b"x", "r")
    assert spark.read.option("header", True).csv(a).count() == 2
    wide = spark.read.option("header", True).csv(b)
    assert wide.columns[:9] == ["t", "k1", "k2", "bin_00_mean", "bin_00_sd", "bin_01_mean", "bin_01_sd", "overflow_frac_mean", "overflow_frac_sd"] and wide.first()["git_sha"] == "r"


def test_centres_of_a_year(spark):
    tiles = spark.createDataFrame([(0.05, 50.05, 2024), (0.15, 50.05, 2024), (0.05, 50.05, 2023)], "lon double, lat double, year int")
    assert raster.centres(tiles, 2024).count() == 2 and raster.centres(tiles, 2024, (0.05, 50.05, 0.1, 51)).count() == 1
    with pytest.raises(ValueError):
        raster.centres(tiles, 2020)
    with pytest.raises(ValueError):
        raster.centres(tiles, 2024, (1, 1, 2, 2))


def test_files_of_any_content_end_nothing(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.ones(3))
    (tmp_path / "a.npz").rename(tmp_path / "a.npy")
    np.save(tmp_path / "b.npy", np.ones((2, 2)))
    np.save(tmp_path / "c.npy", np.array([["x"]], dtype=object), allow_pickle=True)
    np.save(tmp_path / "d.npy", np.ones((1, 2, 2)))
    px = raster.read_windows(spark, str(tmp_path))
    assert sorted((r["window_id"], r["vec"] is None) for r in px.collect()) == [("a", True), ("b", True), ("c", True), ("d", False), ("d", False)]
