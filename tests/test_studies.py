"""Study jobs on windows where plain numpy gives the same."""

import numpy as np
import pytest

from vqloom.operators import metrics as M
from vqloom.operators import quantize as Q
from vqloom.plans import studies as T


def windows(spark, n=3, h=8, w=8, c=3, seed=0, empty=()):
    r = np.random.default_rng(seed)
    arrays = {f"w{i}": r.normal(size=(h, w, c)) for i in range(n)}
    for name in empty:
        arrays[name][:, ::3] = np.nan
    rows = [(name, i, j, a[i, j].tolist()) for name, a in arrays.items() for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "window_id string, row long, col long, vec array<double>"), arrays


def errors(a, t, k1, k2, n_iter):
    out = []
    for i in range(a.shape[0] // t):
        for j in range(a.shape[1] // t):
            x = a[i * t : (i + 1) * t, j * t : (j + 1) * t].reshape(t * t, -1)
            if np.isfinite(x).all():
                rec = Q.two_stages(x, k1, k2, n_iter, None)[4]
                out.append(np.sqrt(((x - rec) ** 2).sum(axis=1)))
    return np.concatenate(out) if out else np.zeros(0)


def test_histograms_over_windows_some_without_tiles(spark):
    px, arrays = windows(spark, empty=("w1",))
    cells = [(4, 2, 3), (2, 1, 2)]
    rows = {(r["t"], r["bin_index"]): r for r in T.histogram_sweep(px, cells, 6, 3, None).collect()}
    hi = np.percentile(errors(arrays["w0"], 4, 2, 3, 3), 99)
    for t, k1, k2 in cells:
        dens, over = [], []
        for a in arrays.values():
            e = errors(a, t, k1, k2, 3)
            counts = np.histogram(e, np.linspace(0, hi, 7))[0]
            dens.append(counts / len(e) if len(e) else np.zeros(6))
            over.append(1 - counts.sum() / len(e) if len(e) else 0)
        for b in range(6):
            r = rows[t, b]
            assert r["n_bboxes"] == 3 and np.allclose([r["mean_density"], r["sd_density"], r["overflow_frac_mean"], r["overflow_frac_sd"]], [np.mean([d[b] for d in dens]), np.std([d[b] for d in dens], ddof=1), np.mean(over), np.std(over, ddof=1)])
            assert np.allclose([r["bin_low"], r["bin_high"]], [b * hi / 6, (b + 1) * hi / 6])


def test_no_tile_at_all_has_the_default_edge(spark):
    px, _ = windows(spark, 1, empty=("w0",))
    long = T.histogram_sweep(px, [(4, 2, 3)], 5, 2, None)
    assert T.first_bins(long).count() == 1
    rows = long.collect()
    assert len(rows) == 5 and max(r["bin_high"] for r in rows) == 30 and all(r["mean_density"] == 0 for r in rows)


def test_cells():
    assert T.rvq_cells([2, 4], [2, 8], [3, 9]) == [(2, 2, 3), (4, 2, 3), (4, 2, 9), (4, 8, 9)]
    assert T.paired_cells([2, 4], [(3, 9), (2, 2)]) == [(2, 2, 2), (4, 3, 9), (4, 2, 2)]
    assert T.crossed_cells([2], [1, 2]) == [(2, 1, 1), (2, 1, 2), (2, 2, 1), (2, 2, 2)]


def test_window_sweep_and_medians(spark):
    px, arrays = windows(spark, 2)
    done = T.window_sweep(px, [4], [2, 20], 3, None)
    rows = {(r["window_id"], r["subtile"], r["k"]): r for r in done.collect()}
    assert len(rows) == 16 and {r["n_pixels"] for r in rows.values()} == {16}
    assert all(r["l2_p99"] == 0 for r in rows.values() if r["k"] == 20)  # as many centroids as pixels
    x = arrays["w1"][:4, 4:8].reshape(16, -1)
    c = Q.lloyd(x, 2, 3)
    e = np.sqrt(((x - c[Q.assign(x, c)]) ** 2).sum(axis=1))
    assert np.allclose([rows["w1", 1, 2][n] for n in ("l2_p10", "l2_p50")], np.quantile(e, [0.1, 0.5]), atol=1e-6)
    assert T.pilot_medians(done).count() == 2


def test_second_stage_is_fitted_on_residuals(spark):
    px, _ = windows(spark, 1)
    done = T.fitted(T.grid_pixels(px, [4]), [(4, 2, 3), (4, 2, None)], ("errors", "codes", "codebooks"), 3).collect()
    one = {(r["tile_row"], r["tile_col"]): sum(r["l2"]) for r in done if r["k2"] is None}
    assert all(sum(r["l2"]) <= one[r["tile_row"], r["tile_col"]] for r in done if r["k2"])
    assert all(r["code2"] is None and r["codebook2"] is None for r in done if r["k2"] is None)


def test_unreadable_windows_do_not_count(spark):
    px, _ = windows(spark, 2)
    bad = spark.createDataFrame([("w9", None, None, None)], px.schema)
    a = T.recon_sweep(px, [(4, 2, 3)], 3).collect()
    assert T.recon_sweep(px.unionByName(bad), [(4, 2, 3)], 3).collect() == a
    assert a[0]["n_tiles"] >= 2 and a[0]["rel_p99_mean"] >= a[0]["rel_p50_mean"]


def test_isotropy_of_a_normal_sample(spark):
    r = np.random.default_rng(1)
    px = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 4)))], "key long, vec array<double>")
    out = T.isotropy_study(px, M.unit_directions(10, 4, 1), "key", 300, reps=40)
    shares = out["shares"].first()
    assert shares["n_directions"] == 10 and shares["sw_rejected"] <= 0.2 and shares["ep_rejected"] <= 0.3
    skew = px.selectExpr("key", "transform(vec, x -> exp(x)) AS vec")
    shares = T.isotropy_study(skew, np.eye(4), "key", 300, reps=40)["shares"].first()
    assert shares["sw_rejected"] == 1 and shares["ep_rejected"] == 1


@pytest.mark.parametrize("n", [0, 1])
def test_tables_without_pixels(spark, n):
    px, _ = windows(spark, 1)
    px = px.limit(n)
    assert T.recon_sweep(px, [(4, 2, 3)], 2).count() == 0 and T.index_sweep(px, [(4, 2, 3)], 3, 2).count() == 0
    assert T.window_sweep(px, [4], [2], 2, None).count() == 0
    assert T.rank_study(px, [(4, 2, 3)], 2, None)["tails"].count() == 0


def test_pilot(spark):
    px, arrays = windows(spark, 2)
    done = T.pilot_sweep(px, [4, 99], [2, 70], 2, 42, (70,), 5)
    rows = done.collect()
    assert {(r["t"], r["k"], r["distance"]) for r in rows} == {(t, k, d) for t in (4, 99) for k, d in ((2, "euclidean"), (70, "euclidean"), (70, "cosine"))}
    assert {r["n_pixels"] for r in rows if r["t"] == 99} == {64}  # one block of the window's side
    assert T.pilot_medians(done).count() == 6
