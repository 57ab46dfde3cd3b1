import random
import re

import pytest
from pyspark.sql import functions as F

from vqloom.llm import mixing

from .rows import documents, empty


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fill(sizes, weights):
    """Targets by raising a common level until all is dealt."""
    total, lo, hi = sum(sizes), 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(3 * s, hi * w) for s, w in zip(sizes, weights, strict=True)]


def check(docs):
    rows = docs.collect()
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(words(r["text"]) for r in rows if r["source"] == s) for s in names}
    goal = dict(zip(names, fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    out = mixing.mix(docs, F.array("source"), key=("source",)).collect()
    assert len(out) == len(rows)
    taken = dict.fromkeys(names, 0)
    for r in out:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) <= 1e-6 * max(1, goal[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 3 + 1e-6 * goal[s]
    again = mixing.mix(docs.repartition(5), F.array("source"), key=("source",)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sorted(words(r["text"]) for r in rows) == sorted(r["size"] for r in out)


def test_sources_reach_their_targets(spark):
    r = random.Random(1)
    docs = [(i, " ".join(["w"] * r.choice([0, 1, 5, 50, 400])), r.choice(["a", "b", "b", "b", "ab", "é", "Z", None])) for i in range(300)]
    check(spark.createDataFrame(docs, "doc_id long, text string, source string"))


def test_odd_rows(spark):
    check(documents(spark))
    assert mixing.op9_mixing(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.op9_mixing(blank).collect()] == [0, 0]
    docs = documents(spark)
    assert mixing.mixed(docs).columns == docs.columns


def test_flow_with_overlapping_sources():
    # Source 1 can only be filled from the shared pattern, source 0 also from its own.
    flow = mixing.min_cost_flow([((0,), 10), ((0, 1), 10)], [12.0, 20.0])
    sent = [sum(f.values()) for f in flow]
    assert abs(sum(f.get(0, 0) for f in flow) - 12) < 1e-6 and abs(sum(f.get(1, 0) for f in flow) - 20) < 1e-6
    assert max(sent) <= 20 + 1e-6  # the cheapest way uses the second passes of both, never a third
    # A flow that was sent early is taken back where another source needs it.
    flow = mixing.min_cost_flow([((0, 1), 5), ((0,), 5)], [5.0, 5.0], repeats=1)
    assert abs(flow[0].get(1, 0) - 5) < 1e-6 and abs(flow[1].get(0, 0) - 5) < 1e-6


def test_flow_cost_matches_exhaustive_search():
    import itertools

    r = random.Random(2)
    for _ in range(30):
        patterns = [(tuple(sorted(r.sample(range(3), r.randint(1, 3)))), r.randint(1, 3)) for _ in range(3)]
        quotas = [float(r.randint(0, 4)) for _ in range(3)]
        flow = mixing.min_cost_flow(patterns, quotas, repeats=2)
        cost = lambda sent: sum(max(0, x - n) for x, (_, n) in zip(sent, patterns, strict=True))
        best = None
        choices = [[c for c in itertools.product(*[range(2 * n + 1) if s in own else (0,) for s in range(3)]) if sum(c) <= 2 * n] for own, n in patterns]
        for pick in itertools.product(*choices):
            got = [sum(c[s] for c in pick) for s in range(3)]
            if all(g <= q for g, q in zip(got, quotas, strict=True)):
                key = (-sum(got), cost([sum(c) for c in pick]))
                best = min(best, key) if best else key
        ours = [sum(f.values()) for f in flow]
        assert abs(sum(ours) + best[0]) < 1e-6 and abs(cost(ours) - best[1]) < 1e-6


def test_texts_of_one_id_and_length_are_told_apart(spark):
    """Where the cut falls between them, each text of an id gets its own answer."""
    docs = [(7, f"{chr(97 + i % 26)}{i} b c d", "a") for i in range(40)] + [(i, "x y", "b") for i in range(10)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    taken = {r["text"]: r["taken"] for r in mixing.mix(docs, F.array("source"), key=("text",)).collect()}
    passes = {r["text"]: r["count"] for r in mixing.mixed(docs).where("doc_id = 7 and source = 'a'").groupBy("text").count().collect()}
    assert len({v for k, v in taken.items() if k != "x y"}) > 1
    assert passes == {k: (v + 2) // 4 for k, v in taken.items() if k != "x y" and v * 2 >= 4}


def test_too_many_patterns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST", 3)
    docs = spark.createDataFrame([(i, "a", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.op9_mixing(docs)


def test_rows_of_the_driver_start_no_python_workers(spark, monkeypatch):
    docs = documents(spark).cache()
    docs.count()
    want = sorted(map(str, mixing.op9_mixing(docs).collect()))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("a list of rows went through Python workers"))
    assert sorted(map(str, mixing.op9_mixing(docs).collect())) == want and mixing.mixed(docs).count()
    docs.unpersist()
