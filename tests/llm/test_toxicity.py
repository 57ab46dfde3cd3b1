import math
import random
import re

import numpy as np

from vqloom.llm import toxicity

from .rows import documents, empty


def corpus(spark, n=600):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 4)))
    docs, labels, truth = [], [], {}
    for i in range(n):
        text = " ".join(word() for _ in range(r.randint(5, 120)))
        words = text.split()
        for k in range(9, len(words), 10):
            words[k] += "."
        bad = i % 5 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["zzbad", "zzworse"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
        truth[i] = bad
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy_and_location(spark):
    docs, labels, truth = corpus(spark)
    rows = toxicity.op2_toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in held:
        if r["predicted"] and truth[r["doc_id"]]:
            spans = [tuple(map(int, s.split(":"))) for s in r["offending"].split(",")]
            assert any("zz" in texts[r["doc_id"]][a:b] for a, b in spans)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    import zlib

    docs, labels, _ = corpus(spark, 200)
    other = labels.rdd.map(lambda r: (r[0], r[1], 1 - r[2]) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else tuple(r)).toDF("doc_id long, quality int, toxic int")
    a = {r["doc_id"]: r["score"] for r in toxicity.op2_toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.op2_toxicity(docs, other).collect()}
    assert a == b


def test_noisy_or_gradient_reaches_planted_words():
    bags = [([[1, 2], [3, 9]], 1), ([[1, 2], [3]], 0), ([[2], [9]], 1), ([[2, 3]], 0)] * 20
    model = toxicity.fit(bags)
    assert max(model.weights, key=model.weights.get) == 9


def test_length_alone_is_not_toxic(spark):
    docs, labels, _ = corpus(spark)
    clean = " ".join(["abba gaba head."] * 20_000)
    more = spark.createDataFrame([(1001, clean), (1002, f"{clean} head zzbad gaba.")], docs.schema)
    rows = {r["doc_id"]: r for r in toxicity.op2_toxicity(docs.union(more), labels).where("doc_id > 1000").collect()}
    assert rows[1001]["score"] < 0.01 and rows[1001]["offending"] == ""
    assert rows[1002]["predicted"] == 1 and rows[1002]["offending"].count(":") == 1
    assert [r["doc_id"] for r in toxicity.reject_toxic(docs.union(more), labels).where("doc_id > 1000").collect()] == [1001]


def test_a_sentence_without_features_counts_for_nothing():
    score = toxicity.Scorer(toxicity.Model(-3.0, {toxicity.zlib.crc32(b"zz") % toxicity.DIM: 4.0}))
    assert score("a b. " * 20_000) == (0.0, "") and score("zz") == score("zz" + ". a b" * 20_000)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1), (9, 0, 1), (10, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    rows = toxicity.op2_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.op2_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.op2_toxicity(empty(spark), labels).count() == 0
    assert toxicity.reject_toxic(docs, labels).columns == docs.columns


def slow_score(text, model):
    """Noisy-or over sentences from the model's numbers: 1 - prod (1 + e^b) / (1 + e^z), over sentences with a learned feature."""
    keep = 1.0
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        found = {f for w in re.findall(r"[^\W\d_]+", sentence) for f in toxicity.features(w)} & model.weights.keys()
        if found:
            z = model.bias + sum(model.weights[f] for f in found)
            keep *= (1 + math.exp(model.bias)) / (1 + math.exp(z))
    return 1 - keep


def test_scores_match_brute_force(spark):
    docs, labels, _ = corpus(spark)
    model = toxicity.train(docs, labels)
    assert model.weights
    both = docs.unionByName(documents(spark).where("text is null or length(text) < 1000").select("doc_id", "text"))
    for r in toxicity.with_toxicity(both, model).collect():
        assert math.isclose(r["toxicity"]["score"], slow_score(r["text"] or "", model), rel_tol=1e-9, abs_tol=1e-12)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels, _ = corpus(spark)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bags: seen.append(bags))
    for most in (1 << 30, 20_000, 0):
        toxicity.train(docs, labels, most=most)
    sizes = [sum(4 * (len(s) + 1) for bag, _ in bags for s in bag) for bags in seen]
    assert len(seen[0]) > 400 and 0 < len(seen[1]) < len(seen[0]) and sizes[1] <= 20_000 and not seen[2]


def test_a_workers_words_stay_within_their_bound(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(3000)]
    model = toxicity.Model(-9.0, {i: 4.0 for w in words[::7] for i in toxicity.features(w)})
    texts = [" ".join(words[i : i + 30]) + ". " + "y" * 5000 + " " + words[0] for i in range(0, 3000, 20)]
    want = [toxicity.Scorer(model)(t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHE", 200)
    own = toxicity.Scorer(model)
    for text, score in zip(texts, want, strict=True):
        assert own(text) == score and len(own.known) + len(own.old) <= 200 and max(map(len, own.known)) <= toxicity.LONG
