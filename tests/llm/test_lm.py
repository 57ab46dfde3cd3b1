import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vqloom.llm import lm

from .rows import documents, empty


def base(rows):
    held = lambda r: zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 7 == 2
    toks = [[*(r["text"] or "").encode().lower().split(), b"\n"] for r in rows]
    c = Counter(t for r, ts in zip(rows, toks, strict=True) if not held(r) for t in ts)
    n, v = sum(c.values()), len(c)
    return sorted(((r["doc_id"], held(r), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 5)) for r, ts in zip(rows, toks, strict=True)), key=str)


@pytest.mark.parametrize("common", [1, 5, 100_000])
def test_base_scores_match_brute_force(spark, common):
    docs = documents(spark)
    got = lm.op10_lm(docs, common=common).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=str) == base(docs.collect())
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def place(features, key):
    return (key + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 40 & features - 1


def slow_score(text, model, vocabulary, counts, buckets):
    """log10 P of a text, token by token, from the model's numbers."""
    number = {w: i for i, w in enumerate(vocabulary.words)}
    toks = [*text.encode().lower().split(), b"\n"]
    n, out = lm.CODES + 1, 0.0
    ids = [number[t] if t in number else -1 - lm.xxhash.xxh64_intdigest(t, 42) % lm.HASHED for t in toks]
    code = [int(vocabulary.code[i + lm.HASHED]) for i in ids]
    for i, t in enumerate(toks):
        one, two = (code[i - k] if i >= k else lm.CODES for k in (1, 2))
        last = ids[i - 1] + lm.HASHED + 1 if i else 0
        g, c = divmod(code[i], lm.CLASSES)
        pair, word = one * n + two, last + 2**32
        f = model.features
        rows = [0, 1 + one, 1 + n + two, 1 + 2 * n + place(f, pair), 1 + 2 * n + place(f, word)]
        z = [sum(float(model.one[r][k]) for r in rows) + float(vocabulary.shut[k]) for k in range(lm.GROUPS)]
        out += z[g] - math.log(sum(map(math.exp, z)))
        base = lm.GROUPS * (1 + 2 * n)
        rows = [g, lm.GROUPS + g * 2 * n + one, lm.GROUPS + g * 2 * n + n + two, base + place(f, pair + (g << 40)), base + place(f, word + (g << 40))]
        z = [sum(float(model.two[r][k]) for r in rows) + float(vocabulary.closed[g][k]) for k in range(lm.CLASSES)]
        out += z[c] - math.log(sum(map(math.exp, z)))
        if ids[i] >= 0:
            inside = sum(x + 1 for x, y in zip(vocabulary.counts.tolist(), vocabulary.code[lm.HASHED:].tolist(), strict=True) if y == code[i])
            out += math.log((int(vocabulary.counts[ids[i]]) + 1) / inside)
        else:
            out += math.log((counts.get(t, 0) + 1) / (buckets[-1 - ids[i]] + 1))
    return out / math.log(10)


@pytest.mark.parametrize("common", [3, 100_000])
def test_scores_match_brute_force(spark, common):
    docs = documents(spark).where("text is null or length(text) < 1000")
    model, vocabulary, counts, texts = lm.fit(docs, common=common)
    known = {bytes(r["word"]): r["c"] for r in counts.collect()}
    buckets = [0] * lm.HASHED
    for w, c in known.items():
        if w not in vocabulary.words:
            buckets[lm.xxhash.xxh64_intdigest(w, 42) % lm.HASHED] += c + 1
    want = sorted((str(r["doc_id"]), slow_score(r["text"] or "", model, vocabulary, known, buckets)) for r in docs.collect())
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm.scored(model, vocabulary, counts, texts).collect())
    assert [x for x, _ in got] == [x for x, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-4, abs_tol=1e-4) for (_, a), (_, b) in zip(got, want, strict=True))


def test_words_of_a_context_sum_to_one():
    common = [(b"%d" % i, 50 - i) for i in range(40)] + [(lm.END, 3)]
    vocabulary = lm.Vocabulary(common, np.arange(41) % 5, 1000, 60, [(10 * k, 5) for k in range(lm.HASHED)])
    model, r = lm.Model(vocabulary), np.random.default_rng(0)
    model.one[:], model.two[:] = r.normal(size=model.one.shape), r.normal(size=model.two.shape)
    for before in ([], [3], [7, -2]):
        total = 0.0
        for i in range(41):
            numbers = np.array([*before, i], np.int32)
            whole = lm.log_scores(model, vocabulary, numbers, np.array([0]))[0]
            total += 10 ** (whole - (lm.log_scores(model, vocabulary, numbers[:-1], np.array([0]))[0] if before else 0))
        for k in range(lm.HASHED):  # a bucket's words, and its share for the unknown, make one
            numbers = np.array([*before, -1 - k], np.int32)
            whole = lm.log_scores(model, vocabulary, numbers, np.array([0]))[0]
            total += 10 ** (whole - (lm.log_scores(model, vocabulary, numbers[:-1], np.array([0]))[0] if before else 0))
        assert math.isclose(total, 1, rel_tol=1e-5)


def test_clusters_part_words_that_never_meet(spark):
    r = random.Random(2)
    tongues = [["le", "la", "un", "rouge", "vert"], ["the", "a", "one", "red", "green"], ["der", "die", "ein", "rot", "blau"]]
    texts = spark.createDataFrame([(" ".join(r.choice(tongues[i % 3]) for _ in range(20)),) for i in range(90)], "text string").selectExpr("1L AS doc_id", "text")
    words = [w.encode() for t in tongues for w in t] + [lm.END]
    vectors = lm.signatures(lm.numbered(texts, words).select("numbers"), words, 1)
    own = lm.clusters(vectors, np.ones(len(words)), k=3).tolist()
    assert len({tuple(own[i : i + 5]) for i in (0, 5, 10)}) == 3 and all(len(set(own[i : i + 5])) == 1 for i in (0, 5, 10))


def test_model_beats_the_base_on_held_out_text(spark):
    r = random.Random(9)
    tongues = [["le", "la", "un", "rouge", "vert"], ["the", "a", "one", "red", "green"], ["der", "die", "ein", "rot", "blau"]]
    docs = []
    for i in range(600):
        own = tongues[i % 3]
        docs.append((i, " ".join(own[(k % 2) * 2 + r.randrange(2)] if k % 3 else own[4] for k in range(r.randint(5, 60)))))
    rows = [x for x in lm.op10_lm(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect() if x["held_out"]]
    assert len(rows) > 40 and sum(x["score"] for x in rows) > 0.7 * sum(x["base_score"] for x in rows)


def test_empty_cases(spark):
    assert lm.op10_lm(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = spark.createDataFrame([(held, "a b"), (held, "a b"), (held, None)], "doc_id long, text string")
    rows = lm.op10_lm(only).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0)]
