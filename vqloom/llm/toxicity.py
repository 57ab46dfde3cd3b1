"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels.

A document is a bag of sentences. With z = bias + sum of the weights of its distinct words and word beginnings, a sentence is clean with
probability 1 - p = (1 + exp(bias)) / (1 + exp(z)): relative to a sentence without any learned feature, which counts for nothing however
many there are. The document is toxic unless no sentence is: 1 - prod(1 - p). Weights come from document labels alone,
and the same sentence scores then point at the offending sentences.

Defined results: a null or empty text has no sentence and scores 0; labels of unknown or repeated documents are
joined by id, and a document with several labels counts once for each; without labels of both kinds nothing is learned: the bias stays
very low, so nothing is predicted toxic.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aged, fold_bucket, stored, whole_text

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
DIM = 1 << 18
BEGINNINGS = (3, 5, 7)
#: A label sample of this many documents, and bytes of packed features, at most fits the weights; everything is scored.
TRAIN_CAP = 8000
TRAIN_BYTES = 256 << 20
#: Words of at most LONG letters that a worker keeps with their weights.
CACHE, LONG = 60_000, 64
#: The bias stays above this; features with log odds over SURE of being in toxic documents only are drawn to a weight that outweighs it.
LOWEST, SURE = -9.0, 3.0


def features(word: str) -> set[int]:
    """The hashed word, and its hashed beginnings, which words of one family share."""
    return {zlib.crc32(word.encode()) % DIM, *(zlib.crc32(f"{word[:n]}*".encode()) % DIM for n in BEGINNINGS if len(word) >= n)}


def word_ids(sentence: str) -> list[int]:
    """Distinct features of a lower-cased sentence."""
    return list({i for w in set(WORD.findall(sentence)) for i in features(w)})


@dataclass
class Model:
    bias: float = -12.0
    weights: dict[int, float] = field(default_factory=dict)


def fit(bags: list[tuple[list, int]], steps: int = 300, rate: float = 0.1, l2: float = 1e-5, least: int = 4, score: float = 4.0) -> Model:
    """Noisy-or likelihood by Adam over the features that are more common in toxic documents than chance allows.

    A bag is a list of sentences, each a list or array of feature numbers. A feature is kept if it is in `least` documents and its toxic ones exceed the expected number by `score` standard deviations.
    Where other words of the same documents explain the labels, a nearly pure feature keeps the weight that its own documents call for.
    Weights are not negative: a harmless word is no evidence against an offending one in the same sentence.
    """
    bags = [([np.asarray(s, np.int32) for s in bag], label) for bag, label in bags if any(len(s) for s in bag)]
    y = np.array([label for _, label in bags], float)
    if not bags or not 0 < y.sum() < len(y):
        return Model()
    seen, toxic = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64)
    for bag, label in bags:
        own = np.unique(np.concatenate(bag))
        seen[own] += 1
        toxic[own] += int(label > 0)
    share = y.mean()
    kept = np.flatnonzero((seen >= least) & (toxic - seen * share >= score * np.sqrt(seen * share * (1 - share))))
    if not len(kept):
        return Model()
    place = np.full(DIM, -1, np.int32)
    place[kept] = np.arange(len(kept))
    sentences = [s for bag, _ in bags for s in bag]
    # Only the kept features of a sentence are held on.
    found = [(at := place[s])[at >= 0] for s in sentences]
    flat = np.concatenate(found)
    owner = np.repeat(np.arange(len(sentences)), [len(s) for s in found])
    doc = np.repeat(np.arange(len(bags)), [len(bag) for bag, _ in bags])
    pure = (toxic[kept] + 0.5) / (seen[kept] + 1)
    prior = np.log(pure / (1 - pure))
    x = np.append(np.ones(len(kept)), -6.0)  # weights, then the bias
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        z = x[-1] + np.bincount(owner, x[flat], len(sentences))
        p = 1 / (1 + np.exp(-z))
        none = -np.bincount(doc, np.logaddexp(0, z) - np.logaddexp(0, x[-1]), len(bags))  # log of no toxic sentence
        pull = np.where(y > 0, -1 / np.maximum(np.expm1(-none), 1e-6), 1.0)
        gz = pull[doc] * p / len(bags)
        gb = pull[doc] * (p - 1 / (1 + np.exp(-x[-1]))) / len(bags)
        g = np.append(np.bincount(flat, gz[owner], len(kept)) + l2 * np.where(prior > SURE, x[:-1] + LOWEST - prior, x[:-1]), gb.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        x[:-1] = np.maximum(x[:-1], 0)
        x[-1] = min(max(x[-1], LOWEST), -1.0)
    return Model(float(x[-1]), {int(kept[i]): float(x[i]) for i in np.flatnonzero(x[:-1])})


def train(docs: DataFrame, labels: DataFrame, cap: int = TRAIN_CAP, most: int = TRAIN_BYTES) -> Model:
    """Fits on at most `cap` labelled documents outside the held-out fold, the first by a hash of their id, as far as their features fit `most` bytes."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where(F.col("_toxic").isNotNull() & (fold_bucket(F.col("doc_id"), 5) != 0))
    own = own.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(cap)

    @F.pandas_udf("lengths binary, ids binary")
    def bag(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            sentences = [word_ids(s) for s in SENTENCE.findall(t.lower())]
            out.append((np.array([len(s) for s in sentences], np.int32).tobytes(), np.array([i for s in sentences for i in s], np.int32).tobytes()))
        return pd.DataFrame(out, columns=["lengths", "ids"])

    # Bags travel and stay as packed 32-bit numbers: four bytes for each feature of the sample, on the driver too.
    bags = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text")).join(F.broadcast(own), "_id").select("_id", bag("_text").alias("bag"), "_toxic")
    bags = stored(bags, "bags").withColumn("_size", F.octet_length("bag.ids") + F.octet_length("bag.lengths"))
    # The sample's rows only, so one task may order them.
    run = F.sum("_size").over(Window.orderBy(F.xxhash64("_id"), "_id", "_toxic", F.xxhash64("bag.ids")))
    sizes = bags.select("_id", "_toxic", run.alias("_run")).groupBy("_id", "_toxic").agg(F.max("_run").alias("_run")).where(F.col("_run") <= most)
    rows = bags.join(F.broadcast(sizes.select("_id", "_toxic")), ["_id", "_toxic"]).toLocalIterator()
    packed = sorted(((r["_id"], r["_toxic"], bytes(r["bag"]["lengths"]), bytes(r["bag"]["ids"])) for r in rows), key=lambda r: (r[0], r[1], zlib.crc32(r[3])))
    bags = []
    for _, label, lengths, ids in packed:
        ends = np.cumsum(np.frombuffer(lengths, np.int32))
        bags.append((np.split(np.frombuffer(ids, np.int32), ends[:-1]) if len(ends) else [], label))
    return fit(bags)


class Scorer:
    """Scores texts in one Python worker; words are hashed once and kept in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.known, self.old = model, {}, {}

    def weight(self, word: str) -> tuple[tuple[int, float], ...]:
        w = self.old.get(word)
        if w is None:
            w = tuple((i, self.model.weights[i]) for i in sorted(features(word)) if i in self.model.weights)
        if len(word) <= LONG:
            aged(self.known, self.old, CACHE)
            self.known[word] = w
        return w

    def __call__(self, text: str, threshold: float = 0.5) -> tuple[float, str]:
        """The document's score, and `start:end` of each offending sentence in code points."""
        none, spans, known = 0.0, [], self.known
        base, least = math.log1p(math.exp(self.model.bias)), -math.log1p(-threshold)
        low = text.lower()
        if len(low) != len(text):  # a few letters change length in lower case; offsets must not
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        for m in SENTENCE.finditer(low):
            z, hit = self.model.bias, set()
            for word in WORD.findall(m.group()):
                w = known.get(word)
                if w is None:
                    w = self.weight(word)
                if w:
                    for i, x in w:
                        if i not in hit:
                            hit.add(i)
                            z += x
            if hit:
                own = max(z, 0.0) + math.log1p(math.exp(-abs(z))) - base
                none += own
                if own >= least:
                    spans.append(f"{m.start()}:{m.end()}")
        return -math.expm1(-none), ",".join(spans)


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Adds a struct `into` (score, offending) to every row."""

    @F.pandas_udf("score double, offending string")
    def run(cells: pd.Series) -> pd.DataFrame:
        scorer = run_scorer(model)
        return pd.DataFrame([scorer(t) for t in cells], columns=["score", "offending"])

    return docs.withColumn(into, run(whole_text(text)))


_SCORERS: dict[int, Scorer] = {}


def run_scorer(model: Model) -> Scorer:
    key = hash((model.bias, tuple(sorted(model.weights.items()))))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        (fold_bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.offending").alias("offending"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents predicted clean, with their own columns."""
    columns = docs.columns
    scored = with_toxicity(docs, train(docs, labels), into="_vq_toxicity")
    return scored.where(F.col("_vq_toxicity.score") < 0.5).select(*columns)
