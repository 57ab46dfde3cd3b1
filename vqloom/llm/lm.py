"""LM scoring with a hashed maximum-entropy model.

The softmax is factored by word class in two steps: P(w | context) = P(group | context) * P(class | group, context) * P(w | class), with
GROUPS groups of CLASSES classes. Both context factors are maximum-entropy models over n-gram and skip features of the words before: the
class of the last word, the class of the one before it (skip), both classes together and the last word itself; the latter two are
hashed, and within a group they are hashed anew. P(w | class) is add-one over the class's counts in the training fold.

Groups hold words that keep the same company: each word is projected at random onto SIGNATURE numbers, each document onto the sum over
its words, and a word's signature is the mean over the documents it is in. Signatures of the common words are clustered, and each cluster is
cut by frequency into groups, and each group into classes, of equal shares of all tokens. Words that are not common make the last
group, whose classes are hash buckets.

Training walks all training documents ROUNDS times by distributed gradient updates: each task steps through its share in sparse
minibatches from the same weights, and the moves of every weight row are averaged over the tasks that met it, each by the tokens that
it met there. The result depends on how documents are dealt over tasks (one for about TASK tokens), but on no random choice.

Counts and signatures cover the whole training fold. Texts are read into word numbers once and kept in the shared folder. The COMMON most
frequent words (a fixed bound) travel to the workers, which score them in numpy batches; all other words of a document are joined to
the count table by word, so neither the table's size nor a hot word matters: hot words never enter the join.

Base score: add-one unigram, sum of log10((c + 1) / (N + V + 1)).

Defined results: a null text is the empty text, which holds the end token only; without training documents N = V = 0
and the formulas hold; rows that repeat an id and a text are scored alike, each with its own row; null ids are held out or not by
the checksum of the empty string.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_bucket, stored, whole_text

GROUPS, CLASSES = 16, 16
CODES = GROUPS * CLASSES
#: Classes of the last group: hash buckets of the words that are not common.
HASHED = CLASSES
COMMON = 100_000
#: Longer words (bytes) are never common.
LONGEST = 200
SIGNATURE, CLUSTERS = 8, 8
ROUNDS, BATCH, RATE = 2, 8192, 0.5
LIMIT = 20.0
BLOCKS, FAN = 16, 64
#: Training tokens of a task, and tokens that are put together before they are worked on.
TASK, HELD = 4_000_000, 1 << 16
FLUSH = 200_000
#: No word starts with white space, so this stands for the end.
END = b"\n"
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), c: counts of the tokens of all rows; each task sends a word once for each FLUSH distinct ones."""

    def run(batches):
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "tf"])
            held.clear()
            return batch

        for batch in batches:
            for cell in batch.column(0):
                held.update(tokens(cell.as_py()))
                if len(held) > FLUSH:
                    yield out()
        if held:
            yield out()

    return docs.select(whole_text(text).cast("binary").alias("t")).mapInArrow(run, "word binary, tf long").groupBy("word").agg(F.sum("tf").alias("c"))


def hashed_class(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(HASHED)).cast("int")


def common_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most `most`, and the end token in any case; by count, then word.

    A histogram of rounded logarithms of the counts gives the least count that keeps to the bound, so only words that are kept travel.
    """
    grade = F.floor(F.log2("c") * 16).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"]):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["grade"]
    wanted = F.col("word") == F.lit(END)
    rows = counts.where(wanted if least is None else wanted | ((grade >= least) & (F.octet_length("word") <= LONGEST))).collect()
    found = {bytes(r["word"]): r["c"] for r in rows}
    found.setdefault(END, 0)
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def numbered(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, text_hash, train, numbers (32-bit, packed) and rare (word, tf): a common word's place, or -1 - bucket for any other. Each text is read once."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    kept = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), (fold_bucket(F.col("doc_id"), 7) != 2).alias("train"), whole_text().cast("binary").alias("t"))
    word = pa.struct([("word", pa.binary()), ("tf", pa.int64())])

    def run(batches):
        place, buckets = {w: i for i, w in enumerate(sent.value)}.get, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                packed, found, times, ends = [], [], [], [0]
                for cell in part.column(3):
                    own = tokens(cell.as_py())
                    at = np.fromiter(map(place, own, repeat(-1)), np.int32, len(own))
                    odd = np.flatnonzero(at < 0).tolist()
                    if odd:
                        rare = [own[i] for i in odd]
                        if len(buckets) > FLUSH:
                            buckets.clear()
                        count = Counter(rare)
                        for w in count:
                            if w not in buckets:
                                buckets[w] = -1 - xxhash.xxh64_intdigest(w, 42) % HASHED
                        at[odd] = [buckets[w] for w in rare]
                        found += count.keys()
                        times += count.values()
                    packed.append(at.tobytes())
                    ends.append(len(found))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(times, pa.int64())], fields=list(word)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(packed, pa.binary()), lists], ["doc_id", "text_hash", "train", "numbers", "rare"])

    return kept.mapInArrow(run, "doc_id long, text_hash long, train boolean, numbers binary, rare array<struct<word: binary, tf: long>>")


def gathered(cells, held: int = HELD):
    """Packed numbers of documents as (numbers, starts) arrays, of `held` tokens or more together."""
    parts, starts, n = [], [], 0
    for cell in cells:
        own = np.frombuffer(cell, "<i4")
        parts.append(own)
        starts.append(n)
        n += len(own)
        if n >= held:
            yield np.concatenate(parts), np.array(starts)
            parts, starts, n = [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(starts)


def add_up(rows: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of 32-bit arrays by block, from rows (block, salt: the sender, data); level by level, FAN senders at a time, so that no task meets more."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["data"].iloc[0]) // 4, np.float64)
        for x in pdf["data"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "salt": pdf["salt"].iloc[:1], "data": [total.astype(np.float32).tobytes()]})

    while True:
        tasks = -(-tasks // FAN)
        rows = rows.withColumn("salt", F.col("salt") % tasks).groupBy("block", "salt").applyInPandas(add, "block int, salt int, data binary")
        if tasks <= 1:
            return {r["block"]: np.frombuffer(r["data"], np.float32) for r in rows.collect()}


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _blocks(data: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(data.astype(np.float32).ravel(), BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([_task()] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "salt", "data"])


def _joined(found: dict[int, np.ndarray], shape: tuple) -> np.ndarray:
    return np.concatenate([found[i] for i in range(BLOCKS)]).reshape(shape) if found else np.zeros(shape, np.float32)


def signatures(texts: DataFrame, words: list[bytes], tasks: int) -> np.ndarray:
    """(words, SIGNATURE): the sum, over its occurrences, of the unit vector of a common word's document."""
    h = np.array([xxhash.xxh64_intdigest(w, 7) & 0xFF for w in words], np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(np.unpackbits(h[:, None], axis=1).astype(np.float32)[:, :SIGNATURE] * 2 - 1)

    def run(batches):
        table = np.vstack([sent.value, np.zeros((1, SIGNATURE), np.float32)])  # the last row is for other words
        total, any_ = np.zeros((len(table), SIGNATURE)), False
        for batch in batches:
            for n, starts in gathered((c.as_py() for c in batch.column(0)), 1 << 19):
                any_ = True
                n = np.where(n < 0, len(table) - 1, n)
                own = np.add.reduceat(table[n], starts, axis=0)
                own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
                lengths = np.diff([*starts, len(n)])
                for d in range(SIGNATURE):
                    total[:, d] += np.bincount(n, np.repeat(own[:, d], lengths), len(table))
        if any_:
            yield _blocks(total[:-1])

    return _joined(add_up(texts.mapInArrow(run, "block int, salt int, data binary"), tasks), (len(words), SIGNATURE))


def clusters(vectors: np.ndarray, weights: np.ndarray, k: int = CLUSTERS, rounds: int = 20) -> np.ndarray:
    """Cluster of each vector by direction: k-means from the heaviest one and those farthest from the ones before."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    centres = [unit[int(weights.argmax())]]
    heavy = np.argsort(-weights, kind="stable")[:1000]
    while len(centres) < min(k, len(unit)):
        far = np.max(unit[heavy] @ np.array(centres).T, axis=1)
        centres.append(unit[heavy[int(far.argmin())]])
    c = np.array(centres)
    own = np.zeros(len(unit), np.int64)
    for _ in range(rounds):
        own = (unit @ c.T).argmax(axis=1)
        for i in range(len(c)):
            total = (unit[own == i] * weights[own == i, None]).sum(axis=0)
            if np.linalg.norm(total) > 0:
                c[i] = total / np.linalg.norm(total)
    return own


def assigned(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Code (group * CLASSES + class) of each common word: clusters share the groups by their tokens, words are cut by falling count."""
    mass = np.maximum(counts.astype(float), 1e-3)
    share = np.bincount(own, mass) / mass.sum() * (GROUPS - 1)
    live = np.flatnonzero(share)
    groups = np.zeros(len(share), np.int64)
    groups[live] = 1
    while groups.sum() < GROUPS - 1:
        groups[live[int((share[live] / groups[live]).argmax())]] += 1
    code, first = np.zeros(len(counts), np.int64), 0

    def cut_up(members: np.ndarray, parts: int) -> np.ndarray:
        """Part of each member, by the share of tokens before it; numbers without gaps."""
        before = np.cumsum(mass[members]) - mass[members]
        return np.unique(np.minimum((before / mass[members].sum() * parts).astype(np.int64), parts - 1), return_inverse=True)[1]

    for i in live:
        members = np.flatnonzero(own == i)
        members = members[np.argsort(-mass[members], kind="stable")]
        part = cut_up(members, int(groups[i]))
        for g in range(int(part.max()) + 1):
            inside = members[part == g]
            code[inside] = (first + g) * CLASSES + cut_up(inside, CLASSES)
        first += int(groups[i])
    return code


class Vocabulary:
    """The common words with their codes, and the totals that every worker needs."""

    def __init__(self, common: list[tuple[bytes, int]], own: np.ndarray, total: int, kinds: int, hashed: list[tuple[int, int]]):
        self.words = [w for w, _ in common]
        self.counts = np.array([c for _, c in common], np.int64)
        self.total, self.kinds = total, kinds
        codes = assigned(self.counts, own)
        #: Code by number + HASHED.
        self.code = np.concatenate([CODES - CLASSES + np.arange(HASHED)[::-1], codes]).astype(np.uint16)
        #: Counts, kinds and one share for the unknown, for each hash bucket.
        self.sizes = [n + v + 1 for n, v in hashed]
        share = np.bincount(codes, self.counts + 1, CODES)
        self.inner = np.concatenate([np.zeros(HASHED), np.log10((self.counts + 1) / share[codes])])
        self.base = np.concatenate([np.zeros(HASHED), np.log10((self.counts + 1) / (total + kinds + 1))])
        self.known = np.concatenate([np.zeros(HASHED, bool), self.counts > 0])
        used = np.zeros(CODES, bool)
        used[self.code] = True
        #: Added to the logits: nothing goes to groups and classes without words.
        self.closed = np.where(used.reshape(GROUPS, CLASSES), 0, -1e9).astype(np.float32)
        self.shut = np.where(used.reshape(GROUPS, CLASSES).any(axis=1), 0, -1e9).astype(np.float32)
        #: Hashed rows grow with the words that travel.
        self.features = 1 << min(15, max(10, math.ceil(math.log2(len(common) + 1)) - 2))


class Model:
    """Weight rows of both factors; row 0 of the first and the first GROUPS of the second are biases."""

    def __init__(self, vocabulary: Vocabulary):
        self.features = vocabulary.features
        plain = 2 * (CODES + 1)
        self.one = np.zeros((1 + plain + self.features, GROUPS), np.float32)
        self.two = np.zeros((GROUPS * (1 + plain) + self.features, CLASSES), np.float32)


def contexts(code: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, and of each place the codes of the word before and the one before that, and the number (from 1) of the word before; CODES and 0 stand for the beginning."""
    own = code[numbers + HASHED]
    one, two = np.full(len(own), CODES, np.uint16), np.full(len(own), CODES, np.uint16)
    last = np.zeros(len(own), np.int32)
    one[1:], two[2:], last[1:] = own[:-1], own[:-2], numbers[:-1] + HASHED + 1
    one[starts], two[starts], last[starts] = CODES, CODES, 0
    two[starts[starts + 1 < len(own)] + 1] = CODES
    return own, one, two, last


def feature_rows(features: int, one: np.ndarray, two: np.ndarray, last: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """(5, tokens) weight rows: bias, last class, class before it, both (hashed), last word (hashed); with `group`, those of that group."""
    n = CODES + 1
    pair = one.astype(np.uint64) * np.uint64(n) + two
    word = last.astype(np.uint64) + np.uint64(1 << 32)
    if group is None:
        bias, base, hashed = np.zeros(len(one), np.int64), 1, 1 + 2 * n
    else:
        g = group.astype(np.uint64) << np.uint64(40)
        pair, word = pair + g, word + g
        bias, base, hashed = group.astype(np.int64), GROUPS + group.astype(np.int64) * (2 * n), GROUPS * (1 + 2 * n)
    top = lambda x: hashed + (((x + np.uint64(1)) * MIX) >> np.uint64(40) & np.uint64(features - 1)).astype(np.int64)
    return np.stack([bias, base + one, base + n + two, top(pair), top(word)]).astype(np.uint16)


def logits(weights: np.ndarray, rows: np.ndarray, shut: np.ndarray) -> np.ndarray:
    """Sums of bounded weights (LIMIT each), so that no exponential overflows."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += shut
    return z


def step(weights: np.ndarray, scale: np.ndarray, met: np.ndarray, rows: np.ndarray, shut: np.ndarray, target: np.ndarray) -> None:
    """One sparse Adagrad step in place: only rows of features that occur are touched, and `met` counts their tokens."""
    g = logits(weights, rows, shut)
    np.exp(g, out=g)
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(target)), target] -= 1
    new = np.empty(len(target), bool)
    new[0] = True
    for f in rows:
        order = f.argsort(kind="stable")
        ordered = f.take(order)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        at, total = ordered.take(starts).astype(np.intp), np.add.reduceat(g.take(order, axis=0), starts, axis=0)
        met[at] += np.diff(starts, append=len(f))
        size = scale.take(at) + np.einsum("ij,ij->i", total, total)
        scale[at] = size
        total *= (RATE / np.sqrt(size + 1.0))[:, None]
        moved = weights.take(at, axis=0)
        moved -= total
        np.clip(moved, -LIMIT, LIMIT, out=moved)
        weights[at] = moved


def train_round(texts: DataFrame, model: Model, vocabulary: Vocabulary, tasks: int) -> None:
    """Moves the model by one walk over all rows of `texts` (column numbers)."""
    sent = texts.sparkSession.sparkContext.broadcast((model, vocabulary))
    split = model.one.size, model.two.size
    width = GROUPS + 1

    def walk(batches):
        start, words = sent.value
        one, two = start.one.copy(), start.two.copy()
        scales, met = [np.zeros(len(w), np.float32) for w in (one, two)], [np.zeros(len(w), np.float32) for w in (one, two)]
        seen = False
        for n, starts in gathered(c.as_py() for batch in batches for c in batch.column(0)):
            own, a, b, last = contexts(words.code, n, starts)
            for lo in range(0, len(own), BATCH):
                at = slice(lo, lo + BATCH)
                group, cls = own[at] // CLASSES, own[at] % CLASSES
                step(one, scales[0], met[0], feature_rows(start.features, a[at], b[at], last[at]), words.shut, group)
                step(two, scales[1], met[1], feature_rows(start.features, a[at], b[at], last[at], group), words.closed[group], cls)
            seen = True
        if seen:
            moves = [np.hstack([(w - old) * m[:, None], m[:, None]]) for w, old, m in ((one, start.one, met[0]), (two, start.two, met[1]))]
            yield _blocks(np.concatenate([m.ravel() for m in moves]))

    found = add_up(texts.mapInArrow(walk, "block int, salt int, data binary"), tasks)
    if found:
        total = np.concatenate([found[i] for i in range(BLOCKS)])
        cut_at = split[0] // GROUPS * width
        for weights, part in ((model.one, total[:cut_at]), (model.two, total[cut_at:])):
            part = part.reshape(-1, width)
            weights += part[:, :-1] / np.maximum(part[:, -1:], 1)
    sent.unpersist()


def log_scores(model: Model, vocabulary: Vocabulary, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 P of each document's tokens, without the share of words that are not common within their class."""
    own, a, b, last = contexts(vocabulary.code, numbers, starts)
    out = vocabulary.inner[numbers + HASHED]
    for lo in range(0, len(own), BATCH):
        at = slice(lo, lo + BATCH)
        group, cls = own[at] // CLASSES, own[at] % CLASSES
        total = np.zeros(len(group))
        for weights, rows, shut, target in ((model.one, feature_rows(model.features, a[at], b[at], last[at]), vocabulary.shut, group), (model.two, feature_rows(model.features, a[at], b[at], last[at], group), vocabulary.closed[group], cls)):
            z = logits(weights, rows, shut)
            own_z = z[np.arange(len(z)), target]
            total += own_z - np.log(np.exp(z, out=z).sum(axis=1, dtype=np.float64))
        out[at] += total / math.log(10)
    return np.add.reduceat(out, starts)


def scored_parts(texts: DataFrame, model: Model, vocabulary: Vocabulary) -> DataFrame:
    """For each row one part with its sums over common words, and one for each other distinct word.

    The word of a sum part is unique and never counted, so that these rows spread evenly over a join by word.
    """
    sent = texts.sparkSession.sparkContext.broadcast((model, vocabulary))
    names = ["doc_id", "text_hash", "word", "tf", "n", "n_known", "base", "inner"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def sums(cells) -> list[np.ndarray]:
        model, words = sent.value
        out = []
        for n, starts in gathered(cells):
            at = n + HASHED
            each = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            out.append((np.diff([*starts, len(n)]), each(words.known[at].astype(np.int64)), each(words.base[at]), log_scores(model, words, n, starts)))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, hashes, rare = part.column(0), part.column(1), part.column(3)
                found, lengths = rare.flatten(), rare.value_lengths().to_numpy()
                # One row for each document's sums, then one for each of its other words.
                owner = np.repeat(np.arange(part.num_rows), lengths + 1)
                first = np.cumsum(lengths + 1) - lengths - 1
                other = np.ones(len(owner), bool)
                other[first] = False
                own = [END + h.as_py().to_bytes(8, "big", signed=True) for h in hashes]
                place = np.empty(len(owner), np.int64)
                place[first], place[other] = np.arange(len(own)), len(own) + np.arange(int(lengths.sum()))
                words = pa.concat_arrays([pa.array(own, pa.binary()), found.field(0)]).take(pa.array(place))
                tf = pa.concat_arrays([pa.array([0] * len(own), pa.int64()), found.field(1)]).take(pa.array(place))
                out = [ids.take(pa.array(owner)), hashes.take(pa.array(owner)), words, tf]
                for kind, column in zip(kinds[4:], sums(c.as_py() for c in part.column(2)), strict=True):
                    cells = np.zeros(len(owner), np.int64 if kind == pa.int64() else np.float64)
                    cells[first] = column
                    out.append(pa.array(cells, kind))
                yield pa.RecordBatch.from_arrays(out, names)

    return texts.select("doc_id", "text_hash", "numbers", "rare").mapInArrow(run, "doc_id long, text_hash long, word binary, tf long, n long, n_known long, base double, inner double")


def fit(docs: DataFrame, rounds: int = ROUNDS, common: int = COMMON) -> tuple[Model, Vocabulary, DataFrame, DataFrame]:
    """Model, vocabulary, counts and the numbered documents."""
    counts = cut(word_counts(docs.where(fold_bucket(F.col("doc_id"), 7) != 2)))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = common_words(counts, common)
    words = [w for w, _ in top]
    texts = stored(numbered(docs, words), "numbers", "zstd")
    # Fewer, longer tasks: what a task sends has the size of the model, whatever it read.
    train = texts.where("train").select("numbers")
    tasks = max(total // TASK, docs.sparkSession.sparkContext.defaultParallelism)
    train = train.coalesce(int(tasks))
    own = clusters(signatures(train, words, tasks), np.array([c for _, c in top], float))
    sent = docs.sparkSession.createDataFrame([(w,) for w in words], "word binary")
    # At most `common` words of LONGEST bytes each.
    rest = counts.join(F.broadcast(sent), "word", "left_anti")
    found = {r["k"]: (r["n"], r["v"]) for r in rest.groupBy(hashed_class(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    vocabulary = Vocabulary(top, own, total, kinds, [found.get(k, (0, 0)) for k in range(HASHED)])
    model = Model(vocabulary)
    for _ in range(rounds):
        train_round(train, model, vocabulary, tasks)
    return model, vocabulary, counts, texts


def op10_lm(docs: DataFrame, rounds: int = ROUNDS, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    return scored(*fit(docs, rounds, common))


def scored(model: Model, vocabulary: Vocabulary, counts: DataFrame, texts: DataFrame) -> DataFrame:
    parts = scored_parts(texts, model, vocabulary).join(counts, "word", "left")
    c, odd = F.coalesce("c", F.lit(0)), F.col("tf") > 0
    size = F.element_at(F.array(*[F.lit(float(s)) for s in vocabulary.sizes]), hashed_class(F.col("word")) + 1)
    unit = F.lit(float(vocabulary.total + vocabulary.kinds + 1))
    rows = parts.groupBy("doc_id", "text_hash").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("copies"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(odd, F.col("tf") * F.log10((c + 1) / unit)).otherwise(0.0)).alias("base"),
        F.sum(F.col("inner") + F.when(odd, F.col("tf") * F.log10((c + 1) / size)).otherwise(0.0)).alias("inner"),
    )
    # Rows that repeat id and text met in one group; each gets its row back.
    each = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(
        "doc_id",
        (fold_bucket(F.col("doc_id"), 7) == 2).alias("held_out"),
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("inner") / F.col("copies")).alias("score"),
    )
