"""SimHash near-dedup with pivot distance tables.

A document's fingerprint is the majority of the XXH64 bits of its shingles. Documents of one fingerprint are a class, and all later
work is on distinct fingerprints. Two fingerprints within two bits agree in two of their four 16-bit parts at least, so each has six
keys of 32 bits, one for each pair of parts. Every fingerprint carries a table of its Hamming distances to PIVOTS reference
fingerprints, computed once; by the triangle inequality two members of a key whose tables differ by more than the bound in any
coordinate are no link and are discarded inside the group, before a pair is made. Survivors are verified by counting bits.

Keys with more than CROWD members take another exact way: two fingerprints lie within two bits exactly if flipping at most
one bit of each can give the same value, so each member emits itself and its 64 one-bit neighbours. No such value can gather more than
65 fingerprints, and each is paired with the value's smallest one only (stars, not all pairs); the tables discard nothing there.
Components come from rounds of large and small stars.

Defined results: a null or empty text has fingerprint zero, which links like any other; ASCII letters only are lower-cased;
repeated rows share their class; a class of null ids only has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, sized, spread_join, stored, whole_text

SHINGLE, BOUND, PIVOTS = 3, 2, 16
CHUNK = 1 << 15
#: Pairs of 16-bit parts that make a key, and the members up to which a key's members are compared with each other.
PARTS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
CROWD = 64
#: Tables of at most so many short rows are broadcast; beyond that, the keys that hold more than one row in HOT.
FEW = 300_000
HOT = 1000


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles, in bounded memory."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + k - 1]
        grams = zip(*(part[i:] for i in range(k)), strict=False) if len(words) >= k else [words]
        h = np.array([digest(b" ".join(g), 42) for g in grams], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Adds the fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in cells], dtype=np.uint64).astype(np.int64))

    return docs.withColumn(into, run(whole_text(text)))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, from a fixed rule."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % i, 42)).astype(np.int64)) for i in range(n)]


def pivot_table(fp: Column) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def keyed(fps: DataFrame) -> DataFrame:
    """fp, band, key: the six keys of every fingerprint."""
    masks = [_signed(sum(0xFFFF << 16 * p for p in pair)) for pair in PARTS]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.key")


def groups(members: DataFrame) -> DataFrame:
    """band, key, members: an array of fingerprints, sorted, with their distances to the pivots; of keys with CROWD members at most."""
    table = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte").alias(f"p{i}") for i, p in enumerate(pivots())]
    return members.groupBy("band", "key").agg(F.array_sort(F.collect_list(F.struct("fp", *table))).alias("members"))


def survivors(groups: DataFrame, bound: int = BOUND) -> DataFrame:
    """Pairs (a, b), a > b, of members whose tables differ by `bound` at most in every coordinate."""

    def near(x: Column, y: Column) -> Column:
        out = F.lit(True)
        for i in range(PIVOTS):
            out = out & (F.abs(x[f"p{i}"] - y[f"p{i}"]) <= bound)
        return out

    def later(x: Column, i: Column) -> Column:
        rest = F.slice("members", i + 2, F.size("members"))
        return F.transform(F.filter(rest, lambda y: near(x, y)), lambda y: F.struct(y["fp"].alias("a"), x["fp"].alias("b")))

    return groups.select(F.explode(F.flatten(F.transform("members", later))).alias("p")).select("p.a", "p.b")


def crowded(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, by shared one-bit neighbours: each member of a value with the smallest one."""
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = fps.repartition(n).select("fp", F.explode(F.array(*flips)).alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("key", "low")
    return keys.join(least, "key").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def links(fps: DataFrame, bound: int = BOUND) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints `fp` (a stored table), a > b, within 2 bits; enough of them to connect all that are."""
    keys = keyed(fps)
    sizes = stored(keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("*", F.col("n").alias("weight")), "key-sizes")
    met = stored(spread_join(keys, sizes, ["band", "key"], "weight", FEW, hot=HOT), "members")
    pairs = survivors(groups(met.where(F.col("n") <= CROWD)), bound)
    if not met.where(F.col("n") > CROWD).isEmpty():
        many = crowded(stored(met.where(F.col("n") > CROWD).select("fp").distinct(), "crowds"))
        tables = many.select("a", "b", pivot_table(F.col("a")).alias("s"), pivot_table(F.col("b")).alias("t"))
        pairs = pairs.unionByName(tables.where(F.array_max(F.zip_with("s", "t", lambda x, y: F.abs(x - y))) <= bound).select("a", "b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bound).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of a pair (a, b).

    Alternates large stars (each node's greater neighbours to its least one) and small stars (the rest)
    until nothing moves; the number of rounds grows with the logarithm of the longest chain. A node with very many
    neighbours is broadcast rather than gathered.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state, size = None, edges.count()
    while True:
        few = size <= FEW  # then no node has many neighbours, and a round is one plan
        keep = (lambda df, name: df) if few else stored
        meet = (lambda left, right: left.join(right.drop("n"), "a")) if few else (lambda left, right: spread_join(left, right, ["a"], "n", FEW, hot=HOT))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = keep(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "roots")
        large = keep(meet(both, root).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-stars")
        low = keep(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = meet(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            ends = edges.unionByName(edges.select(F.col("b").alias("a"), "b"))  # no edge starts at a root
            return ends.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        state, size = now, now[0]


def near_dup_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, text_hash, root (the least fingerprint of the group) and component_id for every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = stored(with_fingerprint(own.withColumn("text_hash", F.xxhash64(whole_text())), "text").select("doc_id", "text_hash", "fp"), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = stored(components(links(classes.select("fp"))), "roots")
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "least", "root")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("weight"))
    if fits(roots, FEW):
        parts = linked.join(named, "root")
    else:
        parts = spread_join(stored(linked, "linked"), stored(named, "named"), ["root"], "weight", FEW, hot=HOT)
    whole = classes.join(parts.select("fp", "root", "component_id"), "fp", "left")
    whole = stored(whole.select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")), "components")
    return spread_join(marked, whole, ["fp"], "n", FEW, hot=HOT).select("doc_id", "fp", "text_hash", "root", "component_id")


def op6_simhash(docs: DataFrame) -> DataFrame:
    return near_dup_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with its own columns: the smallest doc_id (rows without one last), of several texts with this id the least text hash.

    Of rows that repeat this id and text, one stays. Only the ids and hashes of rows that go (or repeat) meet the documents, so that texts
    stay where they are while that list is small.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    own = near_dup_groups(docs).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    own = stored(own, "grouped")
    first = stored(own.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n")), "firsts")
    fate = spread_join(own, first, ["root"], "n", FEW, hot=HOT).withColumn("goes", rank != F.col("first"))
    fate = fate.where("goes or rows > 1").select(F.col("doc_id").alias("_vq_id"), F.col("text_hash").alias("_vq_hash"), F.col("goes").alias("_vq_goes"))
    fate = sized(stored(fate, "fates"), FEW)
    columns = docs.columns
    joined = docs.join(fate, docs.doc_id.eqNullSafe(F.col("_vq_id")) & (F.xxhash64(whole_text()) == F.col("_vq_hash")), "left")
    once = joined.where("_vq_hash is null").select(*columns)
    again = joined.where("not _vq_goes").select(*[F.col(c) for c in columns], F.col("_vq_hash"))
    pick = again.groupBy("doc_id", "_vq_hash").agg(F.min(F.struct(*[f"`{c}`" for c in columns])).alias("_vq_row")).select("_vq_row.*")
    return once.unionByName(pick)
