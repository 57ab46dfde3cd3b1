"""Line dedup, natively, by a deletion-neighbourhood join within one word edit.

A line is dropped if an earlier line (by doc_id, then line number) is equal, or if both have at least LEAST words and
their word edit distance is 1 (one word changed, put in or left out; at five words that is a similarity of 0.8).
Every variant of a line with one word deleted is emitted as a hashed key: (variant, position, length) meets the lines
that differ in that word; the bare variant meets the lines that lack it. Of each key only the earliest line matters,
so groups are folded by partial aggregates and no pairs inside a group are made. The earliest lines are then
joined back and the distance verified on the words themselves.

Before that an exact prefilter: two lines one edit apart share their first half or their second half (cut by the shorter line's
length), so lines whose halves occur once have no partner and emit no variants.

Defined results: blank lines always stay; shorter lines fall only to equal ones; a null text has no lines and stays null;
rows that repeat both doc_id and text are one document and get the same answer; null ids sort last. Words are split by
single spaces. Lines are identified by 128 hashed bits, prefilters work on 64 of them (a clash only adds candidates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, spread_join, stored, whole_text

LEAST = 5
#: Tables of at most so many short rows are broadcast; beyond that, the keys that hold more than one row in HOT.
FEW = 500_000
HOT = 1000
CHANGED, LONGER, WHOLE = 0, 1, 2
RANK = ("no_id", "doc_id", "text_hash", "line_no")


def _line_id(line: Column) -> Column:
    """128 bits: two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def lines_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every non-blank line: rank (null ids last, doc_id, text hash, line number) and line."""
    whole = whole_text(text)
    # The hash is taken before the text falls into lines, once for each document.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("text_hash"), F.split(whole, "\n").alias("lines"))
    rows = rows.select("doc_id", "text_hash", F.posexplode("lines").alias("line_no", "line"))
    return rows.where(F.trim("line") != "").withColumn("no_id", F.col("doc_id").isNull()).select(F.struct(*RANK).alias("rank"), "line")


def _words(line: Column) -> Column:
    return F.split(line, " ")


def _halves(words: Column, n: Column) -> Column:
    """Keys of both halves, cut for this line as the shorter (length n) and as the longer one (n - 1)."""
    keys = []
    for shorter in (n, n - 1):
        head = F.floor(shorter / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), shorter, F.slice(words, F.lit(1), head)))
        keys.append(F.xxhash64(F.lit("tail"), shorter, F.slice(words, n - (shorter - head) + 1, shorter - head)))
    return F.array(*keys)


def _variants(texts: DataFrame) -> DataFrame:
    """a, kind, key: the neighbourhood of every line (a, line).

    A word sequence is hashed as two sums of 32-bit hashes of its (position, word) pairs, so the hash of a line without word i is
    the running sum before i plus the sum behind i with all positions one less: each variant costs the same, however long the line.
    """
    words = texts.select("a", F.posexplode(_words(F.col("line"))).alias("i", "word")).repartition("a")
    order = Window.partitionBy("a").orderBy("i")
    before, upto, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("a")
    here, back = F.xxhash64("i", "word"), F.xxhash64(F.col("i") - 1, "word")
    lanes = words.select("a", "i", *[f(h).alias(f"{name}{k}") for name, h in (("here", here), ("back", back)) for k, f in enumerate((lambda x: x.bitwiseAND(0xFFFFFFFF), lambda x: F.shiftrightunsigned(x, 32)))])
    rest = [F.coalesce(F.sum(f"here{k}").over(before), F.lit(0)) + F.sum(f"back{k}").over(all_) - F.sum(f"back{k}").over(upto) for k in (0, 1)]
    full = [F.sum(f"here{k}").over(upto) for k in (0, 1)]
    sums = lanes.select("a", "i", F.count("*").over(all_).alias("n"), *[x.alias(f"rest{k}") for k, x in enumerate(rest)], *[x.alias(f"full{k}") for k, x in enumerate(full)])
    kinds = F.array(
        F.struct(F.lit(CHANGED).cast("byte").alias("kind"), F.xxhash64(F.lit(CHANGED), "n", "i", "rest0", "rest1").alias("key")),
        F.struct(F.lit(LONGER).cast("byte").alias("kind"), F.xxhash64(F.lit(LONGER), F.col("n") - 1, "rest0", "rest1").alias("key")),
        F.when(F.col("i") == F.col("n") - 1, F.struct(F.lit(WHOLE).cast("byte").alias("kind"), F.xxhash64(F.lit(LONGER), "n", "full0", "full1").alias("key"))),
    )
    return sums.select("a", F.explode(kinds).alias("k")).where("k is not null").select("a", "k.kind", "k.key")


def _within_one(a: Column, b: Column) -> Column:
    """Word edit distance of at most 1: common head and tail leave one word at most."""
    longest = F.greatest(F.size(a), F.size(b))
    shortest = F.least(F.size(a), F.size(b))

    def run(reverse: bool) -> Column:
        x, y = (F.reverse(a), F.reverse(b)) if reverse else (a, b)
        differs = F.zip_with(F.slice(x, F.lit(1), shortest), F.slice(y, F.lit(1), shortest), lambda p, q: p != q)
        at = F.array_position(differs, True)
        return F.when(at == 0, shortest).otherwise(at.cast("int") - 1)

    return run(False) + run(True) >= longest - 1


def line_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """The rank, hashed identity (a, b) and half keys of every non-blank line, stored: the one pass over all text."""
    n = F.size("w")
    keyed = lines_of(docs, text, doc_id).select("rank", _line_id(F.col("line")).alias("id"), _words(F.col("line")).alias("w"))
    return stored(keyed.select("rank.*", "id.*", F.when(n >= least, F.array_distinct(_halves(F.col("w"), n))).alias("halves")), "lines")


def _meet(left: DataFrame, right: DataFrame, on: list[str], weight: str = "n", how: str = "inner") -> DataFrame:
    return spread_join(left, right, on, weight, FEW, how, HOT)


def _near_lines(docs: DataFrame, index: DataFrame, text: str, doc_id: str) -> DataFrame:
    """a, b of the distinct lines that have an earlier one within one word edit."""
    half = index.where("halves is not null").select("a", F.explode("halves").alias("half"))
    count = F.count("*").alias("n")
    # Repeated lines fold in the aggregate, so a very common line is one row.
    shared = stored(half.groupBy("half").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), count).where("lo <> hi").select("half", "n"), "halves")
    rivals = stored(_meet(half, shared, ["half"], how="left_semi").groupBy("a").agg(count), "rivals")
    firsts = stored(_meet(index, rivals, ["a"], how="left_semi").groupBy("a", "b").agg(F.min(F.struct(*RANK)).alias("rank"), F.lit(1).alias("n")), "firsts")
    texts = stored(_meet(lines_of(docs, text, doc_id), firsts, ["rank"]).groupBy("a", "b").agg(F.min("rank").alias("rank"), F.min("line").alias("line")), "rival-lines")
    keys = stored(_variants(texts), "variants")
    met = stored(keys.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), count).where("lo <> hi").select("key", "n"), "met")
    line = texts.select("a", "b", "rank")
    there = stored(_meet(keys, met, ["key"], how="left_semi").distinct().join(line, "a"), "variants-met")
    # The earliest line on each side of a key: a changed word makes one side, a missing one two.
    who = F.struct("rank", "a", "b")
    sides = stored(there.groupBy("key").agg(F.min(F.when(F.col("kind") != WHOLE, who)).alias("early"), F.min(F.when(F.col("kind") == WHOLE, who)).alias("bare"), count), "sides")
    other = F.when(F.col("kind") == LONGER, F.col("bare")).otherwise(F.col("early"))
    pairs = _meet(there, sides, ["key"]).select("a", "b", "rank", other.alias("other")).where("other.rank < rank").select("a", "b", F.col("other.a").alias("oa"), F.col("other.b").alias("ob")).distinct()
    pairs = stored(pairs, "pairs")
    own = texts.select("a", "b", _words(F.col("line")).alias("w"))
    # Of a line that many later ones come after, the words go to where those are.
    early = stored(pairs.groupBy("oa", "ob").agg(count).join(own.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("w").alias("v")), ["oa", "ob"]), "early-lines")
    sought = _meet(pairs.join(own, ["a", "b"]), early, ["oa", "ob"])
    return sought.where(_within_one(F.col("w"), F.col("v"))).select("a", "b").distinct()


def duplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """The lines to drop: rank (struct) of each."""
    index = line_index(docs, text, doc_id, least)
    near = _near_lines(docs, index, text, doc_id).withColumn("near", F.lit(True))
    # Every occurrence of such a line goes; of a line that merely repeats, all but the first.
    lines = index.groupBy("a", "b").agg(F.min(F.struct(*RANK)).alias("first"), F.count("*").alias("n"))
    fate = stored(lines.join(near, ["a", "b"], "left").where("near or n > 1"), "fates")
    return _meet(index.select(F.struct(*RANK).alias("rank"), "a", "b"), fate, ["a", "b"]).where(F.col("near").isNotNull() | (F.col("rank") != F.col("first"))).select("rank")


def _dropped(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """One row for each document that loses lines: its key and the sorted line numbers."""
    gone = duplicate_lines(docs, text, doc_id, least).distinct()
    by_doc = gone.groupBy(F.col("rank.doc_id").alias("_vq_id"), F.col("rank.text_hash").alias("_vq_hash")).agg(F.array_sort(F.collect_list("rank.line_no")).alias("_vq_gone"))
    return sized(stored(by_doc, "dropped"), FEW)


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of those numbers, in time linear in its length."""

    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    return _bind(F.split(text, "\n"), kept)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """`docs` without its duplicate lines, with the dropped line numbers in `_vq_gone` (null: none)."""
    gone = _dropped(docs, text, doc_id, least)
    whole = whole_text(text)
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("_vq_id")) & (F.xxhash64(whole) == F.col("_vq_hash")), "left").drop("_vq_id", "_vq_hash")
    return joined.withColumn(text, F.when(F.col("_vq_gone").isNull(), F.col(text)).otherwise(without_lines(whole, F.col("_vq_gone"))))


def op3_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_dropped, dropped (comma-joined line numbers), kept_sha256 of the text that remains."""
    out = dedup_lines(docs.select("doc_id", "text"))
    gone = F.coalesce(F.size("_vq_gone"), F.lit(0)).cast("long")
    return out.select("doc_id", gone.alias("n_dropped"), F.coalesce(F.array_join("_vq_gone", ","), F.lit("")).alias("dropped"), F.sha2(whole_text().cast("binary"), 256).alias("kept_sha256"))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """Documents with their own columns, their text without duplicate lines, n_chars counted anew where present."""
    columns = docs.columns
    out = dedup_lines(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)
