import hashlib
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vqloom.llm import linededup, queries

from .rows import documents, empty


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    lines = sorted({((r["doc_id"] is None, r["doc_id"] or 0, hash_, n), line) for r, hash_ in rows for n, line in enumerate((r["text"] or "").split("\n")) if line.strip(" ")})
    out = set()
    for i, (rank, line) in enumerate(lines):
        w = line.split(" ")
        for _, other in lines[:i]:
            v = other.split(" ")
            if line == other or min(len(w), len(v)) >= 5 and abs(len(w) - len(v)) < 2 and distance(w, v) <= 1:
                out.add(rank)
                break
    return out


def check(docs):
    rows = [(r, r["h"]) for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = {(r["no_id"], r["doc_id"] or 0, r["text_hash"], r["line_no"]) for r in (x["rank"] for x in linededup.duplicate_lines(docs).collect())}
    assert got == brute(rows)
    return got


def test_random_lines_match_brute_force(spark):
    r = random.Random(4)
    base = [[r.choice("abc") for _ in range(r.randint(1, 9))] for _ in range(25)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 5)):
            w = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(w) + 1)
                act = r.random()
                if act < 0.33:
                    w.insert(k, r.choice("xyz"))
                elif act < 0.66 and len(w) > 1:
                    del w[min(k, len(w) - 1)]
                else:
                    w[min(k, len(w) - 1)] = r.choice("xyz")
            lines.append(" ".join(w))
        texts.append((i, "\n".join(lines)))
    assert check(spark.createDataFrame(texts, "doc_id long, text string"))


def test_odd_rows(spark):
    docs = documents(spark)
    check(docs)
    rows = linededup.op3_line_dedup(docs).collect()
    assert len(rows) == docs.count()
    assert linededup.without_duplicate_lines(docs).columns == docs.columns
    assert linededup.op3_line_dedup(empty(spark)).count() == 0


def test_a_document_of_half_a_million_lines(spark):
    lines = [f"line {i % 1000} of a very long text {i % 1000}" for i in range(500_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "line 7 of a very long text 7")], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in linededup.op3_line_dedup(docs).collect()}
    assert time.time() - began < 60
    # Lines of the first thousand differ in two words, so each stays once.
    assert rows[1]["n_dropped"] == 499_000 and rows[2]["n_dropped"] == 1
    assert rows[1]["kept_sha256"] == hashlib.sha256("\n".join(lines[:1000]).encode()).hexdigest()


def test_texts_lose_just_these_lines(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nx\n\nx"), (2, "a b c d f\ny"), (3, None), (4, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.without_duplicate_lines(docs).collect()}
    assert got == {1: "a b c d e\nx\n", 2: "y", 3: None, 4: ""}


def test_oracle(spark):
    frame = pd.DataFrame([(1, "a b c d e\nx\n\nx"), (2, "a b c d f\ny"), (3, None), (4, "x"), (5, "a b c d")], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", frame)
    want = sorted(con.execute(queries.ORACLES["op3_line_dedup"]).fetchall())
    got = sorted(map(tuple, linededup.op3_line_dedup(spark.createDataFrame([(int(a), b) for a, b in frame.itertuples(index=False)], "doc_id long, text string")).collect()))
    assert got == want


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_joins_beyond_the_broadcast_bound(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "FEW", 0)
    monkeypatch.setattr(linededup, "HOT", hot)
    docs = documents(spark).where("text is null or length(text) < 1000")
    assert check(docs)
    assert linededup.op3_line_dedup(docs).count() == docs.count()
