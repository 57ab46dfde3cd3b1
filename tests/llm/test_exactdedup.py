import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vqloom.llm import exactdedup

from .rows import documents, empty


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rows]
    out = []
    for r, t in zip(rows, norm, strict=True):
        ids = [x["doc_id"] for x, u in zip(rows, norm, strict=True) if u == t]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r["doc_id"], keep, len(ids), r["doc_id"] == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_folder_and_file(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(docs.collect())
    assert sorted(map(tuple, exactdedup.op8_exact_dedup(spark, str(tmp_path / "documents.parquet")).collect()), key=str) == want
    part = next((tmp_path / "documents.parquet").glob("part-*.parquet"))
    assert exactdedup.op8_exact_dedup(spark, str(part)).count() == spark.read.parquet(str(part)).count()
    empty(spark).write.parquet(str(tmp_path / "none.parquet"))
    assert exactdedup.op8_exact_dedup(spark, str(tmp_path / "none.parquet")).count() == 0


def test_state_over_several_batches(spark, tmp_path):
    docs = documents(spark, partitions=4)
    path = str(tmp_path / "d")
    docs.write.parquet(path)
    assert sorted(map(tuple, exactdedup.exact_dedup(spark, path, files=1).collect()), key=str) == brute(docs.collect())


@pytest.mark.parametrize("few,hot,group", [(100_000, 1000, 10_000), (0, 1, 10_000), (0, 2, 1)])
def test_bytes_are_checked_on_hits(spark, tmp_path, monkeypatch, few, hot, group):
    """With a digest that clashes, texts still fall apart by their bytes, on every path."""
    docs = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "cd"), (4, "e"), (5, "cd"), (None, "cd"), (6, "fgh"), (7, "fgh")], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(exactdedup.F, "sha2", lambda col, n: F.length(col).cast("string"))
    for name, value in (("FEW_HITS", few), ("HOT", hot), ("GROUP", group)):
        monkeypatch.setattr(exactdedup, name, value)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdedup.exact_dedup(spark, str(tmp_path / "d")).collect()), key=str)
    assert got == sorted([(1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (4, 4, 1, True), (5, 3, 3, False), (None, 3, 3, False), (6, 6, 2, True), (7, 6, 2, False)], key=str)


@pytest.mark.parametrize("hot,group", [(1, 1), (3, 2), (1000, 10_000)])
def test_joins_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch, hot, group):
    for name, value in (("FEW_HITS", 0), ("HOT", hot), ("GROUP", group)):
        monkeypatch.setattr(exactdedup, name, value)
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "d"))
    assert sorted(map(tuple, exactdedup.op8_exact_dedup(spark, str(tmp_path / "d")).collect()), key=str) == brute(docs.collect())
