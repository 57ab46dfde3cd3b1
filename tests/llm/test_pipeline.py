import corpus_pipeline
from vqloom.llm import linededup, simhash

from .rows import documents, empty


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 9)) for i in range(1, 18)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = documents(spark)  # with columns of clashing names
    tables(spark, tmp_path, docs)
    out = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]
    sizes = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        out = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert out.columns == docs.columns
        sizes.append(out.count())
        if i == 1:
            assert linededup.duplicate_lines(out).count() == 0
        if i == 2:
            roots = [r["root"] for r in simhash.near_dup_groups(out).collect()]
            assert len(roots) == len(set(roots))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]


def test_an_empty_table(spark, tmp_path):
    tables(spark, tmp_path, empty(spark))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
