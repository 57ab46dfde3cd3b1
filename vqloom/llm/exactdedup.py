"""Exact dedup by a stateful stream: disk-backed keyed state without expiry, full bytes checked on hits.

A first stream turns every document into a thin row, the only time that its text is normalised and hashed: content locator (file and
row number), identifier and SHA-256. A second stream groups these rows by digest. Its state (RocksDB, no watermark, so nothing
expires) keeps for each digest the stable identifier (smallest doc_id), the number of rows and the locator of one content. Of digests
with more than one row, the content behind the locator is read and every other member's full bytes are compared with it; a large group is
dealt over many tasks, each of which gets that content. Should two texts share a digest, they fall apart by their bytes.
Documents without a copy meet nobody: their thin row is their answer.

Defined results: null counts as empty; repeated rows of one doc_id are members like any other, and each of them that
carries the kept id is kept; rows with a null doc_id join groups but are the kept one only if no row of the group has an id.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fits, shared_path, spread_join, stored, whole_text

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Digests of repeated texts, or rows that carry them, that are broadcast at most; beyond that, the digests that hold more than one row in HOT.
FEW_HITS = 100_000
HOT = 1000
#: Members of a digest that one task compares.
GROUP = 10_000
ROW = "file bigint, row bigint, id bigint, digest binary"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: str | Column = "text") -> Column:
    """Each run of white space as one space; a gate keeps the regex off texts that need none."""
    whole = whole_text(text)
    return F.when(whole.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(whole, f"{SPACE}+", " ")).otherwise(whole)


def located(docs: DataFrame) -> DataFrame:
    """`docs`, read from Parquet files as a batch or a stream, with the content locator of each row: hashed file name and row number."""
    return docs.withColumns({"file": F.xxhash64("_metadata.file_path"), "row": F.col("_metadata.row_index")})


def thin_rows(stream: DataFrame, base: str, text: str = "text", doc_id: str = "doc_id") -> str:
    """Runs a stream of documents to its end; returns the folder of their thin rows (file, row, id, digest)."""
    rows = located(stream).select("file", "row", F.col(doc_id).cast("long").alias("id"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"))
    rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/rows-state").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/rows"


def digest_state(rows: DataFrame, base: str) -> DataFrame:
    """Runs a stream of thin rows to its end; returns digest, keep_id, group_size, locator.

    Interrupted runs restart from their checkpoint; each batch rewrites its own folder, so replays change nothing.
    """
    spark = rows.sparkSession
    state = rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"), F.min(F.struct("file", "row")).alias("locator"))
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
            .foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/digests/batch_no={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest binary, keep_id bigint, group_size bigint, locator struct<file:bigint,row:bigint>, batch bigint"
    path = f"{base}/digests"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema).drop("batch")
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    # A digest that later batches touched again has its newest row.
    return out.groupBy("digest").agg(F.max_by(F.struct("keep_id", "group_size", "locator"), "batch").alias("s")).select("digest", "s.*")


def _members(docs: DataFrame, rows: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    """file, row, id, digest, n, first (whether the locator points here) and normalised text of the rows with a repeated digest."""
    members = spread_join(rows, hits, ["digest"], "weight", FEW_HITS, hot=HOT)
    first = (F.col("file") == F.col("locator.file")) & (F.col("row") == F.col("locator.row"))
    members = stored(members.select("file", "row", "id", "digest", F.col("group_size").alias("n"), first.alias("first")), "members")
    few = fits(members, FEW_HITS)
    met = located(docs).select("file", "row", F.col(text).alias("text")).join(F.broadcast(members) if few else members, ["file", "row"])
    met = met.select("file", "row", "id", "digest", "n", "first", normalised("text").alias("norm"))
    # Few members keep the other texts out of any shuffle, and cheap to find again; many are kept.
    return met if few else stored(met, "member-texts")


def _clashes(met: DataFrame) -> list[bytes]:
    """Digests whose members do not all have the bytes behind the locator. No such pair is known, so the list is short."""
    first = stored(met.where("first").select("digest", "n", F.col("norm").alias("content")), "contents")
    rest = met.where("not first").select("file", "row", "digest", "n", "norm")
    if fits(first, FEW_HITS):
        pairs = rest.join(F.broadcast(first.select("digest", "content")), "digest")
    else:
        parts = F.floor(F.col("n") / GROUP)
        dealt = first.select("digest", "content", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"))
        pairs = rest.withColumn("part", F.pmod(F.xxhash64("file", "row"), parts + 1)).join(dealt, ["digest", "part"])
    return [bytes(r["digest"]) for r in pairs.where("norm <> content").select("digest").distinct().toLocalIterator()]


def checked(docs: DataFrame, rows: DataFrame, state: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every thin row, repeated digests checked byte by byte in `docs`."""
    hits = stored(state.where("group_size > 1").select("*", F.col("group_size").alias("weight")), "hits")
    plain = spread_join(rows, hits.drop("locator"), ["digest"], "weight", FEW_HITS, "left", HOT)
    plain = plain.select("id", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    met = _members(docs, rows, hits, text)
    mixed = _clashes(met)
    if mixed:
        bad = F.col("digest").isin([F.lit(d) for d in mixed])
        own = met.where(bad).groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        plain = plain.where(~bad).unionByName(met.where(bad).join(own, ["digest", "norm"]).select(*plain.columns))
    return plain.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(spark: SparkSession, path: str, text: str = "text", doc_id: str = "doc_id", files: int | None = None) -> DataFrame:
    """The answer for every row of the Parquet table at `path`, streamed `files` files at a time (none: all that are there)."""
    base = shared_path(spark, "exact-dedup")
    rows = thin_rows(documents_stream(spark, path, files), base, text, doc_id)
    thin = spark.readStream.schema(ROW)
    state = digest_state((thin.option("maxFilesPerTrigger", files) if files else thin).parquet(rows), base)
    return checked(spark.read.parquet(path), spark.read.schema(ROW).parquet(rows), state, text)


def documents_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet folder, or the single Parquet file, at `path`."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if status.isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(str(target.getParent()))


def op8_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    return exact_dedup(spark, path)
