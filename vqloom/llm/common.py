"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: The white space of every word rule: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of a table that is broadcast at most.
BROADCAST = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a folder of this machine serves a local session; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vqloom-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder (smaller than a checkpoint)."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows. They travel as Arrow data: from a list of rows, Spark starts Python workers of another kind in every executor."""
    kinds = StructType.fromDDL(schema)
    own = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(own)], schema=own), kinds)


def aged(young: dict, old: dict, most: int) -> None:
    """Makes room in a bounded table of two ages, `most` entries in all: the young ones become the old ones once they are half of that."""
    if len(young) >= most // 2:
        old.clear()
        old.update(young)
        young.clear()


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: 16 for each column, besides the content of strings and arrays."""
    out = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            out += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            out += F.greatest(F.size(f.name), F.lit(0)) * 24
    return out


def fits(df: DataFrame, rows: int, most: int = BROADCAST) -> bool:
    """Whether the table has at most that many rows and bytes; give it a stored one."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return n <= rows and size <= most


def sized(df: DataFrame, rows: int) -> DataFrame:
    """`df`, marked for broadcast if it has at most `rows` rows and BROADCAST bytes; beyond that joins shuffle. Give it a stored table."""
    return F.broadcast(df) if fits(df, rows) else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, rows: int, how: str = "inner", hot: int = 1000) -> DataFrame:
    """`left` joined to `right`, a stored table with one row for each key and, in `weight`, the rows that it meets in `left`.

    A small `right` is broadcast. Beyond that bound the keys that hold more than one row in `hot` of all, of which there are
    fewer than `hot`, are broadcast, so that their rows stay where they are; the rows of the others shuffle by key.
    """
    rest = [c for c in right.columns if c not in on and c != weight]
    plain = right.select(*on, *rest)
    if fits(right, rows):
        return left.join(F.broadcast(plain), on, how)
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * hot > total
    heavy = F.broadcast(right.where(is_hot).select(*on, *rest))
    inner = "left_semi" if how == "left_semi" else "inner"
    light = left.join(F.broadcast(right.where(is_hot).select(*on)), on, "left_anti").join(right.where(~is_hot).select(*on, *rest), on, how)
    return left.join(heavy, on, inner).unionByName(light)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
