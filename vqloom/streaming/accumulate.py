"""Accumulation over streams of windows: only mergeable sums are kept, each batch in its own folder, so a restart repeats nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import moments


def stream_histogram(stream: DataFrame, value: str, by: list[str], hi: float, n_bins: int, out: str) -> None:
    """Counts per bin of [0, hi] (bin n_bins: outside) of every batch under `out`; edges are frozen beforehand."""
    x = F.col(value)
    at = F.when((x >= 0) & (x <= hi), F.least(F.floor(x / hi * n_bins), F.lit(n_bins - 1))).otherwise(n_bins)

    def batch(df: DataFrame, no: int) -> None:
        df.groupBy(*by, at.alias("bin_index")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/parts/batch_no={no}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def histogram_so_far(spark, out: str, by: list[str]) -> DataFrame:
    return spark.read.parquet(f"{out}/parts").groupBy(*by, "bin_index").agg(F.sum("n").alias("n"))


def stream_gram(stream: DataFrame, vec: str, out: str) -> None:
    """Sums of products (i <= j) of every batch; adding them up gives the Gram matrix of all windows seen."""

    def batch(df: DataFrame, no: int) -> None:
        moments(df, vec=vec).where("i >= 0").withColumnRenamed("s", "sum_xy").write.mode("overwrite").parquet(f"{out}/parts/batch_no={no}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def gram_so_far(spark, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/parts").groupBy("i", "j").agg(F.sum("sum_xy").alias("sum_xy"))
