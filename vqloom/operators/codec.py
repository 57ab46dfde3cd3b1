"""Index-map codecs: scan orders, runs, their byte model, and the roll-up over tiles.

A null value is a symbol like any other, so nulls make runs; a table without rows has no runs. Places within a group must differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V

ORDERINGS = ("row", "morton", "hilbert")


def curve_order(side: Column) -> Column:
    """Levels of the smallest Hilbert square that holds `side` cells: the bits of side - 1, at least one."""
    return F.length(F.bin((side - 1).cast("long")))


def order_key(ordering: str, row: Column, col: Column, side: Column | int) -> Column:
    """Place of a cell in a scan of a map whose longer side is `side`; unknown names are an error."""
    side = F.lit(side) if isinstance(side, int) else side
    if ordering == "row":
        return row * side + col
    if ordering == "morton":
        return V.morton(row, col)
    if ordering == "hilbert":
        return V.hilbert(row, col, curve_order(side))
    raise ValueError(f"unknown ordering {ordering!r}; known: {', '.join(ORDERINGS)}")


def scan_positions(cells: DataFrame, ordering: str = "hilbert", block: int = 1 << 16) -> DataFrame:
    """row, col, pos of every cell of one map (distinct cells), from 0 along the scan.

    The curve is cut into blocks of that many places. Cells are distinct, so no block holds more; blocks are numbered by a running sum
    over their counts, and cells within their block.
    """
    side = cells.agg((F.greatest(F.max("row"), F.max("col")) + 1).cast("long").alias("side"))
    keyed = cells.select("row", "col").crossJoin(F.broadcast(side)).select("row", "col", order_key(ordering, F.col("row"), F.col("col"), F.col("side")).alias("d"))
    keyed = keyed.withColumn("block", F.expr(f"d div {block}"))
    # One row for each block: a 65,536th of the cells.
    counts = keyed.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("block").orderBy("d")
    return keyed.join(first, "block").select("row", "col", (F.col("first") + F.row_number().over(within) - 1).cast("long").alias("pos"))


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in each group: by, run_id, value, length. Runs never cross groups."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = df.select(*by, *order, value, new.alias("_new")).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run_id").agg(F.first(value).alias("value"), F.count("*").alias("length"))


def unrun(df: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, value from runs."""
    w = Window.partitionBy(*by).orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_at", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return placed.select(*by, F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("length") - 1)).alias("pos"), "value")


def symbol_bytes(n: Column) -> Column:
    return F.ceil(F.greatest(F.lit(1), F.length(F.bin(F.greatest(n - 1, F.lit(0))))) / 8)


def varint_bytes(length: Column) -> Column:
    return F.ceil(F.length(F.bin(length)) / 7)


def index_bytes(df: DataFrame, by: list[str], order: list[str], value: str, n_symbols: Column | int) -> DataFrame:
    """Per group: n_px, n_runs, runs_per_px, raw and run-length bytes per pixel; the symbols may differ by group (a column of `by`)."""
    r = runs(df, by, order, value)
    sym = symbol_bytes(F.lit(n_symbols) if isinstance(n_symbols, int) else n_symbols)
    a = r.groupBy(*by).agg(F.sum("length").alias("n_px"), F.count("*").alias("n_runs"), F.sum(varint_bytes(F.col("length"))).alias("varint"))
    return a.select(*by, "n_px", "n_runs", (F.col("n_runs") / F.col("n_px")).alias("runs_per_px"), sym.cast("double").alias("raw_bytes_per_px"), ((F.col("n_runs") * sym + F.col("varint")) / F.col("n_px")).alias("rle_bytes_per_px"))
