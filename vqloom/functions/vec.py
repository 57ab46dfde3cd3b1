"""Vector columns (array<double>) as expressions, and the bit functions of scan orders.

Arithmetic on a null vector, or on vectors of unequal lengths, is null; only `finite` and `has_nan` answer for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """There is a vector, and no component is NaN, infinite or null."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def has_nan(vec: Column) -> Column:
    """A component is NaN or null, or there is no vector."""
    return F.coalesce(F.exists(vec, lambda x: x.isNull() | F.isnan(x)), F.lit(True))


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def or_one(x: Column) -> Column:
    """x, or 1 where it is 0."""
    return F.when(x == 0, 1.0).otherwise(x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; a zero norm counts as 1, which gives 1."""
    return 1 - dot(a, b) / (or_one(norm(a)) * or_one(norm(b)))


def morton(row: Column, col: Column, bits: int = 16) -> Column:
    """Interleaved code: columns on the even bits, rows on the odd ones."""
    code = F.lit(0).cast("long")
    for i in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(col.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(row.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i + 1))
    return code


def unmorton(code: Column, odd: bool, bits: int = 16) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 2 * i + odd).bitwiseAND(F.lit(1)), i))
    return out


def hilbert(row: Column, col: Column, order: Column | int) -> Column:
    """Distance along the Hilbert curve of a 2^order square; x is the column, y the row.

    Each level adds its quadrant and turns the rest of the square: reflected in quadrant (1, 0), then transposed in both lower ones.
    The state goes through an aggregate, so the plan stays small.
    """
    order = F.lit(order) if isinstance(order, int) else order
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    top = power(order) - 1
    start = F.struct(col.cast("long").alias("x"), row.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    sides = F.transform(F.sequence(order - 1, F.lit(0), F.lit(-1)), power)

    def level(s: Column, side: Column) -> Column:
        rx = (s["x"].bitwiseAND(side) != 0).cast("long")
        ry = (s["y"].bitwiseAND(side) != 0).cast("long")
        flip = (ry == 0) & (rx == 1)
        x, y = F.when(flip, top - s["x"]).otherwise(s["x"]), F.when(flip, top - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), (s["d"] + side * side * (3 * rx).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(sides, start, level, lambda s: s["d"])
