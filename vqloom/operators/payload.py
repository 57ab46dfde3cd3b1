"""The served form of quantised tiles: one row for each tile with packed codebooks and index planes, and its reader.

Single-stage rows keep 32-bit float codebooks; two-stage rows keep 8-bit ones with each dimension's ends. Index planes take one byte a
pixel up to 256 codes, two beyond. Everything is little-endian. A tile's row has a few bytes a pixel, so tables of them are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .grid import tile_keys
from .quantize import VECTOR, _long, by_tile, dequantise, lists, matrix, quantise_uint8, two_stages

#: The payload's format.
FORMAT = "vqloom-tiles-2"
FIELDS = [StructField(n, LongType()) for n in ("t", "dims", "k1", "k2")] + [StructField(n, BinaryType()) for n in ("codebook1", "lo1", "hi1", "indices1", "codebook2", "lo2", "hi2", "indices2")]


def _plane(code: np.ndarray, k: int) -> bytes:
    return code.astype("u1" if k <= 256 else "<u2").tobytes()


def pack(tiles: DataFrame, t: int, k1: int, k2: int | None = None, n_iter: int = 20, cap: int | None = 2000) -> DataFrame:
    """One row for each complete finite tile (the pixels of `grid.full_tiles`): keys, t, dims, effective k1 and k2 (null for one stage), codebooks and index planes."""

    def kernel(table: pa.Table) -> dict:
        x = matrix(table.column("vec"))
        c1, a1, c2, a2, _ = two_stages(x, k1, k2, n_iter, cap)
        out: dict = {"t": [t], "dims": [x.shape[1]], "k1": [len(c1)], "k2": [len(c2) if k2 else None]}
        if k2:
            for stage, c, a in ((1, c1, a1), (2, c2, a2)):
                q, lo, hi = quantise_uint8(c)
                out |= {f"codebook{stage}": [q.tobytes()], f"lo{stage}": [lo.astype("<f4").tobytes()], f"hi{stage}": [hi.astype("<f4").tobytes()], f"indices{stage}": [_plane(a, len(c))]}
        else:
            out |= {"codebook1": [c1.astype("<f4").tobytes()], "indices1": [_plane(a1, len(c1))]} | {n: [None] for n in ("lo1", "hi1", "codebook2", "lo2", "hi2", "indices2")}
        return {f.name: pa.array(out[f.name], pa.int64() if isinstance(f.dataType, LongType) else pa.binary()) for f in FIELDS}

    return by_tile(_long(tiles), kernel, FIELDS)


def _book(row: dict, stage: int) -> np.ndarray:
    c, k = row["dims"], row[f"k{stage}"]
    if row["k2"] is None:
        return np.frombuffer(row["codebook1"], "<f4").reshape(k, c).astype(float)
    q = np.frombuffer(row[f"codebook{stage}"], np.uint8).reshape(k, c)
    lo, hi = (np.frombuffer(row[f"{n}{stage}"], "<f4").astype(float) for n in ("lo", "hi"))
    return dequantise(q, lo, hi)


def _codes(row: dict, stage: int) -> np.ndarray:
    return np.frombuffer(row[f"indices{stage}"], "u1" if row[f"k{stage}"] <= 256 else "<u2").astype(np.int64)


def unpack(payload: DataFrame, rows: int = 4096) -> DataFrame:
    """keys, row, col, code1, code2 (null for one stage), rec of every pixel, by slices of a tile; places are those of the window."""
    keys = tile_keys(payload)
    names = [*keys, "row", "col", "code1", "code2", "rec"]
    schema = StructType([payload.schema[k] for k in keys] + [StructField(n, LongType()) for n in ("row", "col", "code1", "code2")] + [StructField("rec", VECTOR)])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                one, a1 = _book(row, 1), _codes(row, 1)
                two, a2 = (None, None) if row["k2"] is None else (_book(row, 2), _codes(row, 2))
                for lo in range(0, len(a1), rows):
                    at = np.arange(lo, min(lo + rows, len(a1)))
                    rec = one[a1[at]] if two is None else one[a1[at]] + two[a2[at]]
                    own = [pa.array([row[k]] * len(at), batch.schema.field(k).type) for k in keys]
                    second = pa.nulls(len(at), pa.int64()) if two is None else pa.array(a2[at])
                    yield pa.RecordBatch.from_arrays([*own, pa.array(row["tile_row"] * row["t"] + at // row["t"]), pa.array(row["tile_col"] * row["t"] + at % row["t"]), pa.array(a1[at]), second, lists(rec)], names)

    return payload.mapInArrow(run, schema)


def codebooks(payload: DataFrame, stage: int) -> DataFrame:
    """keys, code, centroid of one stage; no rows for stage 2 of single-stage tiles."""
    keys = tile_keys(payload)
    schema = StructType([payload.schema[k] for k in keys] + [StructField("code", LongType()), StructField("centroid", VECTOR)])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if stage == 2 and row["k2"] is None:
                    continue
                book = _book(row, stage)
                yield pa.RecordBatch.from_arrays([*(pa.array([row[k]] * len(book), batch.schema.field(k).type) for k in keys), pa.array(np.arange(len(book))), lists(book)], [*keys, "code", "centroid"])

    return payload.mapInArrow(run, schema)


def sizes(payload: DataFrame) -> DataFrame:
    """keys and the bytes of codebooks and index planes."""
    own = lambda *names: sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(0)).cast("long")
    return payload.select(*tile_keys(payload), own("codebook1", "lo1", "hi1", "codebook2", "lo2", "hi2").alias("codebook_bytes"), own("indices1", "indices2").alias("index_bytes"))
