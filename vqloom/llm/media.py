"""Media columns: Netpbm and BMP to numpy, area resizing by integral images, NPY tiles, difference hashes.

Defined results: a null text is the empty text; a null or undecodable media cell gives nulls and an
`error` string instead of a failed job; equal inputs give equal values; rows are never dropped or merged.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Payloads are padded to whole squares of this side.
SIDE = 24
UNIT = SIDE * SIDE


class MediaError(ValueError):
    """The bytes are no image that this module reads."""


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """`count` decimal fields after the magic number, and the offset behind the single white space that ends them."""
    fields: list[int] = []
    i = 2
    while len(fields) < count:
        while i < len(data) and (data[i : i + 1].isspace() or data[i] == 35):
            if data[i] == 35:
                end = data.find(b"\n", i)
                i = len(data) if end < 0 else end
            else:
                i += 1
        j = i
        while j < len(data) and 48 <= data[j] <= 57:
            j += 1
        if j == i:
            raise MediaError("bad Netpbm header")
        fields.append(int(data[i:j]))
        i = j
    return fields, i + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3), uint8 or uint16; bitmaps as 0 (black) and 1."""
    kind = data[1] - 48 if len(data) > 1 and data[:1] == b"P" else 0
    if not 1 <= kind <= 6:
        raise MediaError("not Netpbm")
    bitmap = kind in (1, 4)
    fields, at = _header(data, 2 if bitmap else 3)
    w, h, top = fields[0], fields[1], 1 if bitmap else fields[2]
    if not w or not h or not 0 < top < 65536:
        raise MediaError("bad Netpbm size")
    planes = 3 if kind in (3, 6) else 1
    n, dtype = w * h * planes, np.uint8 if top < 256 else np.dtype(">u2")
    body = data[at:]
    if kind == 4:
        row = (w + 7) // 8
        if len(body) < row * h:
            raise MediaError("short Netpbm body")
        bits = np.unpackbits(np.frombuffer(body, np.uint8, row * h).reshape(h, row), axis=1)[:, :w]
        return 1 - bits
    if kind < 4:
        text = b"\n".join(line.split(b"#")[0] for line in body.split(b"\n"))
        values = np.array(list(text.replace(b" ", b"")) if bitmap else text.split(), dtype="i8" if not bitmap else "u1")
        if bitmap:
            values = 1 - (values[(values == 48) | (values == 49)] - 48)
        if len(values) < n:
            raise MediaError("short Netpbm body")
        out = values[:n].astype(np.uint8 if top < 256 else np.uint16)
    else:
        if len(body) < n * np.dtype(dtype).itemsize:
            raise MediaError("short Netpbm body")
        out = np.frombuffer(body, dtype, n)
        out = out if top < 256 else out.astype(np.uint16)
    return out.reshape((h, w, 3) if planes == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits as (h, w, 3) uint8 RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not BMP")
    start, head, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or w <= 0 or not h or bits not in (1, 4, 8, 24, 32):
        raise MediaError("unsupported BMP")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    if len(data) < start + rows * stride:
        raise MediaError("short BMP body")
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits >= 24:
        step = bits // 8
        rgb = raw[:, : w * step].reshape(rows, w, step)[:, :, 2::-1]
    else:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        table = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        spread = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        index = np.packbits(spread, axis=2, bitorder="big")[:, :w, 0] >> (8 - bits)
        if index.max(initial=0) >= len(table):
            raise MediaError("BMP colour out of range")
        rgb = table[index]
    return rgb[::-1] if h > 0 else rgb


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    body = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    body[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Rec. 601 luma in float64."""
    return image.astype(np.float64) if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def _edge_sums(total: np.ndarray, cells: int) -> np.ndarray:
    """A cumulative table along axis 0, read at `cells` + 1 even, fractional edges."""
    at = np.arange(cells + 1) * ((len(total) - 1) / cells)
    low = np.minimum(at.astype(np.int64), len(total) - 2)
    part = (at - low).reshape((-1,) + (1,) * (total.ndim - 1))
    return total[low] * (1 - part) + total[low + 1] * part


def area_resize(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each of h x w equal areas, by an integral image; edges inside a pixel count in proportion."""
    rows, cols = plane.shape
    integral = np.zeros((rows + 1, cols + 1))
    np.cumsum(plane, axis=0, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
    sums = np.diff(_edge_sums(_edge_sums(integral, h).T, w).T, axis=0)
    return np.diff(sums, axis=1) / ((rows / h) * (cols / w))


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0))
    return out.getvalue()


def features(image: np.ndarray, bits: int = 8) -> tuple[bytes, str]:
    """The NPY tile of bits x (bits + 1) area means as uint8, and its difference hash (row by row, left < right)."""
    tile = np.clip(np.floor(area_resize(grey(image), bits, bits + 1) + 0.5), 0, 255).astype(np.uint8)
    sign = np.packbits(tile[:, 1:] > tile[:, :-1])
    return npy(tile), sign.tobytes().hex()


def media_features(df: DataFrame, media: str = "media", into: str = "features") -> DataFrame:
    """Adds a struct `into` (height, width, tile: NPY bytes, dhash, error) made from the binary column `media`."""

    @F.pandas_udf("height int, width int, tile binary, dhash string, error string")
    def run(cells: pd.Series) -> pd.DataFrame:
        out = []
        for cell in cells:
            try:
                if cell is None:
                    raise MediaError("null")
                image = decode(bytes(cell))
                tile, dhash = features(image)
                out.append((image.shape[0], image.shape[1], tile, dhash, None))
            except MediaError as error:
                out.append((None, None, None, None, str(error)))
        return pd.DataFrame(out, columns=["height", "width", "tile", "dhash", "error"])

    return df.withColumn(into, run(F.col(media)))


def store_bytes(data: bytes) -> bytes:
    """The bytes, padded with 255 to a positive multiple of UNIT, as a PGM of SIDE columns."""
    whole = max(1, -(-len(data) // UNIT)) * UNIT
    return encode_pgm(np.frombuffer(data.ljust(whole, b"\xff"), np.uint8).reshape(-1, SIDE))


def documents_as_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `media` (binary): each whole text stored losslessly as a PGM."""

    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([store_bytes(bytes(c)) for c in cells], dtype=object)

    return docs.withColumn("media", run(whole_text(text).cast("binary")))


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy string"


def op1_media(docs: DataFrame) -> DataFrame:
    """Digests of every document's stored image and of the payload read back from it, its difference hash, and its NPY tile (hex; 200 bytes).

    The image itself stays inside the Python worker, so only digests and the tile travel back to the JVM.
    """

    @F.pandas_udf(DIGEST)
    def run(cells: pd.Series) -> pd.DataFrame:
        out = []
        for cell in cells:
            data = bytes(cell)
            media = store_bytes(data)
            image = decode(media)
            payload = image.tobytes()
            tile, dhash = features(image)
            out.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), dhash, tile.hex()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in DIGEST.split(", ")])

    return docs.select("doc_id", run(whole_text().cast("binary")).alias("m")).select("doc_id", "m.*")
