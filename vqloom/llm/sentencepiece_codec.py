"""SentencePiece encoding and decoding that keeps source offsets.

The model file is read as is. Text is normalised by longest-prefix matches in the model's compiled character map
(a double-array trie); each normalised byte records the source byte it came from, so every piece projects to a span of
original bytes. Pieces are found by byte-pair merges in score order with byte fallback. Where the character map is empty, text falls apart at
spaces and at characters that no longer piece contains, and the encodings of such chunks are kept in a bounded table, with the source
bytes of each id. Spans follow on each other: an id begins where the one before ends.

Defined results: a null text is the empty text, which has no ids and decodes to itself; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import aged, whole_text

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Chunks of at most LONG characters that are kept with their encodings, and those of them in a pipeline, whose workers hold other stages' tables too.
CACHE, FEWER, LONG = 400_000, 50_000, 64
#: Up to this length a list of all neighbours is faster than a heap.
SHORT = 64


class CharMap:
    """The compiled character map: a double-array trie over source bytes, and its replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest source prefix in the map, and its replacement."""
        units = self.units
        if not units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node, best = offset(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        return best and (best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])])


class Codec:
    """One model: normalise, encode with spans, decode."""

    def __init__(self, path: str, most: int = CACHE):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with white space as a prefix are supported")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        if any(p.type == 5 for p in model.pieces):
            raise ValueError("unused pieces, which would have to be split again, are not supported")
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.unknown = self.kinds.index(2)
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id = {p: i for i, p in enumerate(self.pieces)}
        self.bytes = [self.id.get(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        #: Characters inside longer pieces; any other one is a piece for itself.
        joined = {c for p in self.score if len(p) > 1 for c in p}
        inner = any(MARK in p.lstrip(MARK) for p in self.score)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.simple = not self.map.units and not self.trim and self.prefix and self.escape and not inner
        self.chunks = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]+" if alone else ""))
        self.most = most
        self.kept: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.entry: dict[str, tuple] = {}

        def plain(piece: str, kind: int) -> bytes:
            if kind == 6:
                return bytes((int(piece[3:5], 16),))
            return b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else piece.replace(MARK, " ").encode()

        #: What each id decodes to.
        self.plain = [plain(p, k) for p, k in zip(self.pieces, self.kinds, strict=True)]

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each of them (and the end) the offset of its source byte."""
        data, out, source = text.encode(), bytearray(), []
        at, space = 0, MARK_BYTES if self.escape else b" "

        def take(i: int) -> tuple[int, bytes]:
            found = self.map.longest(data, i)
            if found:
                return found
            lead = data[i]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return n, data[i : i + n]

        while self.trim and at < len(data):
            n, piece = take(at)
            if piece != b" ":
                break
            at += n
        if at == len(data):
            return b"", [0]
        if self.prefix:
            out += space
            source += [at] * len(space)
        after_space = self.trim
        while at < len(data):
            n, piece = take(at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for b in piece:
                    new = space if b == 32 else bytes((b,))
                    out += new
                    source += [at] * len(new)
                after_space = piece.endswith(b" ")
            at += n
            after_space &= self.trim
        while self.trim and out.endswith(space):
            at = source[len(out) - len(space)]
            del out[-len(space) :], source[-len(space) :]
        return bytes(out), [*source, at]

    def merge(self, text: str) -> list[str]:
        """Pieces of normalised text: the best-scored pair merges first, of equal ones the leftmost."""
        parts: list[str] = list(text)
        n, score = len(parts), self.score
        if n <= SHORT:
            return self._merge_short(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """The same with the scores of all neighbours in a list."""
        get, none = self.score.get, float("-inf")
        pairs = [get(a + b, none) for a, b in pairwise(parts)]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece, self.unknown)
        if i == self.unknown and self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [i]

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the begin and end of each one's span of source bytes; of a character's byte pieces the last has the span."""
        norm, source = self.normalise(text)
        ids, begins, ends, at = [], [], [], 0
        for piece in self.merge(norm.decode()):
            end = at + len(piece.encode())
            own = self.ids_of(piece)
            ids += own
            begins += [source[at]] * len(own)
            ends += [source[at]] * (len(own) - 1) + [source[end]]
            at = end
        return ids, begins, ends

    def _chunk(self, chunk: str) -> tuple[str, int, bytes, bytes]:
        """Ids as text, their number, the decoded bytes of a chunk and the packed source lengths of its ids."""
        get, make = self.entry.get, self._entry
        if (out := self.old.get(chunk)) is not None:
            pass
        elif len(found := [get(p) or make(p) for p in self.merge(chunk)]) == 1:
            out = found[0]
        else:
            out = ",".join([e[0] for e in found]), sum([e[1] for e in found]), b"".join([e[2] for e in found]), b"".join([e[3] for e in found])
        if len(chunk) <= LONG:
            aged(self.kept, self.old, self.most)
            self.kept[chunk] = out
        return out

    def _entry(self, piece: str) -> tuple[str, int, bytes, bytes]:
        """Ids as text, number, decoded bytes and packed source lengths of one piece, a mark being one byte; the vocabulary's own are kept for good."""
        ids = self.ids_of(piece)
        out = ",".join(map(str, ids)), len(ids), self.raw(ids), array("i", [0] * (len(ids) - 1) + [len(piece.replace(MARK, " ").encode())]).tobytes()
        if piece in self.score:
            self.entry[piece] = out
        return out

    def raw(self, ids: list[int]) -> bytes:
        """The bytes behind ids, white space unescaped."""
        return b"".join([self.plain[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The library's decode: ids to text, without the space that encoding puts first."""
        out = self.raw(ids)
        first = next((i for i in ids if self.kinds[i] != 3), None)
        if first is not None and self.prefix and self.pieces[first].startswith(MARK):
            out = out[1:]
        return out.decode(errors="replace")

    def _bounds(self, text: str, found: list[tuple]) -> np.ndarray:
        """The first id's begin and the end of every id in source bytes, from a text's chunks."""
        if MARK in text:  # a mark of the text's own has three bytes, and chunks do not tell it from a space
            _, begins, ends = self.encode(text)
            return np.array([*begins[:1], *ends], np.int32)
        bounds = np.frombuffer(b"\0\0\0\0" + b"".join([f[3] for f in found]), np.int32).cumsum(dtype=np.int32)
        bounds[1:] -= 1  # the mark put before the text
        return bounds

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """Number of ids, SHA-256 of the ids, of the decoded text and of the spans (the first begin and all ends as 32-bit
        little-endian numbers), without lists of ids where text falls into chunks."""
        if not text:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty, empty
        if not self.simple:
            ids, begins, ends = self.encode(text)
            spans = np.array([*begins[:1], *ends], "<i4").tobytes()
            return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest(), hashlib.sha256(spans).hexdigest()
        get, make = self.kept.get, self._chunk
        found = [get(c) or make(c) for c in self.chunks.findall(MARK + text.replace(" ", MARK))]
        ids = ",".join([f[0] for f in found])
        out = b"".join([f[2] for f in found])
        # The first piece starts with the mark put before the text.
        spans = hashlib.sha256(self._bounds(text, found).astype("<i4", copy=False)).hexdigest()
        return sum([f[1] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(out[1:]).hexdigest(), spans

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.simple:
            return np.array(self.encode(text)[0], np.int32)
        get, make = self.kept.get, self._chunk
        return np.fromstring(",".join([(get(c) or make(c))[0] for c in self.chunks.findall(MARK + text.replace(" ", MARK))]), np.int32, sep=",")


    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What encode() gives, by chunks where text falls into them."""
        if not text or not self.simple:
            ids, begins, ends = self.encode(text) if text else ([], [], [])
            return np.array(ids, np.int32), np.array(begins, np.int32), np.array(ends, np.int32)
        get, make = self.kept.get, self._chunk
        found = [get(c) or make(c) for c in self.chunks.findall(MARK + text.replace(" ", MARK))]
        bounds = self._bounds(text, found)
        return np.fromstring(",".join([f[0] for f in found]), np.int32, sep=","), bounds[:-1], bounds[1:]


@lru_cache(2)
def codec(path: str, most: int = CACHE) -> Codec:
    """One codec for each model in a process."""
    return Codec(path, most)


def with_pieces(df: DataFrame, path: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """Adds a struct `into` of ids and the source byte spans (begins, ends) of each."""

    @F.pandas_udf("ids array<int>, begins array<int>, ends array<int>")
    def run(cells: pd.Series) -> pd.DataFrame:
        own = codec(path)
        return pd.DataFrame([own.encode(t) for t in cells], columns=["ids", "begins", "ends"])

    return df.withColumn(into, run(whole_text(text)))


def with_ids(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    @F.pandas_udf("array<int>")
    def run(cells: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.ids(t) for t in cells], dtype=object)

    return df.withColumn(into, run(whole_text(text)))


def with_decoded(df: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def run(cells: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([None if c is None else own.decode([int(i) for i in c]) for c in cells], dtype=object)

    return df.withColumn(into, run(F.col(ids)))


def op5_sentencepiece(docs: DataFrame, path: str, spans: bool = False) -> DataFrame:
    """The digests of every document; with `spans` also that of the source byte spans."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    def run(cells: pd.Series) -> pd.DataFrame:
        own = codec(path)
        return pd.DataFrame([own.digest(t) for t in cells], columns=names)

    return docs.select("doc_id", run(whole_text()).alias("p")).select("doc_id", *[f"p.{n}" for n in names[: 3 + spans]])


def encoded(docs: DataFrame, path: str, rows: int = 256) -> DataFrame:
    """doc_id, source, lang where present, ids, n_tokens and the source byte spans (begins, ends) of the ids: the last step of a pipeline. Ids leave a worker `rows` documents at a time."""
    keys = [c for c in ("doc_id", "source", "lang") if c in docs.columns]
    out = StructType([docs.schema[c] for c in keys] + [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())] + [StructField(c, ArrayType(IntegerType())) for c in ("begins", "ends")])

    def run(batches):
        own = codec(path, FEWER)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, begins, ends = zip(*[own.spans(t.as_py()) for t in part.column(len(keys))], strict=True)
                lengths = np.array([len(x) for x in ids])
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (ids, begins, ends)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), lists[0], pa.array(lengths, pa.int64()), *lists[1:]], [*keys, "ids", "n_tokens", "begins", "ends"])

    return docs.select(*keys, whole_text().alias("_vq_text")).mapInArrow(run, out)
