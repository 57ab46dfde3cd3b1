"""The facade: quantised structures, rebuilt mosaics and residual histograms of a region, with typed errors and a result cache."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grid as G
from .operators import metrics as M
from .operators import payload as P
from .operators import quantize as Q
from .sources.raster import bbox_size_km
from .sources.sinks import ResultCache


class VQError(Exception):
    status = 500


class BadRequest(VQError):
    status = 400


class NoData(VQError):
    status = 404


class TooLarge(VQError):
    status = 413


class NoCoverage(VQError):
    status = 422


class Busy(VQError):
    """All computing slots are taken; `retry_after` seconds may free one."""

    status = 429
    retry_after = 2


@dataclass(frozen=True)
class Structure:
    """The payload table of a region (one row for each tile), and what is needed to rebuild it; k2 is None for one stage."""

    payload: DataFrame
    bbox: tuple[float, float, float, float]
    t: int
    k: int
    k2: int | None
    height: int
    width: int
    year: int

    @property
    def is_rvq(self) -> bool:
        return self.k2 is not None

    @property
    def codes(self) -> DataFrame:
        return P.unpack(self.payload).select(*G.TILE, "row", "col", "code1", "code2")

    @property
    def codebooks1(self) -> DataFrame:
        return P.codebooks(self.payload, 1)

    @property
    def codebooks2(self) -> DataFrame | None:
        return P.codebooks(self.payload, 2) if self.is_rvq else None


def rebuilt(s: Structure) -> tuple[DataFrame, tuple[float, float, float, float], str]:
    """Every cell of the whole-tile grid with its rebuilt vector (null: not covered), (west, north, pixel width, pixel height) and the reference system."""
    rows, cols = s.height // s.t * s.t, s.width // s.t * s.t
    if not rows or not cols:
        raise NoCoverage(f"no whole tile of {s.t} in {s.width} x {s.height} pixels")
    cells = s.payload.sparkSession.range(rows * cols).selectExpr(f"id div {cols} AS row", f"id % {cols} AS col")
    west, south, east, north = s.bbox
    done = P.unpack(s.payload).select("row", "col", "rec")
    return cells.join(done, ["row", "col"], "left"), (west, north, (east - west) / s.width, (north - south) / s.height), "EPSG:4326"


class Engine:
    """`source(bbox, year)` gives the pixels (row, col, vec) of a box, or None.

    With `cache`, a folder that driver and executors share, payloads are kept there by `name` of the source and all parameters. At most `slots`
    payloads are computed at once; further calls raise Busy.
    """

    def __init__(self, spark: SparkSession, source, cache: str | None = None, t: int = 512, k: int = 20, k2: int | None = 256, m: str = "euclidean", cap_km: float = 10.0, sample: int = 2000, n_iter: int = 20, name: str = "default", cache_bytes: int = 500 << 30, slots: int = 4):
        self.spark, self.source, self.name = spark, source, name
        self.t, self.k, self.k2, self.m, self.cap_km, self.sample, self.n_iter = t, k, k2, m, cap_km, sample, n_iter
        self.cache = ResultCache(spark, cache, cache_bytes) if cache else None
        self._slots = threading.BoundedSemaphore(slots)

    @property
    def is_rvq(self) -> bool:
        return self.k2 is not None

    @contextmanager
    def _slot(self):
        if not self._slots.acquire(blocking=False):
            raise Busy("all computing slots are taken")
        try:
            yield
        finally:
            self._slots.release()

    def _checked(self, bbox, crs: str) -> tuple[float, float, float, float]:
        if crs.upper() not in ("EPSG:4326", "WGS84"):
            raise BadRequest(f"only EPSG:4326 is supported, not {crs!r}")
        if bbox is None or len(bbox) != 4:
            raise BadRequest("bbox must be (west, south, east, north)")
        if any(p is not None and p <= 0 for p in (self.t, self.k, self.k2)):
            raise BadRequest("t, k and k2 must be positive")
        if self.m not in ("euclidean", "cosine"):
            raise BadRequest(f"unknown distance {self.m!r}")
        w, h = bbox_size_km(tuple(bbox))
        if max(w, h) > self.cap_km:
            raise TooLarge(f"{w:.1f} x {h:.1f} km is over {self.cap_km} km")
        return tuple(map(float, bbox))

    def _pixels(self, bbox, year: int) -> DataFrame:
        px = self.source(bbox, year)
        if px is None or px.isEmpty():
            raise NoData("no data for this region")
        return px

    def _key(self, bbox, year: int) -> str:
        """The format, the source, the bounds to six decimals and every parameter that changes a result."""
        params = (year, self.t, self.k, self.k2, self.m, self.sample, self.n_iter)
        return "|".join([P.FORMAT, self.name, *(f"{b:.6f}" for b in bbox), *map(str, params)])

    def fetch_quantized_structure(self, bbox, year: int = 2024, target_crs: str = "EPSG:4326") -> Structure:
        """The payload, computed once for each set of parameters and stored only if computing succeeds."""
        box = self._checked(bbox, target_crs)

        def compute() -> DataFrame:
            with self._slot():
                px = self._pixels(box, year)
                h, w = px.agg(F.max("row") + 1, F.max("col") + 1).first()
                out = P.pack(G.full_tiles(px, self.t), self.t, self.k, self.k2, self.n_iter, self.sample)
                out = out.withColumns({"height": F.lit(h).cast("long"), "width": F.lit(w).cast("long")})
                if self.cache is None:
                    out = out.cache()
                if out.isEmpty():
                    raise NoCoverage(f"no complete finite {self.t} x {self.t} tile in {w} x {h} pixels")
                return out

        table = self.cache.get_or_compute(self._key(box, year), compute) if self.cache else compute()
        h, w = table.select("height", "width").first()
        return Structure(table.drop("height", "width"), box, self.t, self.k, self.k2, h, w, year)

    def fetch_mosaic_for_region(self, bbox, year: int = 2024, target_crs: str = "EPSG:4326", auto_download: bool = True):
        """Rebuilt cells, the grid's place and its reference system, as `rebuilt` gives them; `auto_download` is there for callers that pass it."""
        return rebuilt(self.fetch_quantized_structure(bbox, year, target_crs))

    def fetch_embedding(self, lon: float, lat: float, year: int = 2024):
        """The mosaic of the tile of a tenth of a degree about a centre."""
        return self.fetch_mosaic_for_region((lon - 0.05, lat - 0.05, lon + 0.05, lat + 0.05), year)

    def residuals(self, bbox, year: int = 2024) -> DataFrame:
        """l2: the errors of all covered pixels, with codebooks that were never rounded."""
        px = self._pixels(self._checked(bbox, "EPSG:4326"), year)
        done = Q.vq(G.full_tiles(px, self.t), self.k, self.k2, self.n_iter, self.sample)
        return Q.errors(done).select("l2")

    def fetch_residual_histogram(self, bbox, year: int = 2024, n_bins: int = 50) -> dict:
        """n_pixels, bin_edges, counts and stats of the pixels' errors; empty lists where no pixel is covered."""
        if n_bins <= 0:
            raise BadRequest("n_bins must be positive")
        with self._slot():
            x = self.residuals(bbox, year).cache()
            bins = M.bounded_histogram(x, "l2", n_bins).orderBy("bin_index").collect()
            if not bins:
                return {"n_pixels": 0, "bin_edges": [], "counts": [], "stats": {}}
            mean = x.agg(F.avg("l2")).first()[0]
            q = M.quantile_row(x, "l2", [0.1, 0.5, 0.9, 0.99])
            x.unpersist()
        stats = dict(zip(("p10", "p50", "p90", "p99"), q, strict=True)) | {"mean": mean}
        return {"n_pixels": sum(r["n"] for r in bins), "bin_edges": [r["bin_low"] for r in bins] + [bins[-1]["bin_high"]], "counts": [r["n"] for r in bins], "stats": stats}
