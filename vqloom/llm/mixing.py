"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern can send its tokens REPEATS times:
the first pass is free, each further one costs more (convex), so that the flow repeats text only where a quota asks for it.
Quotas are the sources' targets. The flow's share of a pattern becomes whole passes over its documents plus a rest; the rest goes to
the documents in seeded hash order, found by cutting a histogram of hash bytes level by level, 256 buckets at a time, so no task
and no driver ever sees a source's documents together. The document at the cut takes part of one more pass. What a document gives
then follows from its own row and one small row of its pattern, so texts never move.

The flow runs on the driver over the patterns, of which there may be MOST; with more, an error says so, as nothing may be left out.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated rows are documents
of their own, and rows equal in id and text tie in the order and share the rest of the cut; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, local_rows, whole_text

REPEATS = 3
WEIGHTS = (5, 2, 1)
SEED = 17
LEVELS = 4
#: Patterns of sources that the driver solves the flow for.
MOST = 100_000


def words_of(text: Column) -> Column:
    """Number of words: splits at runs of white space, without the empty strings at both ends."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the total size by weight, stopped at `repeats` times each size, the excess reshared by weight."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > repeats * sizes[i] * weight]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            return out
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
        left = max(left, 0.0)
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[float], repeats: int = REPEATS) -> list[dict[int, float]]:
    """Tokens from each pattern (sources, size) to each of its sources: as much of the quotas as can be met, at least cost.

    A pass over a pattern's tokens costs 0, 1, 2 ... for the first, second, third ... Successive shortest paths in
    the residual network; every path fills a quota, a pass, or takes back an earlier flow.
    """
    flow: list[dict[int, float]] = [defaultdict(float) for _ in patterns]
    used, left = [0.0] * len(patterns), list(quotas)
    members = defaultdict(list)
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            members[s].append(p)
    # Sources that share no pattern do not compete, so each group of linked sources is solved for itself.
    seen: set[int] = set()
    for start in range(len(quotas)):
        if start in seen:
            continue
        group, todo, seen = set(), [start], seen | {start}
        while todo:
            s = todo.pop()
            group.add(s)
            for p in members[s]:
                for t in patterns[p][0]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
        pats = sorted({p for s in group for p in members[s]})
        tiny = 1e-6
        while True:
            # From patterns with room (cost of their current pass) over sources, back over flows that can be moved, to a source with quota left.
            dist: dict[tuple[str, int], int] = {}
            back: dict[tuple[str, int], tuple[str, int] | None] = {}
            heap: list[tuple[int, str, int]] = []
            for p in pats:
                size = patterns[p][1]
                if size and used[p] < repeats * size - tiny:
                    cost = min(int((used[p] + tiny) // size), repeats - 1)
                    dist["p", p], back["p", p] = cost, None
                    heapq.heappush(heap, (cost, "p", p))
            goal = None
            while heap:
                d, kind, x = heapq.heappop(heap)
                if d > dist[kind, x]:
                    continue
                if kind == "s" and left[x] > tiny:
                    goal = x
                    break
                steps = [("s", s) for s in patterns[x][0]] if kind == "p" else [("p", p) for p in members[x] if flow[p][x] > tiny]
                for node in steps:
                    if d < dist.get(node, 1 << 60):
                        dist[node], back[node] = d, (kind, x)
                        heapq.heappush(heap, (d, *node))
            if goal is None:
                break
            path, node = [("s", goal)], back["s", goal]
            while node is not None:
                path.append(node)
                node = back[node]
            path.reverse()
            first = path[0][1]
            size = patterns[first][1]
            much = min(left[goal], (int((used[first] + tiny) // size) + 1) * size - used[first])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "s":
                    much = min(much, flow[b[1]][a[1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    flow[a[1]][b[1]] += much
                else:
                    flow[b[1]][a[1]] -= much
            used[first] += much
            left[goal] -= much
    return [dict(f) for f in flow]


def _passed(rows: DataFrame, bucket: Column) -> DataFrame:
    """pat, at, left: of each pattern the bucket (256 at most) in which its running size passes `left`, and what is left before it."""
    sums = rows.groupBy("pat", bucket.alias("at")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    run = F.sum("size").over(Window.partitionBy("pat").orderBy("at"))
    passed = sums.withColumn("run", run).where((F.col("run") > F.col("left")) & (F.col("run") - F.col("size") <= F.col("left")))
    found = passed.groupBy("pat").agg(F.min_by(F.struct("at", (F.col("left") - F.col("run") + F.col("size")).alias("left"), "size"), "at").alias("b"))
    return found.select("pat", "b.*")


def _edges(thin: DataFrame, rests: DataFrame) -> list[tuple]:
    """(pat, edge, part, tied) of each pattern with a rest: documents before the hash `edge` are in it, those at it share `part` words of `tied`.

    `thin` has pat, size, u (a long hash in seeded order); `rests` has pat and rest. Level by level the bucket of 16 bits in which
    a pattern's running size passes its rest is found from a histogram, first by its upper and then by its lower 8 bits.
    """
    spark = thin.sparkSession
    bounds = rests.select("pat", F.col("rest").cast("long").alias("left"), F.lit(0).cast("long").alias("prefix"))
    rows: list[tuple] = []
    for level in range(LEVELS):
        shift = 64 - 16 * (level + 1)
        inside = thin.join(F.broadcast(bounds), "pat")
        if level:
            inside = inside.where(F.shiftrightunsigned("u", shift + 16) == F.col("prefix"))
        histogram = cut(inside.groupBy("pat", F.shiftrightunsigned("u", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("left").alias("left")))
        high = F.shiftright("bucket", 8)
        coarse = [tuple(r) for r in _passed(histogram, high).select("pat", "at", "left").collect()]
        if not coarse:
            return []
        upper = F.broadcast(local_rows(spark, coarse, "pat int, at long, left long"))
        within = histogram.drop("left").join(upper, "pat").where(high == F.col("at"))
        rows = [tuple(r) for r in _passed(within.select("pat", "bucket", "size", "left"), F.col("bucket")).select("pat", "left", "at", "size").collect()]
        bounds = local_rows(spark, [r[:3] for r in rows], "pat int, left long, prefix long")
    return [(pat, edge, left, size) for pat, left, edge, size in rows]


def _thin(docs: DataFrame, sources: Column, doc_id: str, text: str, seed: int) -> DataFrame:
    """`docs` with the pattern's mark, the size and the seeded hash of each row (prefixed _vq_)."""
    names = F.array_sort(F.array_distinct(sources))
    return docs.withColumns({"_vq_sources": names, "_vq_size": words_of(whole_text(text)), "_vq_u": F.xxhash64(F.lit(seed), doc_id, whole_text(text))})


def _mark(sources: str) -> Column:
    """A pattern as text, with nulls marked, as null names match too."""
    return F.to_json(F.struct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("null"))).alias("s")))


def solve(thin: DataFrame, weights: tuple = WEIGHTS) -> DataFrame | None:
    """One row for each pattern (mark, pat, passes, source_size, target, edge, part, tied), MOST at most; None without documents.

    source_size and target are those of the pattern's first source by name.
    """
    spark = thin.sparkSession
    rows = [(tuple(r["sources"]), r["size"]) for r in thin.groupBy(F.col("_vq_sources").alias("sources")).agg(F.sum("_vq_size").alias("size")).limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} combinations of sources: group them, as the flow is solved over each of them")
    if not rows:
        return None
    rows.sort(key=lambda r: tuple((s is None, (s or "").encode()) for s in r[0]))
    names = sorted({s for r in rows for s in r[0]}, key=lambda s: (s is None, (s or "").encode("utf-8")))
    place = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for own, n in rows:
        for s in own:
            sizes[place[s]] += n
    shares = [weights[i % len(weights)] for i in range(len(names))]
    total = sum(n for _, n in rows)
    goal = targets([min(s, total) for s in sizes], shares)
    flows = min_cost_flow([(tuple(place[s] for s in own), n) for own, n in rows], goal)
    plan = []
    for i, ((own, n), flow) in enumerate(zip(rows, flows, strict=True)):
        out = min(round(sum(flow.values())), REPEATS * n)
        passes = out // n if n else 0
        plan.append((list(own), i, passes, out - passes * n, sizes[place[own[0]]] if own else 0, goal[place[own[0]]] if own else 0.0))
    table = local_rows(spark, plan, "sources array<string>, pat int, passes long, rest long, source_size long, target double").withColumn("mark", _mark("sources")).drop("sources")
    known = thin.select(_mark("_vq_sources").alias("mark"), F.col("_vq_size").alias("size"), F.col("_vq_u").alias("u")).join(F.broadcast(table.select("mark", "pat")), "mark").select("pat", "size", "u")
    edges = local_rows(spark, _edges(known, table.select("pat", "rest")), "pat int, edge long, part long, tied long")
    return table.drop("rest").join(F.broadcast(edges), "pat", "left")


def _taken(marked: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows of `_thin` with _vq_taken, _vq_source_size and _vq_target."""
    own = solved.select(*[F.col(c).alias(f"_vq_{c}") for c in solved.columns])
    joined = marked.withColumn("_vq_mark", _mark("_vq_sources")).join(F.broadcast(own), "_vq_mark")
    top = F.lit(-(1 << 63))
    before = F.col("_vq_u").bitwiseXOR(top) < F.col("_vq_edge").bitwiseXOR(top)
    shared = F.floor(F.col("_vq_part") * F.col("_vq_size") / F.col("_vq_tied"))
    extra = F.when(F.col("_vq_edge").isNull(), 0).when(before, F.col("_vq_size")).when(F.col("_vq_u") == F.col("_vq_edge"), shared).otherwise(0)
    return joined.withColumn("_vq_taken", F.col("_vq_passes") * F.col("_vq_size") + extra.cast("long"))


def mix(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", weights: tuple = WEIGHTS, seed: int = SEED, key: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and `key` columns) for every row; `sources` is an array of source names."""
    thin = cut(_thin(docs, sources, doc_id, text, seed).select(*key, F.col(doc_id).alias("doc_id"), "_vq_sources", "_vq_size", "_vq_u"))
    solved = solve(thin, weights)
    if solved is None:
        return thin.select(*key, "doc_id", *[F.lit(0).cast(t).alias(c) for c, t in (("size", "long"), ("source_size", "long"), ("target", "double"), ("taken", "long"))])
    done = _taken(thin, solved)
    return done.select(*key, "doc_id", *[F.col(f"_vq_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def op9_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs, F.array("source"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix with their own columns: one row for each pass; the part of a pass at a cut counts from one half."""
    marked = _thin(docs, F.array("source"), "doc_id", "text", seed)
    solved = solve(cut(marked.select("_vq_sources", "_vq_size", "_vq_u")))
    if solved is None:
        return docs
    passes = F.floor((F.col("_vq_taken") + F.col("_vq_size") / 2) / F.col("_vq_size")).cast("int")
    done = _taken(marked, solved).where("_vq_size > 0 and _vq_taken * 2 >= _vq_size")
    return done.withColumn("_vq_pass", F.explode(F.sequence(F.lit(1), passes))).select(*docs.columns)
