import random

import pytest
import xxhash
from pyspark.sql import functions as F

from vqloom.llm import simhash

from .rows import documents, empty


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(rows)), key=str)


def test_documents_match_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], slow_fingerprint(r["text"] or "")) for r in docs.collect()]
    assert sorted(map(tuple, simhash.op6_simhash(docs).collect()), key=str) == slow_components(rows)
    assert simhash.op6_simhash(empty(spark)).count() == 0


def signed(x):
    return x - (x >> 63 << 64)


def chains(seed, seeds=40, most=30):
    r = random.Random(seed)
    fps = {0}
    for _ in range(seeds):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, most)):  # chains of one to three flips
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    return fps


@pytest.mark.parametrize("crowd,few,hot", [(64, 300_000, 1000), (3, 300_000, 1000), (64, 0, 1), (3, 0, 50)])
def test_links_and_chains_match_brute_force(spark, monkeypatch, crowd, few, hot):
    for name, value in (("CROWD", crowd), ("FEW", few), ("HOT", hot)):
        monkeypatch.setattr(simhash, name, value)
    own = {signed(x): x for x in chains(5)}
    pairs = simhash.links(spark.createDataFrame([(x,) for x in own], "fp long"))
    assert all((own[p["a"]] ^ own[p["b"]]).bit_count() <= 2 for p in pairs.collect())
    roots = {p["node"]: p["root"] for p in simhash.components(pairs).collect()}
    want = slow_components([(i, x) for i, x in enumerate(own.values())])
    group = {int(fp, 16): least for _, fp, least in want}
    ours = {}
    for s, x in own.items():
        ours.setdefault(roots.get(s, s), set()).add(group[x])
    assert all(len(v) == 1 for v in ours.values()) and len(ours) == len(set(group.values()))


def edited(seed, bases=6, edits=4):
    """Long texts and copies of them with a few words changed: their fingerprints are apart by few bits."""
    r = random.Random(seed)
    texts = []
    for _ in range(bases):
        words = [f"w{r.randrange(5000)}" for _ in range(1500)]
        for _ in range(edits):
            texts.append(" ".join(words))
            words[r.randrange(1500)] = "other"
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("few,hot", [(300_000, 1000), (0, 50)])
def test_the_least_fingerprint_of_a_component_shares_its_id(spark, monkeypatch, few, hot):
    for name, value in (("FEW", few), ("HOT", hot)):
        monkeypatch.setattr(simhash, name, value)
    texts = edited(6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(list(enumerate(fps)))
    groups = {}
    for doc, _, least in want:
        groups.setdefault(least, set()).add(signed(fps[doc]))
    owners = [signed(fps[least]) == min(g) for least, g in groups.items() if len(g) > 1]
    assert any(owners) and not all(owners)  # the least id is that of the least fingerprint in some components only
    assert sorted(map(tuple, simhash.op6_simhash(docs).collect()), key=str) == want
    pairs = simhash.links(spark.createDataFrame([(x,) for x in {signed(f) for f in fps}], "fp long"))
    assert {p["node"] for p in simhash.components(pairs).collect()} == {x for p in pairs.collect() for x in p}


def test_pivots_discard_most_candidates_and_no_link(spark):
    """Fingerprints that share 32 bits and differ at random in the others: only the pivot tables keep them apart."""
    r = random.Random(3)
    fps = set()
    for _ in range(60):
        head = r.getrandbits(32) << 32
        cluster = [head | r.getrandbits(32) for _ in range(40)]
        fps.update(cluster + [x ^ 1 << r.randrange(64) for x in cluster[:5]])
    own = {signed(x): x for x in fps}
    keys = simhash.keyed(spark.createDataFrame([(x,) for x in own], "fp long"))
    sizes = keys.groupBy("band", "key").count().where("count > 1")
    met = keys.join(sizes, ["band", "key"])
    candidates = sum(r["count"] * (r["count"] - 1) // 2 for r in sizes.collect())
    kept = {(p["a"], p["b"]) for p in simhash.survivors(simhash.groups(met)).collect()}
    values = list(own.items())
    links = {(max(a, b), min(a, b)) for i, (a, x) in enumerate(values) for b, y in values[:i] if (x ^ y).bit_count() <= 2}
    assert candidates > 40_000 and len(kept) < candidates / 50
    assert links <= kept


def test_a_ball_of_near_fingerprints_makes_no_square_of_pairs(spark):
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {signed(centre ^ (1 << i) ^ (1 << j)) for i in range(64) for j in range(i)} | {signed(centre)}
    pairs = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert pairs.count() < 80 * len(fps)
    assert simhash.components(pairs).select("root").distinct().count() == 1


def test_one_of_each(spark):
    docs = documents(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = simhash.near_dup_groups(docs).collect()
    want = {}
    for r in rows:
        own = (r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"])
        want[r["root"]] = min(want.get(r["root"], own), own)
    got = kept.select(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert sorted(map(tuple, got)) == sorted(want.values())
    assert simhash.one_of_each(empty(spark)).count() == 0
