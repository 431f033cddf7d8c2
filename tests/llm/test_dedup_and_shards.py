"""Exact dedup, SimHash groups and sharding against brute force."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crossweave.llm import exact_dedup, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, kept string, shard string, fp string"
TEXTS = ["a b c d e", "a b c d e", "A b c d e", "", None, "  ", "one", "x " * 5000 + "y", "x " * 5000 + "z", "a b c d f", "ünï cödé wörds hëre tøø"]
ROWS = [(i, t, "en", "k", "s", "f") for i, t in enumerate(TEXTS)] + [(3, "", "en", "k", "s", "f"), (None, "one", None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_exact_groups_match_brute_force(docs):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for r in ROWS:
        groups.setdefault(r[1] or "", []).append(r[0])
    for r in got:
        sha = r.text_sha256
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == sha)
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (keep, len(ids))
    assert sum(r.kept for r in got) == len(groups)


def test_exact_with_full_filter_is_the_same(spark, docs):
    a = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    assert a == sorted(map(str, exact_dedup.exact_groups(docs, max_bits=1).collect()))


def test_unique_rows_do_not_reach_the_shuffle(spark):
    df = spark.createDataFrame([(i, f"text {i // 2 if i < 20 else i}") for i in range(400)], "doc_id long, text string")
    marked = exact_dedup._marked(df, "doc_id", "text", exact_dedup.MAX_BITS)
    assert 20 <= marked.filter("maybe").count() <= 40


def test_first_pass_finds_the_places_hit_twice_and_shuffles_bitmaps_only(spark):
    rows = 200_000
    ids = spark.range(rows, numPartitions=8)
    unique = ids.select(F.concat(F.lit("text "), "id").alias("body"))
    bits = exact_dedup.filter_bits(rows)
    assert exact_dedup.task_bitmaps(unique, bits).count() <= 2 * 8 * bits // exact_dedup.BITMAP_BITS <= rows // 50
    assert exact_dedup.mark_repeats(unique, exact_dedup.repeated_places(unique, bits), bits).filter("maybe").count() < rows // 20
    few = ids.select(F.concat(F.lit("text "), F.when(F.col("id") % 3 == 0, F.col("id") % 11).otherwise(F.col("id") % 3000)).alias("body")).limit(5000).repartition(5)
    for bits in (exact_dedup.BITMAP_BITS, 8 * exact_dedup.BITMAP_BITS):
        hit = few.select(exact_dedup.bucket(F.col("body"), bits).alias("b"), F.explode(F.array_distinct(F.array(*exact_dedup.places(F.col("body"))))).alias("p")).groupBy("b", "p").count().filter("count > 1")
        want = {(r.b, r.p) for r in hit.collect()}
        got = {(r.bucket, 8 * i + k) for r in exact_dedup.repeated_places(few, bits).collect() for i, x in enumerate(r.bitmap) for k in range(8) if x >> k & 1}
        assert got == want and want


def test_drop_exact_keeps_columns_and_one_row(docs):
    got = exact_dedup.drop_exact(docs)
    assert got.columns == docs.columns
    assert sorted((r.text or "") for r in got.collect()) == sorted({r[1] or "" for r in ROWS})


def brute_fingerprint(text):
    found = [w for w in (text or "").encode().lower().split()]
    if not found:
        return 0
    parts = [b" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or [b" ".join(found)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, most=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("table", ["own", "documents"])
def test_simhash_matches_brute_force(spark, docs, table):
    df = docs if table == "own" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = sorted(zip([str(r.doc_id) for r in rows], [f"{f:016x}" for f in fps], map(str, brute_components([r.doc_id for r in rows], fps)), strict=True))
    assert want == sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_groups(df).collect())


def test_links_of_random_fingerprints_lose_nothing(spark):
    import random

    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(8):
            x = f
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.id: r.root for r in simhash.components(simhash.link_fingerprints(df)).collect()}
    want = brute_components(signed, fps)
    for s, w in zip(signed, want, strict=True):
        assert roots.get(s, s) == w


@pytest.mark.parametrize("segment", simhash.SEGMENTS)
@pytest.mark.parametrize("block", [4, simhash.BLOCK])
def test_large_buckets_lose_nothing(monkeypatch, segment, block):
    """Entries that agree in a segment but for a bit, many of them near: the groups of the second index are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = np.random.default_rng(3)
    start, length = segment
    fixed = np.uint64(((1 << length) - 1) << start)
    x = rnd.integers(0, 1 << 64, 250, np.uint64)
    for _ in range(3):
        x = np.concatenate([x, x ^ (np.uint64(1) << rnd.integers(0, 64, len(x)).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, len(x)).astype(np.uint64))])
    x = np.unique((x & ~fixed) | np.uint64(1 << start) * rnd.integers(0, 2, len(x)).astype(np.uint64))
    links = simhash.large_forest(x, segment)
    assert all((np.bitwise_count(a ^ b) <= simhash.DISTANCE).all() for a, b in links)
    root = {v: v for v in x.tolist()}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        for u, v in zip(a.tolist(), b.tolist(), strict=True):
            root[max(find(u), find(v))] = min(find(u), find(v))
    got = [find(v) for v in x.tolist()]
    assert got == brute_components(x.tolist(), x.tolist())
    assert sum(len(a) for a, _ in links) < 2 * len(x)


def test_drop_near_keeps_one_of_each_group(docs):
    got = simhash.drop_near(docs)
    assert got.columns == docs.columns
    want = {r.component_id for r in simhash.near_groups(docs).collect()}
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in got.collect())


def test_drop_near_keeps_groups_without_ids(spark):
    df = spark.createDataFrame([(None, "one text of some words"), (None, "quite another thing to read"), (None, "one text of some words"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in simhash.drop_near(df).collect()) == ["None", "one text of some words", "quite another thing to read"]


def test_shards_follow_the_law(spark, docs):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text"))
    got = sharding.assign(df, {s: 1.0 for s in range(8)}, {s: 1.0 for s in range(9)}).collect()
    text = {}
    for r in df.collect():
        text.setdefault(r.doc_id, []).append(len((r.text or "").encode()) + 1)
    by = {}
    for r in got:
        assert r.size in text[r.doc_id] and r.grown_shard in (r.shard, 8)
        by.setdefault(r.shard, []).append(r.slot)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    assert 0.05 < sum(r.grown_shard == 8 for r in got) / len(got) < 0.18
    first = df.filter("doc_id = 7").first()
    assert zlib.crc32(first.text.encode()) in {r.text_crc32 for r in got if r.doc_id == 7}
    assert all(math.isfinite(r.slot) and r.law == "key" for r in got)


def test_weights_set_the_share(spark):
    df = spark.range(20000).select("id")
    share = {r.s: r["count"] for r in df.select(sharding.rendezvous(df.id, {0: 1.0, 1: 3.0}).alias("s")).groupBy("s").count().collect()}
    assert 2.7 < share[1] / share[0] < 3.3


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near(none).count() == 0
    assert sharding.assign(none, {0: 1.0}).count() == 0


def test_draws_match_brute_force(spark):
    """The shard of a key by weight / -ln(draw), draws made again from XXH64."""
    def draw(key, shard):
        h = 42
        for kind, x in (("<i", sharding.SEED), *([("<q", key)] if key is not None else []), ("<i", shard)):
            h = xxhash.xxh64_intdigest(struct.pack(kind, x), h)
        return ((h & (1 << 52) - 1) + 0.5) / (1 << 52)

    keys = [None, 0, -1, 1 << 62, *range(1, 2000)]
    for weights in ({s: 1.0 for s in range(8)}, {2: 0.5, 3: 2.0, 7: 1.0}):
        df = spark.createDataFrame([(k,) for k in keys], "id long").select("id", sharding.rendezvous(F.col("id"), weights).cast("int").alias("s"))
        assert {r.id: r.s for r in df.collect()} == {k: max(weights, key=lambda s: (weights[s] / -math.log(draw(k, s)), -s)) for k in keys}


def test_equal_rows_spread_over_chunks(spark):
    df = spark.createDataFrame([(1, "same")] * 4000, "doc_id long, text string").repartition(8)
    got = sharding.assign(df, {0: 1.0, 1: 1.0}).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(4000))
