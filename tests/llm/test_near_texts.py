"""Near-duplicate texts against the Jaccard similarity of all pairs."""

import math
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from crossweave.llm import common, near_texts


def brute_sets(texts):
    found = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in found]


def brute_kept(ids, texts):
    """The smallest id of each component, by all pairs."""
    sets, root = brute_sets(texts), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_stage_keeps_one_of_each_group_of_near_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute_kept([r.doc_id for r in rows], [r.text for r in rows])
    assert want == sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())


def test_edited_copies_of_a_text_meet(spark):
    base = [f"word{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join("new" if i in (k, k + 90) else w for i, w in enumerate(base)) for k in range(60)]
    texts += [" ".join(f"other{k}-{i}" for i in range(50)) for k in range(5)] + [None, "", "  ", "short", "Short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_kept(list(range(len(texts))), texts)
    assert want == sorted(r.doc_id for r in near_texts.drop_near_texts(docs).collect())


def test_clusters_without_a_similar_hub_lose_nothing(spark, monkeypatch):
    """All texts share one cluster, no hub is near all others, and a blob takes many pairs of blocks."""
    monkeypatch.setattr(near_texts, "_clustered", _one_cluster)
    texts = [" ".join(f"g{k}w{i}" if i != v else "x" for i in range(80)) for k in range(8) for v in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1024, 5, 1):
        monkeypatch.setattr(near_texts, "BLOCK", block)
        assert sorted(r.doc_id for r in near_texts.drop_near_texts(docs).collect()) == [3 * k for k in range(8)]


def _one_cluster(batches):
    fps = {x for b in batches for x in b.column("fp").to_pylist()}
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(fps), [7] * len(fps), [24] * len(fps))], ["fp", "hub", "n"])


def test_index_recall_at_the_least_similarity():
    """Pairs of similarity 0.8 to 0.83 share a key, and their sketches are near."""
    rnd = random.Random(5)
    plan = near_texts.scheme(1_000_000)
    pairs = met = 0
    for n in (40, 150, 600):
        for _ in range(150):
            a = [f"w{rnd.random()}" for _ in range(n)]
            b = list(a)
            for i in rnd.sample(range(n), max(1, n // 45)):
                b[i] = f"w{rnd.random()}"
            x, y = near_texts.shingles([" ".join(t).encode() for t in (a, b)])
            both = len(np.intersect1d(x, y))
            if 0.8 <= both / (len(x) + len(y) - both) < 0.83:
                f, g = (np.frombuffer(near_texts.wide_fingerprint(s, plan.words), np.uint8)[None] for s in (x, y))
                near = np.bitwise_count(f[0, :16] ^ g[0, :16]).sum() <= near_texts.SKETCH
                met += bool(near and (near_texts.variants(f, plan) == near_texts.variants(g, plan)).any())
                pairs += 1
    assert pairs > 50 and met / pairs > 0.93


def test_large_buckets_chain_as_small_ones():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, (20, 2), np.uint64)
    sketch = np.concatenate([base[rnd.integers(0, 20, 500)] ^ (np.uint64(1) << rnd.integers(0, 64, (500, 2)).astype(np.uint64)), base, base[:3]])
    large = near_texts.chain(np.zeros(len(sketch), np.int64), sketch)
    at = np.arange(len(sketch))
    near = np.bitwise_count(sketch[:, None] ^ sketch[None, :]).sum(axis=2) <= near_texts.SKETCH
    root = at.copy()
    while True:
        step = np.where(near, root[None, :], len(at)).min(axis=1)
        if (step == root).all():
            break
        root = step
    assert (large == root).all()


def test_schemes_grow_with_the_texts():
    plans = [near_texts.scheme(10**k) for k in range(3, 12)]
    assert plans[0] == near_texts.Scheme(16, 12) and all(p.length <= q.length and p.segments <= q.segments for p, q in zip(plans, plans[1:], strict=False))
    assert all(10**k < 1 << p.length - 1 + near_texts.BY_CHANCE + 1 for k, p in zip(range(3, 12), plans, strict=True))


def test_shingles_match_brute_force():
    texts = ["", " ", "a", "A", "one two three four", "One two\tthree four five", "one two three four five six", "x" * 9000, "é É b c d e f", "one two three four five six " * 3]
    found = near_texts.shingles([t.encode() for t in texts])
    sets = brute_sets(texts)
    assert [len(s) for s in found] == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(found[i], found[j])) == len(sets[i] & sets[j])


def test_chains_take_few_rounds(spark, monkeypatch):
    """The least id of every chain, in rounds by the logarithm of its length, however it is shuffled."""
    rounds = []
    ends = common._ends
    monkeypatch.setattr(common, "_ends", lambda hooks: rounds.append(1) or ends(hooks))
    n, rnd = 256, random.Random(4)
    shuffled = rnd.sample(range(1, n + 1), n)
    for chain in ([*range(2, n + 1), 1], shuffled):
        rounds.clear()
        edges = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long")
        found = common.components(edges).collect()
        assert len(found) == n and {r.root for r in found} == {1} and len(rounds) <= 2 * math.log2(n)
    assert common.components(edges.limit(0)).count() == 0
