"""Near-duplicate texts by similarity: SimHash fingerprints wide enough for it, the deletion-variant index, and a check of whole shingle sets.

Texts link if the Jaccard similarity of their sets of five-word shingles (A-Z lower-cased, words split at ASCII white space) is 0.8 or more. Texts of
one set are one node, so copies count once. At that similarity fingerprints differ in about 15 % of their bits, far beyond what a 64-bit
fingerprint can index. So a fingerprint has as many segments as it takes for one of them to differ by at most one bit with probability
RECALL, and is indexed, as in op6, under every segment with one bit left out. Segments grow with the logarithm of the number of texts, so that
few texts meet by chance.

1. Texts that share a key, and whose first 128 bits are near, are chained into clusters; what goes on is each text with the cluster's hub. 2. Links to a
cluster's hub, a text near the majority of its bits, are verified on the whole sets, one for each text and one for each cluster of two; verified links make
components. 3. Components that a larger cluster joins are a blob, and all texts of a blob are compared with each other in place, but for those that are
linked already. A blob is dealt out by pairs of blocks of its texts, so that two blocks meet at a time, and
only links are put out.

Null and wordless texts are one node and have no candidates. Texts shorter than a shingle are one shingle. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm import simhash
from crossweave.llm.common import binary_text, bounded, components, portioned, stored, tidied, whole_buckets

WORDS, SIMILARITY = 5, 0.8
FLIP = 0.1515  # share of bits that differ at that similarity: acos(2 s / (1 + s)) / pi
RECALL = 0.98  # of the index, for a pair of just that similarity
LEAST_LENGTH, BY_CHANCE = 16, 8  # bits of a segment; 2 ** BY_CHANCE texts of a key may meet by chance
SKETCH = 32  # of the first 128 bits, that texts of a cluster may differ in; 19.4 are expected, with a deviation of 4.1
SMALL = 256  # texts of a bucket that are compared place by place
BLOCK = 256  # texts of a blob that are compared with as many others by one task
EMPTY = 0  # the node without words
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
_BYTES = np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Scheme:
    """Segments of a fingerprint, and bits in each."""

    length: int
    segments: int

    @property
    def words(self) -> int:
        return -(-self.length * self.segments // 64)


def scheme(texts: int) -> Scheme:
    length = max(LEAST_LENGTH, int(texts).bit_length() - BY_CHANCE)
    meets = (1 - FLIP) ** length + length * FLIP * (1 - FLIP) ** (length - 1)
    return Scheme(length, ceil(log(1 - RECALL) / log(1 - meets)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its shingles, sorted, each once. Words are hashed as polynomials of their bytes, all texts at once."""
    raw = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    ink = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ink, [False]]).view(np.int8)))
    first, stop = edge[::2], edge[1::2]
    if len(first):
        ink_at = np.flatnonzero(ink)
        size = stop - first
        place = np.arange(len(ink_at)) - np.repeat(np.cumsum(size) - size, size)
        word = _mix(np.add.reduceat(_BYTES[raw[ink_at]] * _power(place), np.cumsum(size) - size))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends)
    out = []
    for a, b in zip([0, *upto.tolist()], upto.tolist(), strict=False):
        if a == b:
            out.append(np.empty(0, np.uint64))
            continue
        k = min(WORDS, b - a)
        h = np.full(b - a - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix(h * _MULTIPLIER + word[a + i : b - k + i + 1])
        h.sort()
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
    return out


def _power(place: np.ndarray) -> np.ndarray:
    low = _POWERS[place & 0xFFF]
    return low if not len(place) or place.max() < 1 << 12 else low * _mix((place >> 12).astype(np.uint64) | np.uint64(1 << 63))


def node(found: np.ndarray) -> int:
    """A number for a set of shingles, as a signed long; EMPTY for the empty set."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(found.tobytes(), 7) if len(found) else EMPTY
    return x - (1 << 64) if x >> 63 else x


def wide_fingerprint(found: np.ndarray, words: int) -> bytes:
    """SimHash of a set of shingles: a bit is 1 if it is in over half of the shingles' hashes."""
    bits = _mix(found[:, None] + np.arange(1, words + 1, dtype=np.uint64) * _MULTIPLIER)
    bits = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
    votes = np.zeros(bits.shape[1], np.int64)
    for i in range(0, len(bits), 255):
        votes += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(bits), bitorder="little").tobytes()


def nodes(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, body_hash, fp (the node), bits (its wide fingerprint, null without words) of every row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(binary_text(text_col)).alias("body_hash"), binary_text(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portioned(batches, most=1 << 20):
            found = shingles(b.column("body").to_pylist())
            bits = [wide_fingerprint(s, words) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("body_hash"), pa.array(map(node, found), pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "body_hash", "fp", "bits"])

    return base.mapInArrow(tidied(run), "doc_id long, body_hash long, fp long, bits binary")


def variants(bits: np.ndarray, plan: Scheme) -> np.ndarray:
    """The keys of fingerprints (a row of bytes each): a segment without one bit; a key names both."""
    n, length = plan.segments, plan.length
    each = np.unpackbits(bits, axis=1, bitorder="little")[:, : n * length].reshape(len(bits), n, length)
    segment = each.astype(np.int64) @ (np.int64(1) << np.arange(length, dtype=np.int64))
    name = np.arange(n * length, dtype=np.int64).reshape(n, length) << length
    return (name + (segment[:, :, None] & ~(np.int64(1) << np.arange(length, dtype=np.int64)))).reshape(len(bits), -1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ; the last axis holds the words of a sketch."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint8)


def reach(sketch: np.ndarray) -> np.ndarray:
    """The least entry that each can be reached from over entries within SKETCH bits; entries already reached are not compared again."""
    root, rest = np.arange(len(sketch)), np.arange(len(sketch))
    while len(rest):
        head, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            n = max(1, (1 << 20) // len(rest))
            block, front = front[:n], front[n:]
            hit = (_apart(sketch[block][:, None], sketch[rest][None]) <= SKETCH).any(axis=0)
            root[rest[hit]] = head
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return root


def chain(bucket: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """For entries in order of their bucket: the least entry of the cluster of each, chained through entries of a bucket within SKETCH bits."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(bucket)))
    small = np.repeat(sizes <= SMALL, sizes)
    groups = simhash.Groups(len(bucket))
    for k in range(1, int(sizes[sizes <= SMALL].max(initial=1))):  # each entry and the k-th after it in its bucket
        a = np.flatnonzero((bucket[k:] == bucket[:-k]) & small[k:])
        near = _apart(sketch[a], sketch[a + k]) <= SKETCH
        groups.link(a[near], a[near] + k)
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        some, first, which = np.unique(sketch[s : s + n], axis=0, return_index=True, return_inverse=True)
        root = reach(some)
        least = np.full(len(some), n)
        np.minimum.at(least, root, first)
        groups.link(s + least[root[which.reshape(-1)]], s + np.arange(n))
    return groups.root


def clusters(key: np.ndarray, fp: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From whole buckets: node, hub and size of cluster of the entries of clusters of two and more.

    Hubs are near the majority of their cluster's bits; of those about as near, the first in one order of all nodes, so that clusters that overlap tend to
    share theirs.
    """
    root = chain(key, sketch)
    by = np.argsort(root, kind="stable")
    root, fp, sketch = root[by], fp[by], sketch[by]
    starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
    sizes = np.diff(np.append(starts, len(root)))
    many = np.repeat(sizes > 1, sizes)
    fp, sketch, sizes = fp[many], sketch[many], sizes[sizes > 1]
    if not len(fp):
        return fp, fp, fp
    starts = np.cumsum(sizes) - sizes
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1)
    most = np.packbits(np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > sizes[:, None], axis=1).view(np.uint64)
    off = _apart(sketch, np.repeat(most, sizes, axis=0)) >> 3
    best = np.lexsort((_mix(fp.view(np.uint64)), off, np.repeat(np.arange(len(sizes)), sizes)))[starts]
    return fp, np.repeat(fp[best], sizes), np.repeat(sizes, sizes)


def _keys(plan: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                b = batch.slice(i, 2048)
                bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                keys = variants(bits, plan)
                sketch = np.ascontiguousarray(bits[:, :16]).view(np.int64)
                offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))], ["fp", "low", "high", "keys"])

    return run


def _clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, fp, low, high in whole_buckets(batches, ("key", "fp", "low", "high")):
        found = clusters(key, fp, np.column_stack([low, high]).view(np.uint64))
        table = pa.table([pa.array(x) for x in found], ["fp", "hub", "n"]).group_by(["fp", "hub"]).aggregate([("n", "max")])
        yield from table.select(["fp", "hub", "n_max"]).rename_columns(["fp", "hub", "n"]).to_batches()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portioned(batches, most=1 << 20):
        found = shingles(b.column("body").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array([s.tobytes() for s in found], pa.binary())], ["fp", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        stays = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            if min(len(s), len(t)) < SIMILARITY * max(len(s), len(t)):
                stays.append(False)
                continue
            z = np.sort(np.concatenate([s, t]))
            common = int((z[1:] == z[:-1]).sum())
            stays.append(common >= SIMILARITY * (len(z) - common))
        yield b.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))


def block_links(fp: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between texts of similarity SIMILARITY and more that join those of different roots; with two sides, only between these."""
    size = np.array([*map(len, sets)])
    starts = np.cumsum(size) - size
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(token.max(initial=0)) + 1, np.int64)
    two = side.any() and not side.all()
    out = []
    for i in np.flatnonzero(side == 0).tolist() if two else range(len(fp)):
        other = root != root[i]
        other &= side == 1 if two else np.arange(len(fp)) > i
        other &= (size >= SIMILARITY * size[i]) & (SIMILARITY * size <= size[i])
        js = np.flatnonzero(other)
        if not len(js):
            continue
        mine = token[starts[i] : starts[i] + size[i]]
        mark[mine] = 1
        n = size[js]
        upto = np.cumsum(n)
        common = np.add.reduceat(mark[token[np.repeat(starts[js] - (upto - n), n) + np.arange(upto[-1])]], upto - n)
        mark[mine] = 0
        for j in js[common >= SIMILARITY * (size[i] + n - common)].tolist():
            if root[j] != root[i]:
                out.append((int(fp[i]), int(fp[j])))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (pair of blocks, side, node, root, set) in order of the pair: links."""
    for pair, rows in whole_buckets(batches, ("pair",), rest=("side", "fp", "root", "shingles")):
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
        links = []
        for a, n in zip(starts.tolist(), np.diff(np.append(starts, len(pair))).tolist(), strict=True):
            some = rows.slice(a, n)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in some.column("shingles")]
            links += block_links(*(some.column(c).to_numpy().copy() for c in ("fp", "root", "side")), sets)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def text_roots(docs: DataFrame, marked: DataFrame, plan: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root): the smallest node that each linked one reaches by verified links. marked: of `nodes`, stored."""
    spark = docs.sparkSession
    conf = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = stored(marked.filter("bits is not null").groupBy("fp").agg(F.first("bits").alias("bits")), "nodes")
    keys = plan.length * plan.segments
    parts = max(conf, known.counted["rows"] * keys * 28 >> 26)
    small = keys << plan.length < 1 << 31
    keyed = known.repartition(conf).mapInArrow(tidied(_keys(plan)), "fp long, low long, high long, keys array<long>").select(F.explode("keys").alias("key"), "fp", "low", "high")
    ordered = keyed.withColumn("key", F.col("key").cast("int" if small else "long")).repartition(parts, "key").sortWithinPartitions("key")
    rows = stored(ordered.mapInArrow(tidied(_clustered), "fp long, hub long, n long").groupBy("fp", "hub").agg(F.max("n").alias("n")), "clusters")
    sets = stored(_bodies(docs, marked, rows.select("fp").distinct(), id_col, text_col).mapInArrow(tidied(_sets), "fp long, shingles binary"), "shingles")

    # a cluster of two is its link; of its larger clusters, a node's link to the hub of the largest is verified
    best = rows.filter("n > 2").groupBy("fp").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    pairs = rows.filter("n = 2").select("fp", "hub").union(best).filter("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a")
    pairs = pairs.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
    found = components(pairs.mapInArrow(tidied(_similar), "a long, b long"))
    roots = found.withColumnRenamed("id", "fp")

    rooted = rows.filter("n > 2 and fp <> hub").join(roots, "fp", "left").select("hub", F.coalesce("root", "fp").alias("a")).distinct()
    rooted = rooted.join(roots.select(F.col("fp").alias("hub"), "root"), "hub", "left").select("a", F.coalesce("root", "hub").alias("b")).filter("a <> b").distinct()
    mixed = stored(rooted, "mixed")
    if not mixed.counted["rows"]:
        return found
    blobs = components(mixed).select(F.col("id").alias("root"), F.col("root").alias("blob"))
    members = rows.select("fp").distinct().join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    blobs = stored(members.join(bounded(stored(blobs, "blob-roots")), "root").select("fp", "blob", "root"), "blobs")
    sizes = blobs.groupBy("blob").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = blobs.join(bounded(stored(sizes, "sizes")), "blob").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    # a block meets itself, and every other one once; the lesser is side 0
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(F.xxhash64("blob", low, high).alias("pair"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "fp", "root")
    dealt = dealt.join(sets, "fp").repartition(conf, "pair").sortWithinPartitions("pair")
    more = stored(dealt.select("pair", "side", "fp", "root", "shingles").mapInArrow(tidied(_blocks), "a long, b long"), "more")
    return components(roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(more)) if more.counted["rows"] else found


def _bodies(docs: DataFrame, marked: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fp, body: a text for each needed node."""
    chosen = marked.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "body_hash")).alias("k"))
    chosen = stored(chosen.select("fp", F.col("k.doc_id").alias("k_id"), F.col("k.body_hash").alias("k_hash")), "chosen")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(binary_text(text_col)).alias("body_hash"), binary_text(text_col).alias("body"))
    rows = rows.join(bounded(chosen), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("body_hash") == F.col("k_hash")))
    return rows.groupBy("fp").agg(F.first("body").alias("body"))


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest id, as simhash.drop_near."""
    plan = scheme(docs.count())
    return simhash.drop_near(docs, id_col, text_col, lambda *of: nodes(docs, plan.words, *of[1:]), lambda marked: text_roots(docs, marked, plan, id_col, text_col))
