"""Near-duplicate groups by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits, one vote per shingle. Two fingerprints that differ in at most 4 bits agree, in at least one of 3 segments, but for at
most one bit. So each distinct fingerprint is indexed under 64 keys: its segment with one bit left out, for each bit of each segment. Equal keys
meet by one shuffle of (key, fingerprint), and candidates are verified by their full distance. Copies share a fingerprint and count once, so
a group of copies of any size adds one entry.

In a bucket of equal keys only the links of a spanning forest are put out, not all pairs: entries already reached are not compared again. So a
bucket full of near copies costs about one comparison an entry, and no link between different groups is lost. A bucket of more than LARGE entries
is indexed once more by the same variants of the bits outside its segment, so that entries that met by chance are not compared with each other.

Null and empty texts have the fingerprint zero and link like any other. Texts shorter than a shingle are one shingle. Null ids are kept as
rows and never name a component that has another id. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.llm.common import binary_text, bounded, components, salt, salts, stored, tidied, whole_buckets, with_group

SHINGLE, DISTANCE = 4, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # start and length; one segment differs in at most DISTANCE // 3 = 1 bits
CHUNK = 1 << 14
LARGE = 1 << 12  # entries of a bucket that is indexed again
BLOCK = 256  # entries that meet in it and are compared place by place


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """SimHash of the k-word shingles of a text, A-Z lower-cased, words split at ASCII white space."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: ASCII letters and white space only
    if not found:
        return 0
    n = max(1, len(found) - k + 1)
    parts = map(b" ".join, zip(*(found[i:] for i in range(k)), strict=False)) if len(found) >= k else iter([b" ".join(found)])
    votes, left = np.zeros(64, np.int64), n
    hashes = map(xxh64_intdigest, parts, repeat(42))
    while left:
        h = np.fromiter(hashes, np.uint64, min(left, CHUNK))
        votes += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
        left -= len(h)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, body_hash, fp (as a signed long) of every row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(binary_text(text_col)).alias("body_hash"), binary_text(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column("body")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("body_hash"), pa.array(fps)], ["doc_id", "body_hash", "fp"])

    return base.mapInArrow(tidied(run), "doc_id long, body_hash long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): a row for each segment and left-out bit; a key names both."""
    out = []
    for start, length in SEGMENTS:
        segment = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << length) - 1).cast("long"))
        for i in range(length):
            out.append((F.lit((start + i) << 22).cast("long") + segment.bitwiseAND(F.lit(((1 << length) - 1) ^ (1 << i)).cast("long"))).cast("int"))
    return fps.select(F.explode(F.array(*out)).alias("key"), "fp")


def forest(x: np.ndarray, most: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (from, to) of a spanning forest of the graph that joins entries of x within `most` bits; x is distinct."""
    rest, out = x, []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[: max(1, (1 << 21) // len(rest))], front[max(1, (1 << 21) // len(rest)) :]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= most
            hit = near.any(axis=0)
            if hit.any():
                out.append((block[near[:, hit].argmax(axis=0)], rest[hit]))
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return out


class Groups:
    """Groups of entries 0..n-1, and the links that made them."""

    def __init__(self, n: int):
        self.root = np.arange(n)  # of each entry, the least entry of its group
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links entries a and b, but for those that are in one group already."""
        apart = self.root[a] != self.root[b]
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        self.links.append((a, b))
        root = self.root
        while (apart := root[a] != root[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while not np.array_equal(over := root[root], root):
                root = over
        self.root = root


def large_forest(x: np.ndarray, segment: tuple[int, int], most: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """As forest, for many entries that agree in a segment but for a bit. Those within `most` bits agree, but for a bit, in one of three parts of the other bits too."""
    start, length = segment
    other = (x & np.uint64((1 << start) - 1)) | (x >> np.uint64(start + length) << np.uint64(start))
    cuts = [(64 - length) * k // 3 for k in range(4)]
    groups = Groups(len(x))
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = other >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
        for bit in range(high - low):
            key = part & np.uint64(((1 << (high - low)) - 1) ^ (1 << bit))
            by = np.argsort(key, kind="stable")
            key = key[by]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            for s, m in zip(starts[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist(), strict=True):
                some = by[s : s + m]
                if (groups.root[some] != groups.root[some[0]]).any():
                    some = some[np.argsort(x[some])]
                    for a, b in forest(x[some], most):
                        groups.link(some[np.searchsorted(x[some], a)], some[np.searchsorted(x[some], b)])
            small = np.repeat(sizes, sizes) <= BLOCK
            by, bucket = by[small], np.repeat(starts, sizes)[small]
            for k in range(1, int(sizes[sizes <= BLOCK].max(initial=1))):  # each entry and the k-th after it in its bucket
                same = np.flatnonzero(bucket[k:] == bucket[:-k])
                a, b = by[same], by[same + k]
                near = np.bitwise_count(x[a] ^ x[b]) <= most
                groups.link(a[near], b[near])
    return [(x[a], x[b]) for a, b in groups.links]


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) in order of key: links (a, b) within buckets."""
    for key, signed in whole_buckets(batches, ("key", "fp")):
        fp = signed.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE
        found = [(fp[two[near]], fp[two[near] + 1])]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if n > LARGE:
                found += large_forest(fp[s : s + n], next(g for g in SEGMENTS if g[0] <= key[s] >> 22 < g[0] + g[1]))
            else:
                found += forest(fp[s : s + n])
        a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def link_fingerprints(marked: DataFrame) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) within DISTANCE bits into their groups."""
    conf = max(1, int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fps = stored(marked.select("fp").distinct(), "distinct")
    parts = max(conf, fps.counted["rows"] * 64 * 12 >> 26)
    ordered = variants(fps.repartition(conf)).repartition(parts, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(tidied(bucket_links), "a long, b long").distinct()


def fingerprint_roots(marked: DataFrame) -> DataFrame:
    """(id, root): the smallest fingerprint that each linked one reaches."""
    return components(link_fingerprints(marked))


def _grouped(docs: DataFrame, id_col: str, text_col: str, mark: Callable = fingerprints, link: Callable = fingerprint_roots) -> DataFrame:
    """doc_id, body_hash, fp, root (smallest fingerprint of the component), component_id of every row. Rows go to their component by (fingerprint, part of the ids), so that copies spread."""
    parts = salts(docs.sparkSession)
    marked = stored(mark(docs, id_col, text_col).withColumn("_part", salt(F.col("doc_id"), parts)), "fingerprints")
    part = marked.groupBy("fp", "_part").agg(F.min("doc_id").alias("least"))
    roots = link(marked)
    named = part.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tags = with_group(named, "root", "fp", {"component_id": ("min", "least")}).select("fp", "_part", "root", "component_id")
    return marked.select("doc_id", "body_hash", "fp", "_part").join(tags, ["fp", "_part"]).drop("_part")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    return _grouped(docs, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Callable = fingerprints, link: Callable = fingerprint_roots) -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest id; of rows equal in id, the first by text hash and content.

    Ids and text hashes decide; whole rows shuffle only where more of them go than SMALL_TABLE, or where rows are equal in both.
    """
    grouped = _grouped(docs, id_col, text_col, mark, link)
    found = stored(grouped.groupBy("doc_id", "body_hash").agg(F.min("root").alias("root"), F.min("component_id").alias("component_id"), F.count("*").alias("copies")), "groups")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "body_hash")).alias("k"))
    first = stored(first.select(F.col("k.doc_id").alias("k_id"), F.col("k.body_hash").alias("k_hash")), "first")
    same = (F.col("doc_id").eqNullSafe(F.col("k_id"))) & (F.col("body_hash") == F.col("k_hash"))
    stays = found.join(first, same, "left_semi")
    keys = [F.col("doc_id").alias("k_id"), F.col("body_hash").alias("k_hash")]
    goes = stored(found.join(first, same, "left_anti").select(*keys), "dropped")
    repeated = stored(stays.filter("copies > 1").select(*keys), "repeated")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(binary_text(text_col)).alias("body_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for less in (goes, repeated):
        rows, whole = rows.join(bounded(less), same, "left_anti"), rows
    out = rows.select("row.*")
    if not repeated.counted["rows"]:
        return out
    nth = F.row_number().over(Window.partitionBy("doc_id", "body_hash").orderBy(F.to_json("row")))
    return out.unionByName(whole.join(bounded(repeated), same, "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
