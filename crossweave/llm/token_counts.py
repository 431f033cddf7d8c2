"""Edit-aware token counts: a segment tree of pre-tokens for each document.

Leaves hold runs of white-space chunks, with their text; nodes hold sums of code points and tokens. An edit replaces some code points. Only the
leaves that hold the edit and the code point on either side (the boundary context, since a chunk may now go on across the edit) are encoded again; the
sums above are updated along their paths. The count of the whole text is the root's. No edit reads the rest of the text.

Edits are (pos, remove, insert): at code point pos of the text as it then is, remove so many code points and put insert there; they apply in
order, and what lies beyond the end is ignored. Null texts are empty; a null insert is empty; documents without edits keep their counts. Repeated rows
are counted each. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.common import portioned, whole_text
from crossweave.llm.tokens import WordIds, default_path, portions, word_ids

LEAF = 16  # chunks in a leaf
SPLIT = 16 * LEAF  # a leaf of more chunks, after edits, makes the tree be dealt anew
EDIT = "struct<pos:long,remove:long,insert:string>"
_HEAD = struct.Struct("<4sI")
_BODY = 1 << 20  # bytes of text whose trees are edited together


class Tree:
    """Sums of code points and tokens; node 1 is the root, node i has children 2i and 2i + 1, leaves start at `width`."""

    def __init__(self, leaves: list[str], tokens: np.ndarray):
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(leaves), 0] = [*map(len, leaves)]
        self.sums[self.width : self.width + len(leaves), 1] = tokens
        w = self.width
        while w > 1:
            self.sums[w // 2 : w] = self.sums[w : 2 * w : 2] + self.sums[w + 1 : 2 * w : 2]
            w //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(self.leaves)

    def leaf(self, point: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the leaf's first; the last leaf with text for one at or beyond the end."""
        point = max(0, min(point, int(self.sums[1, 0]) - 1))
        i, start = 1, 0
        while i < self.width:
            left = int(self.sums[2 * i, 0])
            i, start, point = (2 * i, start, point) if point < left else (2 * i + 1, start + left, point - left)
        return i - self.width, start

    def cut(self, pos: int, remove: int, insert: str) -> int:
        """Makes an edit in the leaves, of which the first gets the whole region, and returns that leaf. Its tokens are not counted yet."""
        n = int(self.sums[1, 0])
        a = min(max(pos, 0), n)
        b = min(a + max(remove, 0), n)
        (first, start), (last, last_start) = self.leaf(a - 1), self.leaf(b)
        region = self.leaves[first][: a - start] + insert + self.leaves[last][b - last_start :]
        for k in range(first + 1, last + 1):
            self.leaves[k] = ""
            self.put(k, 0, 0)
        self.leaves[first] = region
        return first

    def put(self, leaf: int, size: int, tokens: int) -> None:
        i = leaf + self.width
        change = np.array([size, tokens]) - self.sums[i]
        while i:
            self.sums[i] += change
            i //= 2

    def to_bytes(self) -> bytes:
        return _HEAD.pack(b"CWS2", self.width) + self.sums.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, text: str) -> Tree:
        """A tree from its sums and its text."""
        magic, width = _HEAD.unpack_from(data)
        if magic != b"CWS2":
            raise ValueError("not a tree")
        out = cls.__new__(cls)
        out.width, out.sums = width, np.frombuffer(data, "<i8", 4 * width, _HEAD.size).reshape(-1, 2).astype(np.int64)
        stops = np.cumsum(out.sums[width:, 0]).tolist()
        out.leaves = [text[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out


def build(texts: pa.Array, encoder: WordIds, leaf: int = LEAF) -> list[Tree]:
    """A tree for each text."""
    out = []
    for some in portions(texts):
        _, size, a, b = encoder.chunks(some)
        for text, s, t in zip(some.to_numpy(zero_copy_only=False).tolist(), a.tolist(), b.tolist(), strict=True):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            ink = np.concatenate([[False], (points != 32) & ((points < 9) | (points > 13))])
            cuts = np.flatnonzero(ink[1:] & ~ink[:-1])[leaf::leaf].tolist()
            leaves = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            counts = size[s if ink[1:2].any() else s + 1 : t]  # a text that begins with white space has an empty chunk first
            out.append(Tree(leaves, np.add.reduceat(counts, np.arange(0, len(leaves) * leaf, leaf)) if len(counts) else np.zeros(1, np.int64)))
    return out


def edit(trees: list[Tree], edits: list[list[tuple[int, int, str]]], encoder: WordIds, leaf: int = LEAF) -> list[int]:
    """Applies the edits of each tree to it, in order; returns the tokens that were counted again for each. Regions of many trees are encoded at once."""
    again = [0] * len(trees)
    for k in range(max(map(len, edits), default=0)):
        todo = [i for i, e in enumerate(edits) if len(e) > k]
        firsts = [trees[i].cut(*edits[i][k]) for i in todo]
        regions = [trees[i].leaves[f] for i, f in zip(todo, firsts, strict=True)]
        for i, f, region, n in zip(todo, firsts, regions, encoder.lengths(pa.array(regions, pa.string())).tolist(), strict=True):
            trees[i].put(f, len(region), n)
            again[i] += n
            if len(region) > SPLIT and len(region.split()) > SPLIT:
                trees[i] = build(pa.array([trees[i].text()], pa.string()), encoder, leaf)[0]
    return again


def _log(column: pa.Array) -> list[list[tuple[int, int, str]]]:
    return [[(e["pos"] or 0, e["remove"] or 0, e["insert"] or "") for e in x or [] if e is not None] for x in column.to_pylist()]


def count_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, body (the text), tree, n_tokens of every row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in portioned(batches, most=_BODY):
            trees = build(batch.column("body"), encoder)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array([t.to_bytes() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())], ["doc_id", "body", "tree", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body")).mapInArrow(run, "doc_id long, body string, tree binary, n_tokens long")


def edit_counts(trees: DataFrame, path: str | None = None) -> DataFrame:
    """From `count_trees` with a column edits (array of EDIT): doc_id, body, tree, n_before, n_tokens, n_recounted after the edits."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in portioned(batches, most=_BODY):
            trees = [Tree.from_bytes(data.as_py(), body.as_py()) for data, body in zip(batch.column("tree"), batch.column("body"), strict=True)]
            again = edit(trees, _log(batch.column("edits")), encoder)
            made = [pa.array([t.text() for t in trees], pa.string()), pa.array([t.to_bytes() for t in trees], pa.binary()), batch.column("n_tokens"), pa.array([t.tokens for t in trees], pa.int64()), pa.array(again, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "body", "tree", "n_before", "n_tokens", "n_recounted"])

    return trees.mapInArrow(run, "doc_id long, body string, tree binary, n_before long, n_tokens long, n_recounted long")


def count_edits(docs: DataFrame, edits: F.Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Both at once, where the trees need not be kept: doc_id, n_before, n_after, n_recounted, tree_nodes (of the tree after the edits). edits: a column of `body`."""
    path = path or default_path()
    names = ["doc_id", "n_before", "n_after", "n_recounted", "tree_nodes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in portioned(batches, most=_BODY):
            trees = build(batch.column("body"), encoder)
            before = [t.tokens for t in trees]
            again = edit(trees, _log(batch.column("edits")), encoder)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (before, [t.tokens for t in trees], again, [2 * t.width for t in trees]))], names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body")).withColumn("edits", edits)
    return base.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def derived_edits(body: str | F.Column = "body", n: int = 3) -> F.Column:
    """n edits for a text, from its checksum: a stand-in for an edit log, so that the query needs no other table."""

    text = F.col(body) if isinstance(body, str) else body

    def one(k: int) -> F.Column:
        at = F.pmod(F.xxhash64(F.crc32(text.cast("binary")), F.lit(k)), F.octet_length(text) + F.lit(1))
        return F.struct(at.alias("pos"), F.lit(4 * k).cast("long").alias("remove"), F.lit(("re", " new words ", "")[k % 3]).alias("insert"))

    return F.array(*[one(k) for k in range(n)])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, before and after three edits; tree_nodes: nodes of its tree."""
    return count_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), derived_edits())


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE_SQL: dict[str, str] = {}
