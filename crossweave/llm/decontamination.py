"""Benchmark decontamination by an FM-index for each shard of training texts.

A shard is some documents of one partition, at most SHARD_WORDS words (or one document). Its words become the numbers of the benchmark's words;
runs of such words that are long enough to hold a test phrase are indexed (words the benchmark doesn't have can't be part of a match). Test phrases
- 10 consecutive words of an item, or the whole of a shorter one - are searched backwards by wavelet-tree ranks, occurrences are located by
sampled suffix positions, and the spans of each document are merged.

The benchmark goes to the executors in parts of at most ITEM_WORDS words (or one item); a larger one takes several passes, which add up.

Null or empty texts have no words; an item without words has no phrase; an item with a null id counts as an item named by the empty string.
Equal rows, of documents or items, give equal results; items that share an id count once. Empty tables give empty or clean results. Other
columns take no part in the search, whatever their names, and pass through `remove_spans` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.common import binary_text, stored, tidied, words
from crossweave.llm.fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 1_000_000
ITEM_WORDS = 1_000_000
HITS = "struct<n_words:long,spans:array<struct<start:int,stop:int>>,items:array<string>>"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Phrases:
    """The test phrases of some items, as arrays. A pickled one has the items' words only, four bytes each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        index = {name: i for i, name in enumerate(self.names)}
        held = []
        for name, text in items:
            if ws := words(text):
                held.append((index[name], np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws), np.int32, len(ws))))
        self.window, self.vocabulary = window, vocabulary
        self.item = np.array([i for i, _ in held], np.int32)
        self.size = np.array([len(x) for _, x in held], np.int64)
        self.flat = np.concatenate([np.empty(0, np.int32), *(x for _, x in held)])
        self._index()

    def _index(self) -> None:
        begin = np.cumsum(self.size) - self.size
        many = np.maximum(self.size - self.window + 1, 1)  # phrases of each item
        upto = np.cumsum(many)
        start = np.repeat(begin - (upto - many), many) + np.arange(many.sum())
        length, item = np.repeat(np.minimum(self.size, self.window), many), np.repeat(self.item, many)
        self.least = int(length.min(initial=self.window))
        self.groups = []  # by length: the phrases, and the items of each, as items from `first` of a phrase to that of the next
        for n in np.unique(length).tolist():
            some = length == n
            rows = self.flat[start[some][:, None] + np.arange(n)]
            order = np.lexsort((item[some], *rows.T[::-1]))
            rows, items = rows[order], item[some][order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
            keep = new | np.concatenate([[True], items[1:] != items[:-1]])
            self.groups.append((rows[new], np.append(np.flatnonzero(new[keep]), int(keep.sum())), items[keep]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("groups", "least")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def search(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of phrase: starts of occurrences in ids (0: no benchmark word), the length, the phrase of each start, and the items of phrases as `groups` has them."""
        if not self.groups or not len(ids):
            return
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
        first, size = edge[::2], edge[1::2] - edge[::2]
        first, size = first[size >= self.least], size[size >= self.least]
        if not len(first):
            return
        starts = np.cumsum(size) - size
        origin = np.repeat(first - starts, size) + np.arange(size.sum())
        index = FMIndex(ids[origin], starts, len(self.vocabulary))
        for patterns, firsts, items in self.groups:
            which, lo, hi = index.ranges(patterns)
            many = hi - lo
            rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            yield origin[index.locate(rows)], patterns.shape[1], np.repeat(which, many), firsts, items


def scan(texts: list[bytes], phrases: Phrases, shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: words, merged spans of hit words, ids of items found."""
    held: list[np.ndarray] = []
    total = 0

    def flush() -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        sizes = np.array([len(x) for x in held])
        begins = np.cumsum(sizes + 1) - sizes - 1
        ids = np.concatenate([np.append(x, 0) for x in held]) if held else np.empty(0, np.int64)
        change = np.zeros(len(ids) + 1, np.int32)
        found: dict[int, set[int]] = {}
        for at, length, phrase, firsts, items in phrases.search(ids):
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            docs = np.searchsorted(begins, at, side="right") - 1
            for d, p in np.unique(np.stack([docs, phrase]), axis=1).T.tolist():
                found.setdefault(d, set()).update(items[firsts[p] : firsts[p + 1]].tolist())
        hit = np.cumsum(change)[:-1] > 0
        for d, (b, n) in enumerate(zip(begins.tolist(), sizes.tolist(), strict=True)):
            if d in found:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[b : b + n].view(np.int8), [0]]))).tolist()
                yield n, list(zip(edge[::2], edge[1::2], strict=True)), [phrases.names[i] for i in sorted(found[d])]
            else:
                yield n, [], []
        held.clear()

    for text in texts:
        ws = words(text)
        held.append(np.fromiter(map(phrases.vocabulary.get, ws, repeat(0)), np.int64, len(ws)))
        total += len(ws)
        if total >= shard_words:
            yield from flush()
            total = 0
    yield from flush()


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of two lists of spans; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for s, t in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(t, out[-1][1]))
        else:
            out.append((s, t))
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s, t in spans:
        out.append(text[last : at[s][0]].rstrip())
        last = at[t - 1][1]
    return b"\n".join(x for x in [*out, text[last:].strip()] if x)


def batched_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = ITEM_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in parts of at most `most` words, or one item, read one partition at a time."""
    part, size = [], 0
    for r in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), binary_text(text_col).alias("t")).toLocalIterator():
        n = len(words(r.t))
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((r.i, bytes(r.t)))
        size += n
    yield part


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = ITEM_WORDS) -> DataFrame:
    """The columns `keep` and `hits`: n_words, spans of hit words [start, stop), items found."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), binary_text(text_col).alias("body"), F.lit(None).cast(HITS).alias("hits"))
    schema = df.schema
    for part in batched_items(items, most=most):
        df = df.mapInArrow(tidied(_finder(Phrases(part))), schema)
    return df.select("row.*", "hits")


def _finder(phrases: Phrases) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for old, (n, spans, names) in zip(batch.column("hits").to_pylist(), scan(batch.column("body").to_pylist(), phrases), strict=True):
                if old:
                    spans = merge(spans, [(x["start"], x["stop"]) for x in old["spans"]])
                    names = sorted({*names, *old["items"]})
                out.append({"n_words": n, "spans": [{"start": s, "stop": t} for s, t in spans], "items": names})
            kind = batch.schema.field("hits").type
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("body"), pa.array(out, kind)], ["row", "body", "hits"])

    return run


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", chars_col: str = "n_chars", most: int = ITEM_WORDS) -> DataFrame:
    """docs with the spans cut from their texts (and the count of characters, where there is such a column, set anew); all columns stay.

    A text is searched again after a cut, until nothing is found: what a cut brings together may match. A document left without words goes. Items of
    several parts are all searched for before a cut, so that the parts give the rows of one.
    """
    schema = docs.schema
    counts = chars_col if chars_col in docs.columns else None

    def cutter(phrases: Phrases) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [(x or "").encode() for x in batch.column(text_col).to_pylist()]
                changed: dict[int, bytes] = {}
                todo = list(range(len(texts)))
                while todo:
                    now = [changed.get(i, texts[i]) for i in todo]
                    hit = [(i, cut_spans(t, spans)) for i, t, (_, spans, _) in zip(todo, now, scan(now, phrases), strict=True) if spans]
                    changed.update(hit)
                    todo = [i for i, _ in hit]
                if changed:
                    gone = np.array([i in changed and not words(changed[i]) for i in range(len(texts))])
                    for name in filter(None, (text_col, counts)):
                        k = batch.schema.get_field_index(name)
                        old = batch.column(k).to_pylist()
                        for i, t in changed.items():
                            old[i] = t.decode() if name == text_col else len(t.decode())
                        batch = batch.set_column(k, batch.schema.field(k), pa.array(old, batch.schema.field(k).type))
                    batch = batch.filter(pa.array(~gone))
                yield batch

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(schema.names, batch.column("doc").flatten(), strict=True))
            spans = [[(x["start"], x["stop"]) for x in s] for s in batch.column("spans").to_pylist()]
            texts = [cut_spans(t.encode(), s).decode() for t, s in zip(columns[text_col].to_pylist(), spans, strict=True)]
            columns[text_col] = pa.array(texts, columns[text_col].type)
            if counts:
                columns[counts] = pa.array(list(map(len, texts)), columns[counts].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema.names).filter(pa.array([bool(words(t.encode())) for t in texts], pa.bool_()))

    parts = batched_items(items, most=most)
    first = next(parts)
    if next(parts, None) is None:
        return docs.mapInArrow(tidied(cutter(Phrases(first))), schema)
    clean, todo = [], docs
    while True:
        whole = todo.select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("doc"), F.col(text_col).alias("text"))
        found = stored(find(whole, items, keep=("doc",), most=most), "spans")
        clean.append(found.filter("size(hits.spans) = 0").select("doc.*"))
        hit = found.filter("size(hits.spans) > 0")
        if hit.isEmpty():
            return reduce(DataFrame.union, clean)
        todo = hit.select("doc", F.col("hits.spans").alias("spans")).mapInArrow(cut, schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    found = find(docs, items).select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


QUERIES = {"op1_decontamination": op1_decontamination}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
        phrases AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM phrases),
        grams AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
        found AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN phrases p ON g.phrase = p.phrase AND g.n = p.n),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
