"""Repeated passages: every byte that a window of THRESHOLD bytes covers is removed, if that window also starts in a document with a smaller id.

Suffixes are ordered through THRESHOLD bytes only, by most-significant-digit passes over all documents at once. A pass deals the suffixes that are left by
their next digit, sorts them, and keeps those whose group has more than one document; groups equal to the last digit are exactly the repeated windows.
Sorting a suffix for each byte would shuffle many times the text, so that suffixes which share their first digit in the same way go together:

1. The first digit of a window are FIRST bytes at its sync place, the place of the smallest hash among its FIRST-byte strings. Equal windows have the same
   sync place, and neighbouring windows mostly share one: such a run of windows is a cell, some 14 bytes of starts. A cell whose digit only one document has is done.
2. Equal cells (all bytes that their windows cover) get the smallest id that has one. Windows of all others that have the cell are repeated, as a whole.
3. What is left of a passage are the cells at its ends: of each distinct cell, its first document takes part. Windows at nine consecutive starts share all but
   eight bytes: that is the third digit, and windows whose digit only one document has are done.
4. The last digit is the rest of the window: equal windows get the smallest id that has one.

Each pass moves one row for each digit and block (some BLOCK bytes of text), never a row for each document: a passage that a third of all documents holds is one
row a block. Passes 1 and 3 only prune; 2 and 4 compare 128 bits of two hashes with random tables. Texts are dealt once, to a table bucketed by block,
which later passes read without another shuffle. Nothing goes to the driver but the number of bytes.

Null texts are empty; texts shorter than a window lose nothing. Rows without an id neither lose bytes nor cause it. Rows of one id don't affect each other, so that
repeated rows stay as they are; each row gives one. Very long texts are blocks of their own. An empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.common import binary_text, bounds, stored, table_path, tidied

#: Bytes of a window, those of its first digit, and starts of windows that share the third digit.
THRESHOLD, STARTS, RUNS = 50, 9, 3
#: Bytes of text that are handled at once, and that a bucket of the stored texts holds at least once there are more than a shuffle has partitions.
BLOCK, BUCKET, MOST_BUCKETS = 1 << 20, 256 << 20, 100_000
STRIP = 1 << 14  # places whose hashes are compared at once
#: Low bits of a hash that give way to the place, so that the first of equal ones is the smallest.
PLACE = np.uint64((1 << 31) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "block long, ids array<long>, texts array<binary>"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Random 64-bit values of bytes, for two hashes."""
    rng = np.random.default_rng(50)
    return rng.integers(0, 1 << 64, (2, 256), np.uint64), np.array([0x5851F42D4C957F2D, 0xD1342543DE82EF95], np.uint64)


@cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash's factor, and of its inverse modulo 2^64."""
    factor = int(_tables()[1][which])
    out = []
    for x in (factor, pow(factor, -1, 1 << 64)):
        powers = np.full(size, x, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """x, a new array, with its bits mixed."""
    x ^= x >> np.uint64(31)
    x *= _ODD
    x ^= x >> np.uint64(29)
    return x


class Hashes:
    """Hashes of any stretches of a byte array, from sums over its beginnings."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(20, int(len(data)).bit_length())
        powers, self.inverse = _powers(which, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_tables()[0][which][data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def all(self, n: int, a: int, b: int) -> np.ndarray:
        """Of the stretches of n bytes that begin from a to before b."""
        return _mixed((self.sums[a + n : b + n] - self.sums[a:b]) * self.inverse[a:b])


class Block:
    """The cells of some texts. ids: their documents' ids, null for none."""

    def __init__(self, ids: pa.Array, texts: pa.Array, threshold: int):
        kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.begin, self.end = at[:-1] - at[0], at[1:] - at[0]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.threshold, self.first = threshold, threshold - STARTS * RUNS + 1
        self._hash: dict[int, Hashes] = {}
        self._cut()

    def hashed(self, which: int) -> Hashes:
        if which not in self._hash:
            self._hash[which] = Hashes(self.data, which)
        return self._hash[which]

    def _cut(self) -> None:
        """text, lo, hi, sync, digit: of each cell its text, its first and last window's start, their sync place, and the first digit."""
        n, most = len(self.data) - self.threshold + 1, STARTS * RUNS
        if n <= 0:
            self.text = self.lo = self.hi = self.sync = np.empty(0, np.int64)
            self.digit = np.empty(0, np.uint64)
            return
        place, grams = np.empty(n, np.int64), self.hashed(0)
        for a in range(0, n, STRIP):  # in strips that stay in a processor's cache
            b = min(n, a + STRIP)
            least = (grams.all(self.first, a, b + most - 1) & ~PLACE) | np.arange(a, b + most - 1, dtype=np.uint64)
            width = 1
            while 2 * width <= most:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            least = np.minimum(least[: b - a], least[most - width : most - width + b - a])
            place[a:b] = least & PLACE
        new = np.empty(n, bool)
        new[0], new[1:] = True, place[1:] != place[:-1]
        new[self.begin[self.begin < n]] = True
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], n) - 1
        text = np.searchsorted(self.end, lo, side="right")
        hi = np.minimum(hi, self.end[text] - self.threshold)
        keep = (hi >= lo) & self.known[text]
        self.text, self.lo, self.hi = text[keep], lo[keep], hi[keep]
        self.sync = place[self.lo]
        self.digit = grams.of(self.sync, self.sync + self.first).view(np.int64)

    def doc(self) -> np.ndarray:
        """Of each cell, its document's id."""
        return self.ids[self.text]

    def select(self, keep: np.ndarray) -> None:
        self.text, self.lo, self.hi, self.sync, self.digit = (x[keep] for x in (self.text, self.lo, self.hi, self.sync, self.digit))

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of all bytes of each cell, and of where its windows and their sync place are in it."""
        shape = ((self.sync - self.lo) * 64 + (self.hi - self.lo)).astype(np.uint64)
        return tuple(_mixed(self.hashed(i).of(self.lo, self.hi + self.threshold) + shape * _ODD).view(np.int64) for i in (0, 1))

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """cell and k of all pairs such that the cell has windows that begin STARTS * k to STARTS * (k + 1) - 1 bytes before the sync place."""
        a, b = (self.sync - self.hi) // STARTS, (self.sync - self.lo) // STARTS
        cell = np.repeat(np.arange(len(a)), b - a + 1)
        first = np.cumsum(b - a + 1) - (b - a + 1)
        return cell, np.arange(len(cell)) - first[cell] + a[cell]

    def shared(self, cell: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The third digit: the bytes that all windows of a stretch have, and the stretch's place."""
        at = self.sync[cell] - STARTS * k
        # a text's first cells have no windows that begin as early as the stretch does, but what the others share lies within the text
        return (self.hashed(0).of(at, at + self.threshold - STARTS + 1) + k.astype(np.uint64) * _ODD).view(np.int64)

    def windows(self, cell: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """cell and start of the windows of stretches."""
        a = np.maximum(self.lo[cell], self.sync[cell] - STARTS * (k + 1) + 1)
        b = np.minimum(self.hi[cell], self.sync[cell] - STARTS * k)
        n = b - a + 1
        first = np.cumsum(n) - n
        return np.repeat(cell, n), np.arange(int(n.sum())) + np.repeat(a - first, n)

    def window_keys(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.hashed(i).of(start, start + self.threshold).view(np.int64) for i in (0, 1))


def smallest(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows by key: a row of each key, in order of keys; the key's smallest document; whether it has more than one; and each row's key by number."""
    order = np.argsort(keys[0])
    new, rest = _changes(keys[0][order]), np.zeros(len(order), bool)
    for k in keys[1:]:
        rest |= _changes(k[order])
    if (rest & ~new).any():  # keys that differ in their second half only
        order = np.lexsort(keys[::-1])
        new = np.any([_changes(k[order]) for k in keys], axis=0)
    at = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    if not len(at):
        return at, doc[at], new, number
    least = np.minimum.reduceat(doc[order], at)
    return order[at], least, least != np.maximum.reduceat(doc[order], at), number


def _changes(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """All texts in blocks, in a table of the shared folder that is bucketed by block."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, k in bounds(batch.column("body"), most):
                some = [pa.ListArray.from_arrays(pa.array([0, k], pa.int32()), batch.column(c).slice(i, k)) for c in ("id", "body")]
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), *some], ["block", "ids", "texts"])
                n += 1

    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET))
    name = f"crossweave_texts_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(run, BLOCKS).repartition(buckets, "block").write.format("parquet").bucketBy(buckets, "block")
    # rows are large: look at a page's and a row group's size after each, and not after a hundred
    writer = writer.option("compression", "zstd").option("parquet.page.size.row.check.min", "1").option("parquet.block.size.row.check.min", "1").option("parquet.block.size", str(32 << 20))
    writer.option("path", table_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def _told(found: dict[str, DataFrame], blocks: DataFrame) -> DataFrame:
    """blocks, each with the answers of earlier passes as arrays, null for none."""
    for name, rows in found.items():
        one = F.struct(*[c for c in rows.columns if c != "block"])
        mine = rows.groupBy("block").agg(F.collect_list(one).alias(name))
        blocks = blocks.join(mine.hint("shuffle_hash"), "block", "left")
    return blocks


def _answers(batch: pa.RecordBatch, i: int, names: list[str]) -> dict[str, dict[str, np.ndarray] | None]:
    """Of a block's row, the answers of earlier passes by name: their columns, or None where there is none."""
    found = {c: batch.column(c)[i].values for c in names}
    return {c: None if x is None else {f.name: x.field(f.name).to_numpy(zero_copy_only=False) for f in x.type} for c, x in found.items()}


def _each(blocks: DataFrame, do: Callable[[Block, dict], dict[str, np.ndarray]], kinds: str, threshold: int) -> DataFrame:
    """Rows that `do` makes of each block and the answers beside it."""
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [c for c in batch.schema.names if c not in ("block", "ids", "texts")]
            for i in range(batch.num_rows):
                block = Block(batch.column("ids")[i].values, batch.column("texts")[i].values, threshold)
                out = do(block, _answers(batch, i, told))
                n = len(next(iter(out.values())))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(out[c]) if c in out else pa.array(np.full(n, batch.column("block")[i].as_py())) for c in names], names)

    return blocks.mapInArrow(tidied(run), kinds)


def _kept_in_several(rows: DataFrame) -> DataFrame:
    """block and k of digits that stand in more than one block, or in several documents of one. rows: block, k, several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose successor isn't known: k, block, whether it is already known to be shared
        for batch in batches:
            if not batch.num_rows:
                continue
            k, block, yes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "block", "several"))
            if held is not None:
                k, block, yes = np.append(held[0], k), np.append(held[1], block), np.append(held[2], yes)
            else:
                yes = yes.copy()
            same = k[1:] == k[:-1]
            yes[1:] |= same
            yes[:-1] |= same
            held = k[-1:], block[-1:], yes[-1:]
            keep = np.flatnonzero(yes[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(k[keep])], ["block", "k"])
        if held is not None and held[2][0]:
            yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[0])], ["block", "k"])

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, "block long, k long")


def _smaller_elsewhere(rows: DataFrame) -> DataFrame:
    """block, k1, k2, least for keys of which another block has a smaller document. rows: block, k1, k2, doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, k1, k2, doc = (batch.column(c).to_numpy() for c in ("block", "k1", "k2", "doc"))
            new = np.empty(len(doc), bool)
            new[0] = last is None or (k1[0], k2[0]) != last[:2]
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            least = np.where(begin < 0, last[2] if last else 0, doc[begin])
            last = k1[-1], k2[-1], least[-1]
            keep = np.flatnonzero(least < doc)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (block, k1, k2, least)], ["block", "k1", "k2", "least"])

    return rows.repartition("k1").sortWithinPartitions("k1", "k2", "doc").mapInArrow(run, "block long, k1 long, k2 long, least long")


def _least(keys: tuple[np.ndarray, np.ndarray], doc: np.ndarray, told: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows by key: the smallest document that has the key, in this block or as told; and whether this block has that document."""
    first, least, _, number = smallest(keys, doc)
    here = np.ones(len(first), bool)
    if told is not None and len(first):
        mine = np.zeros(len(first), [("k1", np.int64), ("k2", np.int64)])
        mine["k1"], mine["k2"] = keys[0][first], keys[1][first]
        theirs = np.zeros(len(told["k1"]), mine.dtype)
        theirs["k1"], theirs["k2"] = told["k1"], told["k2"]
        at = np.searchsorted(mine, theirs)  # `smallest` gives keys in order
        least[at], here[at] = told["least"], False
    return least[number], here[number]


def _candidates(block: Block, told: dict) -> None:
    """Leaves the cells whose first digit several documents have."""
    block.select(np.isin(block.digit, told["digits"]["k"]) if told["digits"] is not None else np.zeros(len(block.digit), bool))


def _first_cells(block: Block, told: dict) -> None:
    """Leaves the candidates that no smaller document has."""
    _candidates(block, told)
    least, here = _least(block.contents(), block.doc(), told["cells"])
    block.select(here & (least == block.doc()))


def _digits(block: Block, told: dict) -> dict[str, np.ndarray]:
    first, _, several, _ = smallest((block.digit,), block.doc())
    return {"k": block.digit[first], "several": several}


def _cells(block: Block, told: dict) -> dict[str, np.ndarray]:
    _candidates(block, told)
    k1, k2 = block.contents()
    first, least, _, _ = smallest((k1, k2), block.doc())
    return {"k1": k1[first], "k2": k2[first], "doc": least}


def _stretches(block: Block, told: dict) -> dict[str, np.ndarray]:
    _first_cells(block, told)
    cell, k = block.stretches()
    digit = block.shared(cell, k)
    first, _, several, _ = smallest((digit,), block.doc()[cell])
    return {"k": digit[first], "several": several}


def _open_windows(block: Block, told: dict) -> tuple[np.ndarray, np.ndarray]:
    """cell and start of the windows that are still to be compared."""
    _first_cells(block, told)
    cell, k = block.stretches()
    keep = np.isin(block.shared(cell, k), told["stretches"]["k"]) if told["stretches"] is not None else np.zeros(len(cell), bool)
    return block.windows(cell[keep], k[keep])


def _windows(block: Block, told: dict) -> dict[str, np.ndarray]:
    cell, start = _open_windows(block, told)
    (k1, k2), doc = block.window_keys(start), block.doc()[cell]
    first, least, _, _ = smallest((k1, k2), doc)
    return {"k1": k1[first], "k2": k2[first], "doc": least}


def _spans(block: Block, told: dict) -> np.ndarray:
    """Whether each byte is removed."""
    edge = np.zeros(len(block.data) + 1, np.int32)
    _candidates(block, told)
    least, _ = _least(block.contents(), block.doc(), told["cells"])
    gone = least < block.doc()
    np.add.at(edge, block.lo[gone], 1)
    np.add.at(edge, block.hi[gone] + block.threshold, -1)
    cell, start = _open_windows(block, told)
    if len(start):
        least, _ = _least(block.window_keys(start), block.doc()[cell], told["windows"])
        gone = least < block.doc()[cell]
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + block.threshold, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, spans (removed stretches of bytes, start and stop, as long as can be), kept (the other bytes) of every row.

    threshold: bytes of a window, more than STARTS * RUNS. block: bytes of text that are handled at once.
    """
    if threshold <= STARTS * RUNS:
        raise ValueError(f"windows have more than {STARTS * RUNS} bytes")
    blocks, told = _blocks(docs, id_col, text_col, block), {}

    def passed(name: str, do: Callable, kinds: str, meet: Callable) -> None:
        told[name] = stored(meet(_each(_told(told, blocks), do, kinds, threshold)), name)

    passed("digits", _digits, "block long, k long, several boolean", _kept_in_several)
    passed("cells", _cells, "block long, k1 long, k2 long, doc long", _smaller_elsewhere)
    passed("stretches", _stretches, "block long, k long, several boolean", _kept_in_several)
    passed("windows", _windows, "block long, k1 long, k2 long, doc long", _smaller_elsewhere)

    names = list(told)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                block = Block(ids, batch.column("texts")[i].values, threshold)
                gone = _spans(block, _answers(batch, i, names))
                spans, kept = [], []
                for a, b in zip(block.begin.tolist(), block.end.tolist(), strict=True):
                    steps = np.flatnonzero(np.diff(gone[a:b].view(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    spans.append([{"start": s, "stop": t} for s, t in steps.tolist()])
                    kept.append(block.data[a:b][~gone[a:b]].tobytes() if len(steps) else block.data[a:b].tobytes())
                n = pa.array(block.end - block.begin)
                span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([ids, n, pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return _told(told, blocks).mapInArrow(tidied(cut), "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
