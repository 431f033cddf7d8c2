"""What the operators of this folder share: shared storage, salted group look-ups, connected components, words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crossweave.sources.storage import delete, shared_dir, table_path  # noqa: F401

#: Parts, at least, into which the rows of one key are dealt before they meet.
SALTS = 32
#: Rows of a few numbers, at most, that are broadcast.
SMALL_TABLE = 250_000
#: Bytes of text that a Python worker handles at once.
PORTION = 4 << 20
#: Bytes of an Arrow batch, where the session has Spark's own default.
BATCH, _UNSET = "8388608b", ("67108864", "67108864b")

#: Byte table: A-Z to a-z; the ASCII bytes that are no letter or digit to a space; the rest stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


#: Paths that `stored` has written, for each open `scratch`.
_scopes: list[list[str]] = []


def stored(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """df written to the shared folder as Parquet and read again: its lineage ends there, so that the loss of an executor costs no earlier work.

    The data frame has `stored_at`, the path, and `counted`: how many rows there are, and for how many each condition of `counts` holds, observed while they are written.
    """
    path = table_path(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]).write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at, out.counted = path, {k: int(v or 0) for k, v in seen.get.items()}
    return out


def _named(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, of which `discard` then deletes the table."""
    df.stored_at, df.counted = table.stored_at, table.counted
    return df


def discard(df: DataFrame) -> None:
    """Deletes the table of a data frame that `stored` returned; nothing that is still to be computed may need it."""
    delete(df.sparkSession, df.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what `stored` writes within, at the end: results that were written elsewhere by then don't need it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def salts(spark: SparkSession) -> int:
    """Parts for the rows of one key: as many as a shuffle has partitions, so that one key can use them all."""
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(key: Column, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def with_group(df: DataFrame, key: str, by: str, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """df and, on each row, aggregates of its group: {new column: (function, column)} with functions that combine (min, max, sum).

    Groups may hold most of the rows: rows are pre-aggregated by (key, part of `by`), and the result goes back to the rows by the same pair,
    so that no task gets more than a part of a group. key must not be null.
    """
    dealt = df.withColumn("_salt", salt(F.col(by), salts(df.sparkSession)))
    part = dealt.groupBy(key, "_salt").agg(*[getattr(F, f)(c).alias(n) for n, (f, c) in aggs.items()])
    full = part.groupBy(key).agg(*[getattr(F, f)(n).alias(n) for n, (f, _) in aggs.items()], F.collect_set("_salt").alias("_salts"))
    back = full.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return dealt.join(back, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for each id that is an end of a link, the smallest id reachable. edges: (a, b) of long.

    A round hooks every root to the smallest root that a link joins it to, follows these pointers to their ends, and carries the links over to the
    new roots. A root that takes in no other root has a smaller neighbour in the next round, so that the roots of a component halve in two
    rounds at most, whatever its shape; pointers are followed in steps that double. Links and labels never leave the executors.
    """
    links = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    if not links.counted["rows"]:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    names: DataFrame | None = None
    while True:
        hooks = _ends(stored(links.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "id"), "hooks"))
        # a root that no link joins to another any more stays as it is
        was, names = names, _named(hooks.withColumnRenamed("up", "root"), hooks)
        if was is not None:
            over = hooks.select(F.col("id").alias("root"), "up")
            names = stored(was.join(over, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "roots")
            discard(was)
        up = hooks.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        half = links.join(up, "a").select("ra", "b").distinct()
        after = half.join(up.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        after = stored(after, "links")
        discard(links)
        if was is not None:
            discard(hooks)
        links = after
        if not links.counted["rows"]:
            discard(links)
            return names


def _ends(hooks: DataFrame) -> DataFrame:
    """(id, up) with each pointer followed to its end; every id that is pointed at has a row."""
    while True:
        over = hooks.select(F.col("id").alias("up"), F.col("up").alias("over"))
        moved = F.col("was") != F.col("up")
        after = stored(hooks.join(over, "up").select("id", F.col("up").alias("was"), F.col("over").alias("up")), "hooks", moved=moved)
        discard(hooks)
        hooks = _named(after.select("id", "up"), after)
        if not after.counted["moved"]:
            return hooks


def whole_text(name: str = "text") -> Column:
    """A text, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def binary_text(name: str = "text") -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def bounds(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive slices of about `most` bytes of text each, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
        yield i, j - i
        i = j


def portioned(batches: Iterator[pa.RecordBatch], column: str = "body", most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `most` bytes of a column, so that what Python makes of a part stays small."""
    for batch in batches:
        for i, n in bounds(batch.column(column), most):
            yield batch.slice(i, n)


def whole_buckets(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rest: tuple[str, ...] = ()) -> Iterator[tuple]:
    """From rows in order of the first column: that column and the others as arrays, in portions that hold all rows of each of their keys; with
    `rest`, these columns of the portion as a table too."""
    held: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(parts).combine_chunks()
        arrays = [table.column(c).to_numpy() for c in columns]
        return (*arrays, table.select(list(rest))) if rest else tuple(arrays)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(columns[0]).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if held and (last or held[-1].column(columns[0])[-1].as_py() != key[0]):
            yield out([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield out([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield out(held)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session to BATCH bytes, unless it sets a bound itself: a task holds several of them outside the heap."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in _UNSET:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at its end gives what it no longer uses back to the system: Python workers outlive their tasks, and an executor has several."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return done


def bounded(table: DataFrame) -> DataFrame:
    """A table that `stored` returned, of a few numbers a row, to be broadcast only if its rows, which were counted, are SMALL_TABLE at most."""
    return F.broadcast(table) if table.counted["rows"] <= SMALL_TABLE else table


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what Python makes of a part stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
