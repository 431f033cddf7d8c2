"""The entries of large JSON values: a file that is one map or one array, read by as many tasks as it has splits.

Spark's text reader takes a comma or a closing bracket as the end of a line, and so splits such a file anywhere, on any storage. Whether a comma is one between entries depends on all
that stands before it, but on two facts only: whether it is inside a string, and how deep. A first pass over each split finds whether its number of quotes is odd,
and by how much the depth changes and how many commas stand at which depth, for a split that begins inside a string and for one that does not. Running sums of these
over the splits of a file (a row for each, some 128 MB) say how each split begins, and how many entries stand before it. The second pass cuts the splits at the
commas of depth one. An entry that goes over the end of a split comes in pieces, which its place in the file brings together.

Both passes are one Spark job, so that they see the same splits; if they don't, rows raise. The entries are kept as Parquet in the shared folder, so that what is made of them
doesn't scan the JSON again. An entry has to fit a task. No escape ends with a comma or a bracket, so that none goes over a split. Files whose entries hold lists or objects are
best read up to brackets, which makes fewer and longer lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.sources.storage import saved

_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = _STEP != 0
_MARK[b","[0]] = True
_QUOTE, _ESCAPE, _COMMA = b'"'[0], b"\\"[0], b","[0]
_SUMMARY = "file long, start long, odd int, delta array<long>, commas array<array<struct<depth:long,n:long>>>"
_BEFORE = (Window.unboundedPreceding, -1)


def _splits(spark: SparkSession, path: str, end: str) -> DataFrame:
    """value, and which file and split it is of."""
    return spark.read.option("lineSep", end).text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Parts of a batch that are of one split."""
    file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
    at = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), len(file)]
    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def _bytes(values: pa.Array, end: str) -> tuple[bytes, np.ndarray]:
    """The values with what ended each behind it."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), end)
    data = whole[0].as_buffer().to_pybytes() + end.encode()
    return data, np.frombuffer(data, np.uint8)


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, whether each is outside of strings if the first byte is, and whether the number of quotes is odd."""
    quotes = np.flatnonzero(data == _QUOTE)
    after = quotes[(quotes > 0) & (data[quotes - 1] == _ESCAPE)]  # behind a backslash: escaped if it is the last of an odd number of them
    run, open_ = np.ones(len(after), np.int64), np.arange(len(after))
    while len(open_):
        open_ = open_[(after[open_] - run[open_] > 0) & (data[after[open_] - run[open_] - 1] == _ESCAPE)]
        run[open_] += 1
    quotes = np.setdiff1d(quotes, after[run % 2 == 1], assume_unique=True)
    at = np.flatnonzero(_MARK[data])
    return at, np.searchsorted(quotes, at) % 2 == 0, len(quotes) % 2


def summary(batches: Iterator[pa.RecordBatch], end: str) -> Iterator[pa.RecordBatch]:
    """What a split changes: a row for each."""
    now, odd, delta, commas = None, 0, [0, 0], ({}, {})

    def row() -> pa.RecordBatch:
        counts = [[{"depth": d, "n": n} for d, n in sorted(c.items())] for c in commas]
        kind = pa.list_(pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([odd], pa.int32()), pa.array([delta], pa.list_(pa.int64())), pa.array([counts], kind)], ["file", "start", "odd", "delta", "commas"])

    for batch in batches:
        for of, some in _runs(batch):
            if of != now:
                if now:
                    yield row()
                now, odd, delta, commas = of, 0, [0, 0], ({}, {})
            _, data = _bytes(some.column("value"), end)
            at, outside, odd_here = _marks(data)
            if odd:
                outside = ~outside
            step, comma = _STEP[data[at]], data[at] == _COMMA
            for inside, free in enumerate((outside, ~outside)):
                depth = np.cumsum(step * free) + delta[inside]
                for d, n in zip(*np.unique(depth[comma & free], return_counts=True), strict=True):
                    commas[inside][int(d)] = commas[inside].get(int(d), 0) + int(n)
                delta[inside] = int(depth[-1])
            odd ^= odd_here
    if now:
        yield row()


def _begins(splits: DataFrame, end: str) -> DataFrame:
    """file, start, inside, depth, place: how each split begins."""
    w = Window.partitionBy("file").orderBy("start").rowsBetween(*_BEFORE)
    run = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    rows = splits.mapInArrow(partial(summary, end=end), _SUMMARY).withColumn("inside", (run("odd") % 2).cast("int"))
    rows = rows.withColumn("depth", run(F.get("delta", F.col("inside"))))
    top = F.filter(F.get("commas", F.col("inside")), lambda x: x["depth"] + F.col("depth") == 1)
    rows = rows.withColumn("place", run(F.aggregate(top, F.lit(0).cast("long"), lambda n, x: n + x["n"])))
    return rows.select("file", "start", F.col("inside").alias("_inside"), F.col("depth").alias("_depth"), F.col("place").alias("_place"))


def cut(batches: Iterator[pa.RecordBatch], end: str) -> Iterator[pa.RecordBatch]:
    """file, place, start, piece: the entries of each split; start is null for those that are whole."""
    now, inside, depth, place, began, held = None, 0, 0, 0, False, []
    out: list[tuple[int, int, int | None, bytes]] = []

    def rows() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["file", "place", "start", "piece"])

    def end_piece(more: bytes, ended: bool) -> None:
        nonlocal began, held
        out.append((now[0], place, None if began and ended else now[1], b"".join([*held, more])))
        began, held = True, []

    for batch in batches:
        for of, some in _runs(batch):
            if of != now:
                if now and depth > 0:
                    end_piece(b"", False)
                now, began, held = of, False, []
                inside, depth, place = (some.column(c)[0].as_py() for c in ("_inside", "_depth", "_place"))
            text, data = _bytes(some.column("value"), end)
            at, outside, odd_here = _marks(data)
            outside ^= bool(inside)
            step = _STEP[data[at]] * outside
            depths, was = depth + np.cumsum(step), depth
            edge = ((data[at] == _COMMA) & outside & (depths == 1)) | ((step > 0) & (depths == 1)) | ((step < 0) & (depths == 0))
            begin = 0 if was > 0 else None
            for p, s in zip(at[edge].tolist(), step[edge].tolist(), strict=True):
                if s > 0:
                    begin, began, held = p + 1, True, []
                else:
                    end_piece(text[begin:p], True)
                    begin = p + 1 if s == 0 else None
                    place += s == 0
            depth, inside = int(depths[-1]), inside ^ odd_here
            if begin is not None and depth > 0:
                held.append(text[begin:])
        if out:
            yield rows()
    if now and depth > 0:
        end_piece(b"", False)
    if out:
        yield rows()


def entries(spark: SparkSession, path: str, end: str = ",") -> DataFrame:
    """file, place, entry: the text of each entry of the map or array in a file, or in each file of a folder, and its place there, from 0. end: a comma, or a closing bracket that each entry is likely to have."""
    splits = _splits(spark, path, end)
    changed = F.raise_error(F.lit("the splits of the file have changed, read it again"))
    begins = _begins(splits, end)
    known = splits.join(F.broadcast(begins), ["file", "start"], "left").withColumn("_inside", F.coalesce("_inside", changed.cast("int")))
    pieces = saved(known.mapInArrow(partial(cut, end=end), "file long, place long, start long, piece binary"), "entries")
    parts = pieces.filter("start is not null").groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    joined = parts.select("file", "place", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"])).alias("piece"))
    every = pieces.filter("start is null").select("file", "place", "piece").union(joined)
    return every.select("file", "place", F.decode("piece", "UTF-8").alias("entry")).filter(F.trim("entry", F.lit(" \t\r\n")) != "")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, n = None, 0
    for batch in batches:
        for of, some in _runs(batch):
            if of != now:
                now, n = of, some.column("_place")[0].as_py()
            yield pa.RecordBatch.from_arrays([some.column("file"), pa.array(np.arange(n, n + some.num_rows)), some.column("value")], ["file", "place", "entry"])
            n += some.num_rows


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place, entry: the lines of a file, or of each file of a folder, that are not empty, and their places there."""
    splits = _splits(spark, path, "\n").filter(F.trim("value", F.lit(" \t\r")) != "")
    w = Window.partitionBy("file").orderBy("start").rowsBetween(*_BEFORE)
    begins = splits.groupBy("file", "start").agg(F.count("*").alias("n")).select("file", "start", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")).alias("_place"))
    return splits.join(F.broadcast(begins), ["file", "start"], "left").mapInArrow(_number, "file long, place long, entry string")
