"""Executed compaction: rows written as files by key, then the small files of each section joined into larger ones by first fit, in the same folder.

Groups of files are packed by a Fenwick tree over the room that is left in them. Room matters only as far as files fit, so it is compressed to a rank among the sizes; the tree is
indexed by falling rank, and a node keeps the groups of its ranks in a heap by number, which tidies up lazily: a group that has moved on is dropped when it comes up. The
smallest number among the ranks from a file's own up is that of the earliest group with room, in logarithmic time.

1. Rows are counted by section, then by file. The number of files doesn't depend on the number of rows, but on the shares that the caller's keys make.
2. Each file's rows go to one task, are sorted there (which can spill) and written as one file: `repartitionById` deals by the file's number.
3. The files are read back: which file has which key is told by its rows. Each section is packed, in a task of its own; it gets a row for each of its files.
4. Sources of groups of several are read with their places, go to one task for each group, and are added to the folder in order by one job: until it commits, the folder
   holds what it held, and only then the sources are deleted. The other files are not touched.
5. Results are read off the final files, each as a stream through one task.

The driver gets paths and numbers of files, and the number of rows. Rows without an id hash as 0 and are empty in a digest; rows without a day are a day of their own. Rows that are equal in
all sort columns have no order among them, but a written file's order is kept. Columns of any names are kept. An empty table gives no file and no rows. Every call writes a new folder and leaves it there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.llm.common import SMALL_TABLE, bounded, delete, stored, table_path

#: Divisors of the rows of a table: rows of a lot, of the least file that is left alone, and of the largest group.
LOT, SMALL, LARGE = 200, 750, 300
FILE = ("day", "lot", "piece")


class Groups:
    """Open groups by the room left in them: the earliest with enough room, and changes of room, in logarithmic time."""

    def __init__(self, sizes: list[int]):
        self.sizes = sorted(set(sizes))
        self.nodes: list[list[int]] = [[] for _ in range(len(self.sizes) + 1)]
        self.place: list[int] = []  # of each group, counted from the largest room

    def _place(self, room: int) -> int:
        """The more sizes fit, the smaller; one beyond the last where none does."""
        return len(self.sizes) - bisect_right(self.sizes, room) + 1

    def put(self, group: int, room: int) -> None:
        """Opens a group, the next in number, or changes its room."""
        at = self._place(room)
        if group == len(self.place):
            self.place.append(at)
        self.place[group] = at
        while at < len(self.nodes):
            heappush(self.nodes[at], group)
            at += at & -at

    def first(self, size: int) -> int | None:
        """The earliest group with room for one of the sizes."""
        at, best = self._place(size), None
        while at:
            node, low = self.nodes[at], at - (at & -at)
            while node and not low < self.place[node[0]] <= at:
                heappop(node)
            if node and (best is None or node[0] < best):
                best = node[0]
            at = low
        return best


def first_fit(sizes: list[int], most: int) -> list[int]:
    """Of items in the order in which they are taken, each one's group: the earliest that then holds `most` at most, else a new one."""
    groups, room, out = Groups(sizes), [], []
    for size in sizes:
        g = groups.first(size)
        if g is None:
            g = len(room)
            room.append(most)
        room[g] -= size
        groups.put(g, room[g])
        out.append(g)
    return out


def part(rows: int, x: int) -> int:
    return 1 + rows // x


def whole_rows(df: DataFrame) -> DataFrame:
    """A table's rows as one column, so that no name of theirs meets one of ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def by_day(clicks: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What adds _file (day, lot, piece) to rows (_row) of a table with click_id and arrived_at, and the table's number of rows. clicks: by `whole_rows`."""
    day = F.datediff(F.to_date("_row.arrived_at"), F.lit("1970-01-01").cast("date")).cast("long")
    days = stored(clicks.groupBy(day.alias("_day")).agg(F.count("*").alias("_rows")), "days")
    total = days.agg(F.sum("_rows")).first()[0] or 0
    h = F.coalesce(F.crc32(F.col("_row.click_id").cast("string").cast("binary")), F.lit(0).cast("long"))
    lots = 1 + F.floor(F.col("_rows") / part(total, LOT))
    keys = F.struct(F.col("_day").alias("day"), (F.floor(h / 16) % lots).alias("lot"), F.least(h % 4, F.floor(h / 4) % 4).alias("piece"))

    def filed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_on", day).join(bounded(days), F.col("_on").eqNullSafe(F.col("_day"))).withColumn("_file", keys).drop("_on", "_day", "_rows")

    return filed, total


def write_files(rows: DataFrame, folder: str, order: list[str]) -> int:
    """Writes a file for each value of the column _file, with the fields of _row, sorted by some of them; returns how many."""
    files = stored(rows.groupBy("_file").count(), "files")
    n = files.counted["rows"]
    if n:
        numbers = files.select(F.col("_file").alias("_of"), (F.row_number().over(Window.orderBy("_file")) - 1).alias("_number"))
        dealt = rows.join(F.broadcast(numbers) if n <= SMALL_TABLE else numbers, F.col("_file").eqNullSafe(F.col("_of")))
        _written(dealt, n, [f"_row.{c}" for c in order], folder)
    return n


def _written(rows: DataFrame, n: int, order: list[str], folder: str) -> None:
    """Adds n files to a folder, one for each _number, sorted."""
    rows.repartitionById(n, F.col("_number").cast("int")).sortWithinPartitions(*order).select("_row.*").write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)


def _placed(spark: SparkSession, columns: list[str], schema, paths: list[str]) -> DataFrame:
    """Rows of files with their file and their place in it."""
    df = spark.read.schema(schema).parquet(*paths)
    at = df.metadataColumn("_metadata")
    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), at["file_path"].alias("_path"), at["row_index"].alias("_place"))


def packed(files: DataFrame, section: str, small: int, most: int) -> DataFrame:
    """path, grp, nth of the files of fewer than `small` rows: the group that each joins in its section, and when. files: path, n_rows, section, and other
    columns, by which files of as many rows are taken."""
    ties = [c for c in files.columns if c not in ("path", "n_rows", section)]

    def run(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["n_rows", *ties], ascending=[False, *[True] * len(ties)], kind="stable")
        grp = first_fit(some["n_rows"].tolist(), most)
        return pd.DataFrame({"path": some["path"], "grp": grp, "nth": range(len(grp))})

    return files.filter(F.col("n_rows") < small).groupBy(section).applyInPandas(run, "path string, grp int, nth int")


def compact(spark: SparkSession, folder: str, schema, files: DataFrame, section: str, small: int, most: int) -> DataFrame:
    """Joins the small files of a folder; returns path, first and nth of those that were joined: their group, by its first file, and their place in it."""
    plan = packed(files, section, small, most).join(files.select("path", section), "path")
    mine = Window.partitionBy(section, "grp")  # at most the files of a section
    plan = plan.select("path", "nth", F.count("*").over(mine).alias("n"), F.first("path").over(mine.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    plan = stored(plan.filter("n > 1").select("path", "first", "nth"), "plan")
    firsts = [r.first for r in plan.select("first").distinct().orderBy("first").collect()]
    if firsts:
        sources = [r.path for r in plan.select("path").collect()]
        numbers = spark.createDataFrame(list(enumerate(firsts)), "_number int, first string")
        of = plan.join(F.broadcast(numbers), "first").select(F.col("path").alias("_path"), "nth", "_number")  # a row for each file
        rows = _placed(spark, schema.names, schema, [unquote(p) for p in sources]).join(F.broadcast(of), "_path")
        _written(rows, len(firsts), ["nth", "_place"], folder)
        for p in sources:
            delete(spark, unquote(p))
    return plan


def file_digests(spark: SparkSession, paths: list[str], schema, key: str, amount: str) -> DataFrame:
    """path, n_rows, least and most of the key, amounts in hundredths, SHA-256 of the keys in order, of each file: each is a stream through one task. paths: as `files_of` gives them."""
    numbers = spark.createDataFrame(list(enumerate(paths)), "_number int, _path string")
    hundredths = F.coalesce(F.floor(F.col(f"_row.{amount}") * 100 + 0.5), F.lit(0).cast("long"))
    rows = _placed(spark, [key, amount], schema, [unquote(p) for p in paths]).join(F.broadcast(numbers), "_path").select("_number", "_path", "_place", F.col(f"_row.{key}").cast("long").alias("id"), hundredths.alias("amount"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, low, high, amount, digest = None, 0, None, None, 0, hashlib.sha256()
        for batch in batches:
            if not batch.num_rows:
                continue
            path, ids = batch.column("_path")[0], batch.column("id")
            text = ",".join(["" if i is None else str(i) for i in ids.to_pylist()])
            digest.update(f"{',' if n else ''}{text}".encode())
            n += len(ids)
            amount += int(batch.column("amount").to_numpy().sum(dtype=np.int64))
            x = pc.min_max(ids).as_py()
            low, high = (min((v for v in (low, x["min"]) if v is not None), default=None), max((v for v in (high, x["max"]) if v is not None), default=None))
        if n:
            yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "n_rows": n, "least": low, "most": high, "amount": amount, "digest": digest.hexdigest()}], kind)

    kind = pa.schema([("path", pa.string()), ("n_rows", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("amount", pa.int64()), ("digest", pa.string())])
    ordered = rows.repartitionById(max(1, len(paths)), F.col("_number")).sortWithinPartitions("_place")
    return ordered.mapInArrow(run, "path string, n_rows long, least long, most long, amount long, digest string")


def files_of(spark: SparkSession, folder: str, schema, filed: Callable[[DataFrame], DataFrame], needs: list[str]) -> DataFrame:
    """path, n_rows, day, lot, piece of each file of a folder, as its first row tells."""
    found = filed(_placed(spark, needs, schema, [folder])).groupBy("_path").agg(F.count("*").alias("n_rows"), F.min_by("_file", "_place").alias("f"))
    return found.select(F.col("_path").alias("path"), "n_rows", "f.*")


OUT = (
    "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"
)


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    folder, needs = table_path(spark, "clicks"), ["click_id", "arrived_at"]
    filed, total = by_day(whole_rows(clicks))
    if not write_files(filed(whole_rows(clicks)), folder, ["arrived_at", "click_id"]):
        return spark.createDataFrame([], OUT)
    files = stored(files_of(spark, folder, clicks.schema, filed, needs), "starts")
    plan = compact(spark, folder, clicks.schema, files, "day", part(total, SMALL), part(total, LARGE))
    one = F.struct("nth", F.concat_ws("-", "lot", "piece").alias("s"))
    sources = plan.join(files, "path").groupBy("first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), ",").alias("sources"))
    # the first row of a file belongs to its first source
    sources = sources.join(files.withColumnRenamed("path", "first"), "first").select(F.struct(*FILE).alias("key"), "sources")
    now = stored(files_of(spark, folder, clicks.schema, filed, needs), "files").select("path", *FILE, F.struct(*FILE).alias("own"))
    paths = sorted(r.path for r in now.select("path").collect())
    found = file_digests(spark, paths, clicks.schema, "click_id", "value").join(now, "path").join(sources, F.col("own").eqNullSafe(F.col("key")), "left")
    return found.select(
        *FILE, "n_rows", F.col("least").alias("min_click_id"), F.col("most").alias("max_click_id"), F.col("amount").alias("cents"),
        F.coalesce("sources", F.concat_ws("-", "lot", "piece")).alias("sources"), F.col("digest").alias("ids_sha256"),
        F.lit(",".join(spark.read.parquet(folder).columns)).alias("columns"), "path", F.col("sources").isNotNull().alias("rewritten"),
    )


QUERIES = {"op13_compaction": op13_compaction}
ORACLE_SQL: dict[str, str] = {}
