"""Resumable scoring: a table of finished requests, what is still to do, and a stream that works off new requests once each.

Progress is kept by parts: a request's id says which part it is of, and a part's requests and replies each have a folder of their own. Working off a part reads its
own requests and replies, and adds the new replies once, so that what is read in a run grows with the requests, not with the requests times the parts. The number of parts
is in the folder's name, so that a later run deals its requests in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from crossweave import schema
from crossweave.sources.storage import delete, names_in, table_path


def completed(spark: SparkSession, path: str, columns: str = schema.REPLIES) -> DataFrame:
    """Finished replies below path; none where there is no such folder."""
    kind = StructType.fromDDL(columns)
    try:
        return spark.read.schema(columns).parquet(path).select(*kind.names)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)


def pending(requests: DataFrame, done: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests without a finished reply."""
    return requests.join(done.select(key), key, "left_anti")


def part_of(parts: int, key: str = "request_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def parts_of(spark: SparkSession, path: str) -> int | None:
    """How many parts the progress below path has; None where there is none."""
    found = [int(n.partition("=")[2]) for n in names_in(spark, path) if n.startswith("of=")]
    return max(found, default=None)


def _dealt(rows: DataFrame, parts: int, path: str) -> None:
    """Writes rows in a folder for each part. A part is worked off alone, and may be large where the parts were made for fewer requests, so its rows are in as many files as there are
    cores: one task writes each, and another reads it to score it."""
    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    of_part = F.pmod(F.xxhash64("request_id", F.lit("file")), F.lit(cores)).cast("int")
    dealt = rows.withColumn("part", part_of(parts)).repartitionById(parts * cores, F.col("part") * cores + of_part)
    dealt.write.mode("append").partitionBy("part").parquet(path)


def save(replies: DataFrame, path: str, parts: int) -> None:
    """Adds replies, as of a run elsewhere, to the progress below path."""
    if (parts_of(replies.sparkSession, path) or parts) != parts:
        raise ValueError(f"{path} has another number of parts")
    _dealt(replies, parts, f"{path}/of={parts}")


def run_pending(requests: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], every: int = 100_000) -> DataFrame:
    """Scores what is to do, in parts of about `every` requests that are each saved when done, and returns all replies. Run again after a failure, it goes on where it was.

    requests are read twice, for their number and to deal them to parts; once where the progress has its parts already.
    """
    spark, todo = requests.sparkSession, table_path(requests.sparkSession, "requests")
    parts = parts_of(spark, path) or max(1, -(-requests.count() // every))
    try:
        _dealt(requests, parts, todo)
        for k in sorted(int(n.partition("=")[2]) for n in names_in(spark, todo) if n.startswith("part=")):
            at = f"{path}/of={parts}/part={k}"
            mine = pending(spark.read.schema(requests.schema).parquet(f"{todo}/part={k}"), completed(spark, at))
            if not names_in(spark, at) or not mine.isEmpty():
                score(mine).write.mode("append").parquet(at)
    finally:
        delete(spark, todo)
    return completed(spark, path)


def stream_pending(spark: SparkSession, source: str, columns: str, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]) -> None:
    """Works off all request files that have come since the last run, then ends. A batch that ran before is not scored again."""

    def each(batch: DataFrame, number: int) -> None:
        score(pending(batch, completed(spark, path))).write.mode("append").parquet(path)

    stream = spark.readStream.schema(columns).parquet(source).writeStream.trigger(availableNow=True)
    stream.option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()
