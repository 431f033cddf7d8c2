"""Sinks: JSON or Parquet dumps, versions that are never overwritten, a metrics log."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave import schema
from crossweave.sources.storage import delete, names_in

_COLUMNS = [c.split()[0] for c in schema.REFINED.split(", ")]


def dump(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def dump_scores(refined: DataFrame, path: str) -> None:
    """The flat table of refined scores, its columns in order."""
    dump(refined.select(*_COLUMNS), path)


def save_name(path: str) -> str:
    """What outputs made from a file are named by: its name up to the first dot."""
    return path.rstrip("/").rpartition("/")[2].partition(".")[0]


def save_names(path: Column) -> Column:
    """`save_name` of a column of paths."""
    return F.substring_index(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), ".", 1)


def snapshot(done: DataFrame, path: str) -> int:
    """Writes finished rows below path, in a folder named by their number, and returns it."""
    kept = done.persist(StorageLevel.DISK_ONLY)
    try:
        n = kept.count()
        kept.write.mode("overwrite").parquet(f"{path}/completed={n}")
    finally:
        kept.unpersist()
    return n


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders version=N below path."""
    return sorted(int(n.partition("=")[2]) for n in names_in(spark, path) if n.startswith("version="))


def dump_version(df: DataFrame, path: str) -> int:
    """Writes df below path as the next version, and returns its number."""
    n = max(versions(df.sparkSession, path), default=-1) + 1
    df.write.mode("errorifexists").parquet(f"{path}/version={n}")
    return n


def dump_buffers(df: DataFrame, path: str, prefix: str) -> None:
    """What an evaluation has seen, as it is, below path: the last of those with the same prefix stays. Other prefixes are not touched."""
    dump(df, f"{path}/prefix={prefix}")


def log_metrics(metrics: DataFrame, path: str, prefix: str) -> None:
    """Appends the row, unless it is of the evaluations during training."""
    if prefix != "eval":
        metrics.withColumn("prefix", F.lit(prefix)).write.mode("append").json(path)


remove = delete
