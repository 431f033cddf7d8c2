"""Refinement of scores: batches of a pair, replies merged into old scores, statistics of the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_batches(df: DataFrame, order: str = "ord") -> DataFrame:
    """aid1, aid2, name of the first batch, batches (batch_idx, pids, preds) in order. df: a row for each scored batch."""
    got = df.groupBy("aid1", "aid2").agg(F.min_by("name", order).alias("name"), F.array_sort(F.collect_list(F.struct(order, "pids", "preds"))).alias("_b"))
    return got.select("aid1", "aid2", F.coalesce("name", F.lit("unknown")).alias("name"), F.transform("_b", lambda x, i: F.struct(i.alias("batch_idx"), x["pids"].alias("pids"), x["preds"].alias("preds"))).alias("batches"))


def flatten_batches(df: DataFrame, of_batch: dict[str, Column] | None = None) -> DataFrame:
    """A row for each paper of each batch: aid1, aid2, name, batch_idx, pos, pid, old_pred. of_batch: more columns, by name, each made once a batch of df's columns and batch_idx."""
    more = of_batch or {}
    batches = df.withColumn("b", F.explode("batches")).select("*", "b.batch_idx").select("aid1", "aid2", "name", "batch_idx", "b", *[c.alias(n) for n, c in more.items()])
    rows = batches.select("aid1", "aid2", "name", "batch_idx", *more, F.posexplode(F.arrays_zip("b.pids", "b.preds")).alias("pos", "x"))
    return rows.select("aid1", "aid2", "name", "batch_idx", "pos", F.col("x.pids").alias("pid"), F.col("x.preds").alias("old_pred"), *more)


def merged(scores: Column, pos: Column, old: Column) -> Column:
    """The reply's score at a place; the old one where it has none that is a number. scores: map of strings, the last of equal keys counts."""
    at = F.filter(F.map_entries(scores), lambda e: e["key"] == pos.cast("string"))
    return F.coalesce(F.try_element_at(F.transform(at, lambda e: e["value"].try_cast("double")), F.lit(-1)), old)


def change_stats(df: DataFrame) -> DataFrame:
    by = F.abs(F.col("new_pred") - F.col("old_pred"))
    return df.agg(F.avg(by).alias("mean_change"), F.max(by).alias("max_change"), F.count("*").alias("n_papers"))
