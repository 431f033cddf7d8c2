"""Batches of targets: first of repeats, fixed slices, random and confidence-aware dealing, budgets, the number of targets by epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.profiles import confidence, shuffle_key


def dedupe_first(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def fixed(df: DataFrame, keys: list[str], n: int, order: list) -> DataFrame:
    """batch_id and pos: slices of n in the given order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_at", at).withColumns({"batch_id": F.floor(F.col("_at") / n).cast("int"), "pos": (F.col("_at") % n).cast("int")}).drop("_at")


def random_turns(df: DataFrame, keys: list[str], n: int, seed: str, item: str | list[str] = "pid", order: str = "ord") -> DataFrame:
    """item: what tells the rows of a key apart."""
    return fixed(df, keys, n, [shuffle_key(seed, *keys, *([item] if isinstance(item, str) else item)), F.col(order)])


def snake(df: DataFrame, keys: list[str], n: int, pred: str = "pred", order: str = "ord") -> DataFrame:
    """batch_id and pos: items by falling confidence are dealt forth and back over the batches, then high and low alternate in each batch.

    One window by key gives the place; all else is arithmetic on it.
    """
    w = Window.partitionBy(*keys)
    out = df.withColumns({"_i": F.row_number().over(w.orderBy(F.desc(confidence(pred)), F.col(order))) - 1, "_n": F.count("*").over(w)})
    out = out.withColumn("_b", F.ceil(F.col("_n") / n))
    out = out.withColumns({"_cycle": F.floor(F.col("_i") / F.col("_b")), "_at": F.col("_i") % F.col("_b")})
    out = out.withColumn("batch_id", F.when(F.col("_cycle") % 2 == 0, F.col("_at")).otherwise(F.col("_b") - 1 - F.col("_at")).cast("int"))
    # a batch gets one item a cycle; the last cycle may not reach it
    last, full = F.floor((F.col("_n") - 1) / F.col("_b")), F.col("_n") - F.floor((F.col("_n") - 1) / F.col("_b")) * F.col("_b")
    reached = F.when(last % 2 == 0, F.col("batch_id") < full).otherwise(F.col("_b") - 1 - F.col("batch_id") < full)
    m = last + F.when(reached, 1).otherwise(0)
    r = F.col("_cycle")
    return out.withColumn("pos", F.when(r < F.ceil(m / 2), 2 * r).otherwise(2 * (m - 1 - r) + 1).cast("int")).drop("_i", "_n", "_b", "_cycle", "_at")


def build_turns(df: DataFrame, keys: list[str], n: int, strategy: str, seed: str, scored: bool, item: str | list[str] = "pid") -> DataFrame:
    """strategy: random, or confidence, which needs scores."""
    if strategy not in ("random", "confidence"):
        raise ValueError(f"unknown strategy {strategy}")
    return snake(df, keys, n) if strategy == "confidence" and scored else random_turns(df, keys, n, seed, item)


def within_budget(df: DataFrame, keys: list[str], length: str, budget: Column, order: list, parts: int | None = None) -> DataFrame:
    """Items while what stands before them is below the budget; the one that crosses it stays. order: columns; lengths are not negative.

    A key may hold most rows, so each part of its rows, of as many parts as a shuffle has partitions, is cut at the budget first. That loses nothing: what stands before a row that is cut there fills the
    budget by itself, and stays.
    """
    parts = parts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum(length).over(w), F.lit(0))).filter(F.col("before") < budget)

    some = cut(df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts))), *keys, "_part").drop("_part")
    return cut(some, *keys)


def turns_at(epoch: Column, most: int, schedule: str) -> Column:
    """Targets in a batch at an epoch: exponential (1, 4, 16, ...) or linear (1, 2, 3, ...)."""
    grown = {"exponential": F.pow(F.lit(4.0), epoch), "linear": epoch + 1}[schedule]
    return F.least(grown, F.lit(most)).cast("int")


def pad(df: DataFrame, batch: list[str], ids: str, fill: int) -> DataFrame:
    """ids padded to the longest of their batch, with a mask and a label list that is null at the padding."""
    most = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    out = df.withColumn("_more", most - F.size(ids))
    more = lambda x: F.array_repeat(x, F.col("_more"))
    return out.withColumns({"input_ids": F.concat(ids, more(F.lit(fill))), "attention_mask": F.concat(F.transform(ids, lambda _: F.lit(1)), more(F.lit(0))), "labels": F.concat(ids, more(F.lit(None).cast("int")))}).drop("_more")
