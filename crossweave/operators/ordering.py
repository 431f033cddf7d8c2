"""A place for every row in an order of the whole set, without a task that sees the whole set; and what follows from places: shuffles, batches, steps, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.batching import turns_at

#: Hexadecimal digits of a key that deal rows to ranges, and those that deal ranges to groups.
RANGE, GROUP = 4, 2
_BEFORE = (Window.unboundedPreceding, -1)


def positions(df: DataFrame, key: Column, ties: list[str], out: str = "position", within: list[str] | None = None) -> DataFrame:
    """df with each row's place, from 0, by key and then ties. key: hexadecimal digits, as md5 gives them, that tell nearly all rows apart.

    The first digits of a key give its range; ranges are counted, and the counts before each one added up: in its group of ranges by a window, over all groups by an
    array of at most 256 numbers, so that no window has one partition. A row's place is that in its range, after the rows of all ranges before. There are 65,536 ranges at most, which
    bounds what is broadcast. within: columns in whose groups the places begin anew; then ranges are those of a group, and are joined with a shuffle.
    """
    within = within or []
    rows = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, RANGE))
    ranges = rows.groupBy(*within, "_range").agg(F.count("*").alias("_n")).withColumn("_group", F.substring("_range", 1, GROUP))
    groups = ranges.groupBy(*within, "_group").agg(F.sum("_n").alias("_m"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy(*within, "_group").orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0))
    ranges = ranges.withColumn("_inner", inner)
    if within:
        outer = F.coalesce(F.sum("_m").over(Window.partitionBy(*within).orderBy("_group").rowsBetween(*_BEFORE)), F.lit(0))
        groups = groups.withColumn("_outer", outer).drop("_m")
        ranges = ranges.join(groups, [*within, "_group"]).select(*within, "_range", (F.col("_inner") + F.col("_outer")).alias("_offset"))
    else:
        counts = groups.agg(F.collect_list(F.struct("_group", "_m"))).scalar()
        outer = F.aggregate(F.filter("_counts", lambda g: g["_group"] < F.col("_group")), F.lit(0).cast("long"), lambda n, g: n + g["_m"])
        ranges = F.broadcast(ranges.withColumn("_counts", counts).select("_range", (F.col("_inner") + outer).alias("_offset")))
    at = F.row_number().over(Window.partitionBy(*within, "_range").orderBy("_key", *ties)) - 1
    return rows.join(ranges, [*within, "_range"]).withColumn(out, (at + F.col("_offset")).cast("long")).drop("_key", "_range", "_offset")


def key_of(seed: Column | str, *columns: str) -> Column:
    """A key that looks random, the same on every run and retry."""
    seed = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.md5(F.concat_ws("-", seed, *[F.col(c).cast("string") for c in columns]))


def shuffled(df: DataFrame, seed: str, columns: list[str], ties: list[str], out: str = "position") -> DataFrame:
    """df in an order of the whole set that looks random, as places. columns: what tells rows apart."""
    return positions(df, key_of(seed, *columns), ties, out)


def steps(batches: DataFrame, seed: int, keys: list[str], per_step: int, most: int | None = None, epoch: str = "epoch") -> DataFrame:
    """Batches with their step in their epoch, those after `most` steps left out. An epoch has an order of its own: its seed is `seed` and its number.

    batches: a row for each, with `epoch` and keys that tell an epoch's batches apart.
    """
    placed = positions(batches, key_of(F.lit(seed) + F.col(epoch), *keys), keys, "_at", within=[epoch])
    out = placed.withColumn("step", F.floor(F.col("_at") / per_step).cast("int")).drop("_at")
    return out if most is None else out.filter(F.col("step") < most)


def curriculum(df: DataFrame, epochs: int, keys: list[str], most_turns: int, schedule: str, seed: int, per_step: int, most_steps: int | None = None, item: str = "pid", order: str = "ord") -> DataFrame:
    """Targets of each epoch: dealt anew to batches of as many as the epoch has turns, the batches in an order of the epoch's own, cut after so many steps.

    Adds epoch, batch_id, pos and step.
    """
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    w = Window.partitionBy("epoch", *keys).orderBy(key_of(F.lit(seed) + F.col("epoch"), *keys, item), order)
    turns, at = turns_at(F.col("epoch"), most_turns, schedule), F.row_number().over(w) - 1
    rows = rows.withColumns({"batch_id": F.floor(at / turns).cast("int"), "pos": (at % turns).cast("int")})
    batches = rows.select("epoch", *keys, "batch_id").distinct()
    return rows.join(steps(batches, seed, [*keys, "batch_id"], per_step, most_steps), ["epoch", *keys, "batch_id"])
