"""Profiles: keys, fallbacks, filters, joins to papers, samples and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paper_id(pid: str = "pid") -> Column:
    """What stands before the first hyphen."""
    return F.split_part(F.col(pid), F.lit("-"), F.lit(1))


def pair_key(a: str = "aid1", b: str = "aid2") -> Column:
    return F.concat_ws("-", F.col(a), F.coalesce(F.col(b), F.lit("None")))


def similarity(a: str = "similarity", b: str = "author_sim", strict: bool = False) -> Column:
    """The first of two that is there; strict raises where none is."""
    both = F.coalesce(F.col(a), F.col(b))
    return F.coalesce(both, F.raise_error(F.lit("no similarity")).cast("double")) if strict else both


def confidence(pred: str = "pred") -> Column:
    return F.abs(F.coalesce(F.col(pred), F.lit(0.5)) - F.lit(0.5))


def shuffle_key(seed: str, *keys: str) -> Column:
    """A fixed order that looks random: the same on every run and retry."""
    return F.md5(F.concat_ws("-", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def flatten_names(df: DataFrame, order: str = "name_ord") -> DataFrame:
    """Assignments without names: of an aid under several names, the list of the name that comes last in the file stays."""
    last = df.groupBy(F.col("aid").alias("_aid")).agg(F.max(order).alias("_last"))
    return df.join(last, (F.col("aid") == F.col("_aid")) & (F.col(order) == F.col("_last")), "left_semi")


def last_aid(df: DataFrame, name: str = "name", aid: str = "aid", order: str = "ord") -> DataFrame:
    """name and the aid that comes last."""
    return df.groupBy(name).agg(F.max_by(aid, order).alias(aid))


def targets_of(aids: DataFrame, assignments: DataFrame) -> DataFrame:
    """The papers of the named profiles, by name and aid; a pair that has none raises when rows are read."""
    there = assignments.select("name", "aid").distinct().withColumn("_there", F.lit(True))
    checked = F.when(F.col("_there"), F.col("aid")).otherwise(F.raise_error(F.concat(F.lit("unknown profile "), F.col("aid"))).cast("string"))
    wanted = aids.select("name", "aid").distinct().join(there, ["name", "aid"], "left").select("name", checked.alias("aid"))
    return wanted.join(assignments, ["name", "aid"])


def with_fallback(clean: DataFrame, raw: DataFrame, level: str = "aid") -> DataFrame:
    """The clean lists, and the raw ones of what has no clean list. level: the key that decides, aid or name."""
    return clean.unionByName(raw.join(clean.select(level).distinct(), level, "left_anti").select(*clean.columns))


def min_profile(df: DataFrame, more_than: int = 5, aid: str = "aid") -> DataFrame:
    """Rows of profiles with more than so many papers."""
    large = df.groupBy(aid).agg(F.count("*").alias("_n")).filter(F.col("_n") > more_than)
    return df.join(large, aid, "left_semi")


def known(df: DataFrame, papers: DataFrame, pid: str = "pid") -> DataFrame:
    return df.join(papers.select(pid), pid, "left_semi")


def assert_known(df: DataFrame, papers: DataFrame, pid: str = "pid") -> DataFrame:
    """df; a pid without a paper raises when rows are read."""
    marks = papers.select(F.col(pid), F.lit(True).alias("_known")).distinct()
    checked = F.when(F.col("_known"), F.col(pid)).otherwise(F.raise_error(F.concat(F.lit("unknown paper "), F.col(pid))).cast("string"))
    return df.join(marks, pid, "left").withColumn(pid, checked).drop("_known")


def without_first_target(profile: DataFrame, first: DataFrame, aid: str = "aid", pid: str = "pid") -> DataFrame:
    """Profile rows except the first target of their aid. first: (aid, first_pid)."""
    return profile.join(first, aid).filter(F.col(pid) != F.col("first_pid"))


def first_targets(triples: DataFrame, aid: str = "aid1", order: str = "ord") -> DataFrame:
    return triples.groupBy(F.col(aid).alias("aid")).agg(F.min_by("pid", order).alias("first_pid"))


def gated(outer: str, sim: str = "sim", threshold: float = 1.0) -> Column:
    """The outer source where the profiles are alike enough."""
    return F.when(F.col(sim) >= threshold, F.col(outer))


def consistency(sim: str = "sim") -> Column:
    return F.when(F.col(sim) > 0.5, F.lit("consistent")).otherwise(F.lit("inconsistent"))


def lists(df: DataFrame, aid: str = "aid", pid: str = "pid", order: str = "ord") -> DataFrame:
    """aid, pids in order."""
    return df.groupBy(aid).agg(F.array_sort(F.collect_list(F.struct(order, pid))).alias("_x")).select(aid, F.col(f"_x.{pid}").alias("pids"))


def profile_papers(aids: DataFrame, assignments: DataFrame, papers: DataFrame, how: str = "inner") -> DataFrame:
    """Papers of the profiles of aids; how: inner, or left, which keeps aids that have none."""
    return aids.join(assignments, "aid", how).join(papers, "pid", how)


def prior(df: DataFrame, scores: DataFrame, default: float = 0.5) -> DataFrame:
    return df.join(scores, "pid", "left").withColumn("pred", F.coalesce("pred", F.lit(default)))


def sample(df: DataFrame, k: int, seed: str, aid: str = "aid", pid: str = "pid", order: str = "ord") -> DataFrame:
    """At most k papers of each profile, without replacement; the same ones on every run."""
    nth = F.row_number().over(Window.partitionBy(aid).orderBy(shuffle_key(seed, aid, pid), order))
    return df.withColumn("nth", nth).filter(F.col("nth") <= k)


def nearest_year(df: DataFrame, k: int, seed: str = "42", target: str = "target_year", year: str = "year", aid: str = "aid", pid: str = "pid", order: str = "ord") -> DataFrame:
    """The k papers of each profile with years nearest to its target; a missing year counts as 0. Without a target (0), any k of them, as by `sample`."""
    known = F.coalesce(F.col(target), F.lit(0)) != 0
    away = F.when(known, F.abs(F.coalesce(F.col(year), F.lit(0)) - F.col(target)))
    some = F.when(~known, shuffle_key(seed, aid, pid))
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(aid).orderBy(away, some, order))).filter(F.col("nth") <= k)


def overlap(inner: DataFrame, outer: DataFrame, aid: str = "aid", pid: str = "pid") -> DataFrame:
    """Smaller and larger share of common papers in two profiles of one aid; lengths count repeats."""
    a, b = (d.groupBy(aid).agg(F.count("*").alias(n)) for d, n in ((inner, "n1"), (outer, "n2")))
    common = inner.select(aid, pid).distinct().join(outer.select(aid, pid).distinct(), [aid, pid]).groupBy(aid).agg(F.count("*").alias("common"))
    x, y = F.try_divide("common", "n1"), F.try_divide("common", "n2")
    return a.join(b, aid).join(common, aid, "left").withColumn("common", F.coalesce("common", F.lit(0))).select(aid, "common", F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))
