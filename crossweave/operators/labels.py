"""Labels: thresholds, splits, upsampling; and the reducers that turn scores back into labels and clean profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold(df: DataFrame, cut: float = 0.9, soft: str = "soft_label") -> DataFrame:
    """label from soft labels; the label before stays as ori_label."""
    return df.withColumn("ori_label", F.col("label")).withColumn("label", F.when(F.col(soft) >= cut, 1).otherwise(0))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("label = 1"), df.filter("label = 0")


def upsample(df: DataFrame) -> DataFrame:
    """Rows with label 0 repeated k times, k = label-1 rows over label-0 rows, at least 1. Column copy numbers them."""
    counts = df.agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_q"))
    k = F.greatest(F.lit(1), F.coalesce(F.try_divide("_p", "_q"), F.lit(1)).cast("long"))
    k = F.when(F.col("label") == 0, counts.select(k).scalar()).otherwise(F.lit(1).cast("long"))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), k)))


def soft_labels(triples: DataFrame, refined: DataFrame) -> DataFrame:
    """triples with the refined score of their pair and paper as soft_label, where there is one."""
    new = refined.groupBy("aid1", "aid2", "pid").agg(F.avg("new_pred").alias("_new"))
    return triples.join(new, ["aid1", "aid2", "pid"], "left").withColumn("soft_label", F.coalesce("_new", "soft_label")).drop("_new")


def clean_profiles(assignments: DataFrame, votes: DataFrame, cut: float = 0.5) -> DataFrame:
    """Assignments whose cleaning score reaches the cut; those without a score stay. votes: aid, pid, score."""
    marks = votes.groupBy("aid", "pid").agg(F.round(F.avg("score"), 9).alias("_score"))  # whatever the order in which the votes are added
    return assignments.join(marks, ["aid", "pid"], "left").filter(F.coalesce(F.col("_score") >= cut, F.lit(True))).drop("_score").withColumn("variant", F.lit("clean"))
