"""Ranking metrics per profile, and their macro mean. Wrong assignments are the positive class: labels and scores are complemented."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def author_metrics(df: DataFrame, aid: str = "aid1", label: str = "label", pred: str = "pred") -> DataFrame:
    """aid, auc, ap, sample_count, pos_ratio of each eligible profile. Ties count half for AUC, and share a threshold for AP.

    Rows are first summed by (profile, score), so one shuffle by profile serves the window and the sums after it.
    """
    q = 1 - F.col(pred).cast("double") + F.lit(0.0)
    steps = df.groupBy(F.col(aid).alias("aid"), q.alias("q")).agg(F.sum(1 - F.col(label)).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy("aid").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumns({"tp": F.sum("pos").over(w), "nn": F.sum("n").over(w)})
    out = run.groupBy("aid").agg(
        F.sum("pos").alias("p"), F.sum("n").alias("sample_count"),
        F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("wins"),
        F.sum(F.col("pos") * F.col("tp") / F.col("nn")).alias("gain"),
    )
    ratio = 1 - F.col("p") / F.col("sample_count")
    kept = out.withColumn("pos_ratio", ratio).filter((F.col("p") * 2 <= F.col("sample_count")) & (F.col("p") > 0))
    return kept.select("aid", (F.col("wins") / (F.col("p") * (F.col("sample_count") - F.col("p")))).alias("auc"), (F.col("gain") / F.col("p")).alias("ap"), "sample_count", "pos_ratio")


def macro(authors: DataFrame) -> DataFrame:
    """MAP, AUC, AUC_MAP, n_authors; nulls where no profile is eligible."""
    return authors.agg(F.avg("ap").alias("MAP"), F.avg("auc").alias("AUC"), (F.avg("auc") + F.avg("ap")).alias("AUC_MAP"), F.count("*").alias("n_authors"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", cut: float = 0.5) -> DataFrame:
    return df.agg(F.avg((F.when(F.col(pred) >= cut, 1).otherwise(0) == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def minmax(df: DataFrame, value: str, keys: list[str], low: float = 0.0, high: float = 1.0, out: str = "scaled") -> DataFrame:
    """value scaled to [low, high] in each group; the middle where all are equal."""
    w = Window.partitionBy(*keys)
    a, b = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(a == b, F.lit((low + high) / 2)).otherwise(F.lit(low) + (F.col(value) - a) / (b - a) * (high - low)))


def stopping(log: DataFrame, runs: list[str], step: str, metric: str, patience: int = 3, threshold: float = 0.0) -> DataFrame:
    """Evaluations of each run up to the one after which it stops: better (than all before by more than the threshold), waited (evaluations since the last better one), is_best (the run's checkpoint),
    stopped (the run ends here). A run stops once it has waited for `patience` evaluations. Equal metrics are not better; evaluations without a metric take no part.
    """
    w = Window.partitionBy(*runs).orderBy(step)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = log.filter(F.col(metric).isNotNull()).withColumns({"_n": F.row_number().over(w), "better": before.isNull() | (F.col(metric) - before > threshold)})
    out = out.withColumn("waited", F.col("_n") - F.max(F.when(F.col("better"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    all_ = Window.partitionBy(*runs)
    out = out.withColumn("_stop", F.min(F.when(F.col("waited") >= patience, F.col("_n"))).over(all_)).filter(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop")))
    best = F.max(F.when(F.col("better"), F.col("_n"))).over(all_)
    return out.withColumns({"is_best": F.col("_n") == best, "stopped": F.coalesce(F.col("_n") == F.col("_stop"), F.lit(False))}).drop("_n", "_stop")
