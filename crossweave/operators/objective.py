"""Scores from logits, cross-entropy, and the soft-logic consistency term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def p_yes(no: Column, yes: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def argmax(no: Column, yes: Column) -> Column:
    return F.when(yes > no, 1).otherwise(0)


def cross_entropy(p: Column, label: Column) -> Column:
    """Of one row; null labels are left out by the mean."""
    return -F.log(F.when(label == 1, p).when(label == 0, 1 - p))


def soft_logic(p: Column, p_out: Column, sim: Column, psi: float = 1.0) -> Column:
    """The term of one paper, 0 or less: how far the rule of its kind is broken."""
    alike = F.least(p_out + sim - p - F.lit(psi), F.lit(0.0))
    other = F.least(F.greatest(p_out, 1 - p_out) - sim + p - F.lit(psi), F.lit(0.0))
    whole = p.isNotNull() & p_out.isNotNull() & sim.isNotNull()  # least and greatest skip nulls
    return F.when(whole, F.when(sim > 0.5, alike).otherwise(other))


def loss(df: DataFrame, kind: str = "ce", alpha: float = 0.5, psi: float = 1.0) -> DataFrame:
    """ce, psl and loss of the rows (p, label, p_out, sim). psl falls back to ce where its fields are missing."""
    if kind not in ("ce", "psl"):
        raise ValueError(f"unknown loss {kind}")
    out = df.agg(F.avg(cross_entropy(F.col("p"), F.col("label"))).alias("ce"), F.avg(soft_logic(F.col("p"), F.col("p_out"), F.col("sim"), psi)).alias("psl"))
    both = F.coalesce(F.lit(alpha) * F.col("psl") + F.lit(1 - alpha) * F.col("ce"), F.col("ce")) if kind == "psl" else F.col("ce")
    return out.withColumn("loss", both)
