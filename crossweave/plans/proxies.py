"""Stand-ins for profile, paper and triple tables, made from the general test tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("aid1"), F.col("event_id").cast("string").alias("pid"), (F.col("value") / 500).alias("pred"), (F.col("event_type") != "error").cast("int").alias("label"), "event_type", F.col("event_id").alias("ord"))


SCORED = "scored AS (SELECT CAST(user_id AS VARCHAR) AS aid1, CAST(event_id AS VARCHAR) AS pid, value / 500 AS pred, CAST(event_type <> 'error' AS INT) AS label, event_type, event_id AS ord FROM events)"


def tied(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_suppkey").cast("string").alias("aid1"), (F.col("l_quantity") / 50).alias("pred"), (F.col("l_returnflag") != "R").cast("int").alias("label"))


TIED = "scored AS (SELECT CAST(l_suppkey AS VARCHAR) AS aid1, l_quantity / 50 AS pred, CAST(l_returnflag <> 'R' AS INT) AS label FROM lineitem)"


def assignments(spark: SparkSession, d: str, status: str) -> DataFrame:
    x = table(spark, d, "lineitem").filter(F.col("l_linestatus") == status)
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return x.select(F.col("l_suppkey").cast("string").alias("aid"), (F.row_number().over(w) - 1).alias("ord"), F.col("l_partkey").cast("string").alias("pid"))


ASSIGNED = """{name} AS (SELECT CAST(l_suppkey AS VARCHAR) AS aid, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS INT) AS ord,
    CAST(l_partkey AS VARCHAR) AS pid FROM lineitem WHERE l_linestatus = '{status}')"""
INNER, OUTER = ASSIGNED.format(name="inn", status="O"), ASSIGNED.format(name="outr", status="F")
