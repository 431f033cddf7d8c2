"""Sharding by weighted rendezvous hashing of a stable record key.

Each shard draws a number from (key, shard) and the record goes to the shard with the largest weight / -ln(draw). Only the key, the shard's name
and its weight decide, so one more shard takes records only into itself, about its share of them, and no other record moves.

A record's slot is its place in its shard, without gaps. Rows of a shard are numbered in chunks, by a hash of key, text and the partition that reads them,
whose counts are then summed up, so that no task gets a whole shard, all rows of one key or all of many equal rows. Null keys are one key; null texts have no bytes. Rows with the same key share a
shard; equal rows are numbered in any order. An empty table gives an empty result, and other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 20_000
SEED = 71


def draw(key: Column, shard: int) -> Column:
    """A number between 0 and 1, ends excluded, from key and shard."""
    return (F.xxhash64(F.lit(SEED), key, F.lit(shard)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key. weights: positive, by shard number."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    bids = [F.struct((F.lit(float(w)) / -F.log(draw(key, s))).alias("bid"), F.lit(-s).alias("minus")) for s, w in sorted(weights.items())]
    return -F.array_max(F.array(*bids)).getField("minus")


def assign(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (by the weights `grown`, null without)."""
    key, body = F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(key.alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), rendezvous(key, weights).cast("int").alias("shard"), (rendezvous(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    chunks = max(8, -(-docs.count() // (ROWS_PER_CHUNK * len(weights))))
    base = base.withColumn("chunk", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "text_crc32", F.spark_partition_id()), F.lit(chunks)))
    counts = base.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1
    return base.withColumn("place", place).join(starts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: dict[int, float], id_col: str = "doc_id", files_per_shard: int = 8) -> None:
    """Writes docs below path as Parquet in folders shard=N, a few files each."""
    out = docs.withColumn("shard", rendezvous(F.col(id_col), weights).cast("int"))
    out.repartition(len(weights) * files_per_shard, "shard", F.pmod(F.xxhash64(F.col(id_col)), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), {s: 1.0 for s in range(8)}, {s: 1.0 for s in range(9)})


QUERIES = {"op10_sharding": op10_sharding}
ORACLE_SQL: dict[str, str] = {}
