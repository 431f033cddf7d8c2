"""Exact deduplication by two passes over Bloom filters; DataFrame operations only.

A text has one bucket of a filter, and a few places in it. Pass 1 shuffles no rows: each task sorts the places of its own rows and puts every other one
into a first bitmap, the rest into a second, so that a place that was hit twice is in both, and only these bitmaps shuffle. Bucket by bucket, each
is compared with all before it; places in two of them form the second filter.
Pass 2 probes that filter, which is broadcast: a row of which some place was hit once has no equal and passes straight through, without a shuffle. Only
the other rows shuffle, and are compared by SHA-256 of the whole text.

The filter grows with the rows, CELLS_PER_ROW bits each, up to `max_bits` bits (128 MB by default, enough for 64 million rows), which bounds what is
broadcast. Beyond that bound more unique rows count as possible repeats and shuffle (texts have one place then, instead of two, where that lets more of
them pass); the result is the same. A task sends two bitmaps of 4 KB for each bucket that it meets; sparse ones shrink when the shuffle compresses them.

Null texts count as empty and equal each other. Null ids sort below all others. Of rows equal in id and text, one is kept. An empty table gives
an empty result. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.llm.common import stored, with_group

PROBES, CELLS_PER_ROW, MAX_BITS = 2, 16, 1 << 30
FEW_BITS = 2  # for a row; with fewer, one probe passes more unique rows than two
BITMAP_BITS = 32768  # of Spark's bitmap functions


def bucket(body: Column, bits: int) -> Column:
    """The bucket of a text."""
    return F.pmod(F.xxhash64(body, F.lit(-1)), F.lit(bits // BITMAP_BITS)).cast("int")


def places(body: Column, probes: int = PROBES) -> list[Column]:
    """A text's places in its bucket, from 0."""
    return [F.pmod(F.xxhash64(body, F.lit(i)), F.lit(BITMAP_BITS)).cast("int") for i in range(probes)]


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    return max(BITMAP_BITS, min(max_bits, 1 << (max(1, rows) * CELLS_PER_ROW - 1).bit_length()))


def task_bitmaps(bodies: DataFrame, bits: int, probes: int = PROBES) -> DataFrame:
    """(bucket, lane, bitmap): for each task two lanes, which both have a place that the task's rows hit more than once.

    Rows with the same place are neighbours once sorted, so that their numbers are odd and even in turn.
    """
    hits = bodies.select(bucket(F.col("body"), bits).alias("bucket"), F.spark_partition_id().alias("task"), F.explode(F.array_distinct(F.array(*places(F.col("body"), probes)))).alias("place"))
    numbered = hits.sortWithinPartitions("bucket", "task", "place").withColumn("odd", F.monotonically_increasing_id() % 2 == 1)
    some = F.bitmap_construct_agg(F.when(F.col("odd"), F.col("place").cast("long"))), F.bitmap_construct_agg(F.when(~F.col("odd"), F.col("place").cast("long")))
    lanes = numbered.groupBy("bucket", "task").agg(some[0].alias("odd"), some[1].alias("even"))
    return lanes.select("bucket", F.posexplode(F.array("odd", "even")).alias("lane", "bitmap"), "task").select("bucket", (F.col("task") * 2 + F.col("lane")).alias("lane"), "bitmap")


def repeated_places(bodies: DataFrame, bits: int, probes: int = PROBES) -> DataFrame:
    """Pass 1: the bitmap of the places that were hit at least twice, (bucket, bitmap), bits / 8 bytes at most."""
    before = Window.partitionBy("bucket").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    seen = task_bitmaps(bodies, bits, probes).withColumn("seen", F.bitmap_or_agg("bitmap").over(before))
    both = seen.select("bucket", "lane", F.explode(F.array("seen", "bitmap")).alias("bitmap")).groupBy("bucket", "lane").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
    return both.filter(F.bitmap_count("bitmap") > 0).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def mark_repeats(df: DataFrame, bitmap: DataFrame, bits: int, probes: int = PROBES) -> DataFrame:
    """Pass 2: df (with body) and `maybe`, false where the row certainly has no equal."""
    small = F.broadcast(bitmap.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))  # at most bits / 8 bytes
    at = F.array(*places(F.col("body"), probes))
    out = df.withColumn("_at", at).withColumn("_bucket", bucket(F.col("body"), bits)).join(small, "_bucket", "left")
    byte = [F.conv(F.hex(F.substring("_bitmap", F.shiftright(F.col("_at")[i], 3) + 1, 1)), 16, 10).cast("int") for i in range(probes)]
    bit = [b.bitwiseAND(F.expr(f"shiftleft(1, cast(_at[{i}] % 8 as int))")) > 0 for i, b in enumerate(byte)]
    maybe = F.col("_bitmap").isNotNull()
    for x in bit:
        maybe = maybe & x
    return out.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("_at", "_bucket", "_bitmap")


def _marked(docs: DataFrame, id_col: str, text_col: str, max_bits: int, *more: Column) -> DataFrame:
    bodies = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = docs.count()
    bits = filter_bits(rows, max_bits)
    probes = PROBES if bits >= FEW_BITS * rows else 1
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), *more)
    return mark_repeats(base, repeated_places(bodies, bits, probes), bits, probes)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = stored(_marked(docs, id_col, text_col, max_bits).select("doc_id", "maybe", F.sha2(F.col("body"), 256).alias("text_sha256")), "marked")  # so that texts are read twice only
    alone = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rows = marked.filter("maybe").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies"))
    grouped = with_group(rows, "text_sha256", "doc_id", {"keep_id": ("max", "doc_id"), "group_size": ("sum", "copies")})
    each = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    met = each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: the one with the largest id; of rows equal in id too, the first by content."""
    marked = _marked(docs, id_col, text_col, max_bits, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    alone = marked.filter(~F.col("maybe")).select("row.*")
    rows = marked.filter("maybe").withColumn("sha", F.sha2("body", 256)).withColumn("has_id", F.col("doc_id").isNotNull())
    best = rows.groupBy("sha").agg(F.max(F.struct("has_id", "doc_id")).alias("best")).select(F.col("sha").alias("k_sha"), F.col("best.doc_id").alias("k_id"))
    won = rows.join(best, (F.col("sha") == F.col("k_sha")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi")
    first = won.withColumn("nth", F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy(F.to_json("row"))))
    return alone.unionByName(first.filter("nth = 1").select("row.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

ORACLE_SQL = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
