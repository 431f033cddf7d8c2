"""Readers of profile maps, paper dictionaries, triples and scores, as JSON or Parquet.

Maps are parsed with a fixed schema and exploded; nothing is inferred, so that a file with millions of keys doesn't become as many columns. A file is one JSON
value, of any size: its entries are read by many tasks (`json_entries`). With `lines`, it has a value in each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave import schema
from crossweave.sources import json_entries


def _values(spark: SparkSession, path: str, lines: bool, kind: str, end: str) -> DataFrame:
    """value, place: JSON values of one kind, '{}' or '[]', each with one entry of the file, or a line of it; a line may hold an array's item by itself. end: a bracket that entries have."""
    e = F.col("entry")
    if lines:
        found = json_entries.lines(spark, path)
        value = F.when(F.ltrim(e).startswith(kind[0]), e).otherwise(F.concat(F.lit(kind[0]), e, F.lit(kind[1]))) if kind == "[]" else e
    else:
        found, value = json_entries.entries(spark, path, end), F.concat(F.lit(kind[0]), e, F.lit(kind[1]))
    return found.select(value.alias("value"), "place")


def _json(texts: DataFrame, kind: str) -> DataFrame:
    return texts.select(F.from_json("value", kind).alias("v"), *(["place"] if "place" in texts.columns else []))


def _ordered(texts: DataFrame, order: str) -> Column:
    """The place in the file: that of the value, where it is known, as a value then has one entry, or those of a line; else that in the value."""
    return F.col("place") if "place" in texts.columns else F.col(order)


def parse_flat(texts: DataFrame, source: str, variant: str = "raw") -> DataFrame:
    """{aid: [pid]} in the column value -> assignments without names."""
    pairs = _json(texts, "map<string,array<string>>").select(F.explode("v").alias("aid", "pids"))
    return pairs.select(F.lit(None).cast("string").alias("name"), F.lit(source).alias("source"), F.lit(variant).alias("variant"), "aid", F.posexplode("pids").alias("ord", "pid"))


def parse_named(texts: DataFrame, source: str, variant: str = "raw") -> DataFrame:
    """{name: {aid: [pid]}} in the column value -> assignments, with the name's place in the file."""
    names = _json(texts, "map<string,map<string,array<string>>>").select("*", F.posexplode("v").alias("name_ord", "name", "m")).withColumn("name_ord", _ordered(texts, "name_ord"))
    pairs = names.select("name", "name_ord", F.explode("m").alias("aid", "pids"))
    return pairs.select("name", F.lit(source).alias("source"), F.lit(variant).alias("variant"), "aid", F.posexplode("pids").alias("ord", "pid"), "name_ord")


def source_of(path: str) -> str:
    """in or out, as the path of a named map tells."""
    found = [s for s in ("in", "out") if f"name_aid_to_pids_{s}" in path]
    if len(found) != 1:
        raise ValueError(f"no source named in {path}")
    return found[0]


def sources_of(path: Column) -> Column:
    """`source_of` of a column of paths; rows without a source raise."""
    inner, outer = (path.contains(f"name_aid_to_pids_{s}") for s in ("in", "out"))
    none = F.raise_error(F.concat(F.lit("no source named in "), path)).cast("string")
    return F.when(inner & ~outer, "in").when(outer & ~inner, "out").otherwise(none)


def flat_profiles(spark: SparkSession, path: str, source: str, variant: str = "raw", lines: bool = False) -> DataFrame:
    return parse_flat(_values(spark, path, lines, "{}", "]"), source, variant)


def named_profiles(spark: SparkSession, path: str, source: str | None = None, variant: str = "raw", lines: bool = False) -> DataFrame:
    """source: in or out; by default what the path tells. With `lines`, a line holds the profiles of whole names, and names have its place."""
    return parse_named(_values(spark, path, lines, "{}", "]"), source or source_of(path), variant)


def profiles(spark: SparkSession, path: str, source: str, variant: str = "raw") -> DataFrame:
    """Either shape: a file whose values aren't lists is taken as named."""
    values = _values(spark, path, False, "{}", "]")
    flat = _json(values, "map<string,string>").select(F.explode("v").alias("k", "t")).limit(1).first()
    return parse_named(values, source, variant) if flat and flat.t.lstrip().startswith("{") else parse_flat(values, source, variant)


def parse_papers(texts: DataFrame) -> DataFrame:
    """{pid: paper} in the column value -> papers."""
    return _json(texts, f"map<string,{schema.PAPER}>").select(F.explode("v").alias("pid", "p")).select("pid", "p.*")


def papers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return parse_papers(_values(spark, path, lines, "{}", "}"))


def parse_triples(texts: DataFrame) -> DataFrame:
    """An array of objects in the column value, in order; ids are strings."""
    kind = ",".join(c.strip().replace(" ", ":", 1) for c in schema.TRIPLES.split(",") if not c.strip().startswith("ord "))
    rows = _json(texts, f"array<struct<{kind}>>")
    return rows.select("*", F.posexplode("v").alias("ord", "t")).select("t.*", _ordered(texts, "ord").cast("long").alias("ord"))


def triples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """With `lines`, an object in each line; of a line that holds an array, all have the line's place."""
    return parse_triples(_values(spark, path, lines, "[]", "}"))


def scored_requests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Requests with their replies, an array of objects: what an earlier step has written."""
    return parse_scored(_values(spark, path, lines, "[]", "}"))


def parse_scored(texts: DataFrame) -> DataFrame:
    kind = "struct<aid1:string,aid2:string,name:string,pids:array<string>,author_sim:double,inputs:string,content:string,reasoning_content:string>"
    rows = _json(texts, f"array<{kind}>").select("*", F.posexplode("v").alias("ord", "r")).select(_ordered(texts, "ord").cast("long").alias("ord"), "r.*")
    return rows.withColumnsRenamed({"inputs": "prompt", "reasoning_content": "reasoning"})


def prior_scores(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """pid, pred; the last entry of a pid wins."""
    return parse_prior(_values(spark, path, lines, "[]", "}"))


def parse_prior(texts: DataFrame) -> DataFrame:
    rows = _json(texts, "array<struct<pid:string,pred:double>>").select("*", F.posexplode("v").alias("ord", "t")).select(_ordered(texts, "ord").alias("ord"), "t.*")
    return last_wins(rows, ["pid"], "ord").select("pid", "pred")


def last_wins(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def triples_for(spark: SparkSession, mode: str, paths: dict[str, str]) -> DataFrame:
    """The file of a mode: train, eval, and test for any other."""
    return triples(spark, paths[mode if mode in ("train", "eval") else "test"])


def union_triples(*parts: DataFrame) -> DataFrame:
    """All rows, ids as strings, columns that a part lacks as null. Where there is `ord`, places go on from part to part: it becomes (part, place) in one
    number, so that the first of repeats across parts is that of the first part."""
    numbered = [p.withColumn("ord", F.lit(i << 48) + F.col("ord")) if "ord" in p.columns else p for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({c: F.col(c).cast("string") for c in ("aid1", "aid2", "pid") if c in out.columns})
