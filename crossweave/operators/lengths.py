"""Lengths of texts in tokens, and their first tokens, by the pieces of a text.

A tokenizer first cuts a text into pieces, and then each piece into tokens, whatever stands around it. How a piece is cut is a column of it, or a function of many
pieces (for a tokenizer library) that runs on the executors. Pieces stay with their text: a column cuts them in place, and a library gets the distinct pieces of a batch of rows.
No piece is shuffled or joined; of a row, its keys and a number go on, or its first tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

#: Letters, digits or other characters, each with a space before it, or white space: a fixed pattern.
PIECES = " ?[A-Za-z]+| ?[0-9]+| ?[^ \\t\\n\\rA-Za-z0-9]+|[ \\t\\n\\r]+"

#: What cuts pieces: a column of tokens from a column of pieces, or lists of tokens from a list of pieces.
Cutter = Callable[[Column], Column] | Callable[[list[str]], list[list[str]]]


def by_fours(piece: Column) -> Column:
    """Tokens of at most four characters: a stand-in for a vocabulary."""
    return F.regexp_extract_all(piece, F.lit("(?s).{1,4}"), F.lit(0))


def pieces(text: Column, pattern: str = PIECES) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _by_library(rows: DataFrame, cutter: Cutter, name: str, kind: DataType, each: Callable[[pa.Array, pa.Array, pa.Array], pa.Array]) -> DataFrame:
    """rows, with what `each` makes of the column _pieces in its place, as `name`. each: offsets of the rows in their pieces, places of these among the batch's distinct pieces, tokens of those."""
    keys = [c for c in rows.columns if c != "_pieces"]
    schema = StructType([*(rows.schema[c] for c in keys), StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_pieces")
            coded = column.flatten().dictionary_encode()
            tokens = pa.array(cutter(coded.dictionary.to_pylist()) if len(coded) else [], pa.list_(pa.string()))
            begins = pc.cumulative_sum(pc.list_value_length(column))
            offsets = pa.concat_arrays([pa.array([0], begins.type), begins])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], each(offsets, coded.indices, tokens)], [*keys, name])

    return rows.mapInArrow(run, schema)


def _numbers(offsets: pa.Array, places: pa.Array, tokens: pa.Array) -> pa.Array:
    """How many tokens the pieces of each row have."""
    each = pc.cast(pc.take(pc.list_value_length(tokens), places), pa.int64())
    before = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(each)])
    at = pc.take(before, offsets)
    return pc.subtract(at[1:], at[:-1])


def _lists(offsets: pa.Array, places: pa.Array, tokens: pa.Array) -> pa.Array:
    """The tokens of the pieces of each row."""
    cut = pc.take(tokens, places)
    before = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.list_value_length(cut))])
    return pa.ListArray.from_arrays(pc.take(before, offsets), cut.flatten())


def _part(keys: list[str], parts: int) -> Column:
    """A part of the rows, by their keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def token_lengths(df: DataFrame, keys: list[str], text: str = "text", cutter: Cutter = by_fours, library: bool = False, pattern: str = PIECES, out: str = "n_tokens") -> DataFrame:
    """keys and the number of tokens of the texts of each; 0 for texts that are null or empty. library: whether cutter takes lists."""
    if library:
        each = _by_library(df.select(*keys, pieces(F.col(text), pattern).alias("_pieces")), cutter, "_m", LongType(), _numbers)
    else:
        number = F.aggregate(pieces(F.col(text), pattern), F.lit(0).cast("long"), lambda n, p: n + F.size(cutter(p)))
        each = df.select(*keys, number.alias("_m"))
    return each.groupBy(*keys).agg(F.sum("_m").alias(out))


def first_tokens(df: DataFrame, keys: list[str], n: int, text: str = "text", cutter: Cutter = by_fours, library: bool = False, pattern: str = PIECES) -> DataFrame:
    """keys, text and n_tokens of each row: its first n tokens, as text. keys tell rows apart. A piece has one token at least, so that no more than n pieces are looked at."""
    some = F.slice(pieces(F.col(text), pattern), 1, n) if n > 0 else F.array().cast("array<string>")
    if library:
        every = _by_library(df.select(*keys, some.alias("_pieces")), cutter, "_t", ArrayType(StringType()), _lists)
    else:
        every = df.select(*keys, F.flatten(F.transform(some, cutter)).alias("_t"))
    first = every.select(*keys, F.slice("_t", 1, n).alias("_t"))
    return first.select(*keys, F.array_join("_t", "").alias("text"), F.size("_t").alias("n_tokens"))
