"""Caps on lists and words, and places of targets in a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head_tail(items: Column, head: int = 8, tail: int = 2) -> Column:
    """The first and last few of a list that is longer than both together."""
    return F.when(F.size(items) > head + tail, F.concat(F.slice(items, 1, head), F.slice(items, -tail, tail))).otherwise(items)


def first_words(text: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def first_tokens(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def canonical(pids: Column) -> Column:
    """A key for a set of ids, in whatever order they come."""
    return F.array_join(F.array_sort(pids), "-")


def token_length(text: Column) -> Column:
    """Words, where no tokenizer is given."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
