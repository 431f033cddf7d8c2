"""Scorer replies: reasoning stripped, JSON found and repaired, scores in order. Columns only; no Python runs on rows.

Differs, on purpose, from a strict parser: an object may stand in prose or a fence, on several lines, with single quotes or a trailing comma; of several
objects the last counts. Values stay strings until they are cast, so that one odd value doesn't lose the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = "map<string,string>"
NESTED = "map<string,map<string,string>>"
_FENCE = r"(?s)```(?:json)?\s*\n(.*?)\n?\s*```"
_OBJECT = r"\{(?:[^{}]|\{[^{}]*\})*\}"
_OPTIONS = {"allowSingleQuotes": "true"}


def reasoning(content: Column) -> Column:
    """The first thought."""
    return F.trim(F.regexp_extract(content, r"(?s)<think>(.*?)</think>", 1))


def answer(content: Column) -> Column:
    """What follows the last thought."""
    return F.trim(F.substring_index(content, "</think>", -1), F.lit(" \n\t\r"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: what from_json reads is not compiled, and shares no expressions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def object_text(content: Column) -> Column:
    """The JSON object of a reply, '{}' where there is none; trailing commas removed."""
    said = answer(F.coalesce(content, F.lit("")))
    body = _once(said, lambda s: _once(F.regexp_extract(s, _FENCE, 1), lambda f: F.when(f != "", f).otherwise(s)))
    found = F.regexp_extract_all(body, F.lit(_OBJECT), F.lit(0))
    return F.regexp_replace(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("{}")), r",\s*\}", "}")


def scores(content: Column, kind: str = SCORES) -> Column:
    """The reply as a map; empty where nothing can be parsed."""
    return F.coalesce(F.from_json(object_text(content), kind, _OPTIONS), F.from_json(F.lit("{}"), kind))


def any_json(content: Column) -> Column:
    """Text of any JSON value in a reply: the whole, or a fenced block, or the widest object; null where there is none."""
    fenced = F.regexp_extract(content, _FENCE, 1)
    wide = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), c)
    return F.coalesce(ok(content), ok(fenced), ok(wide))


def in_order(found: Column) -> Column:
    """Scores by their number as key, keys that aren't numbers left out."""
    rows = F.transform(F.map_entries(found), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].try_cast("double").alias("v")))
    return F.transform(F.array_sort(F.filter(rows, lambda e: e["k"].isNotNull())), lambda e: e["v"])


def for_items(values: Column, n: Column, default: float = 0.5) -> Column:
    """The scores if there are as many as items and all are numbers, else the default for each item."""
    good = lambda x: (F.size(x) == n) & ~F.exists(x, lambda v: v.isNull())
    return _once(values, lambda x: F.when(good(x), x).otherwise(F.array_repeat(F.lit(default), n.cast("int"))))
