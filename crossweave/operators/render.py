"""Papers, profiles and batches as text for a scorer. The wording is this project's own; labels are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.functions.text import first_words, head_tail

FEATURES = ("title", "author", "organization", "venue", "year", "keywords")


@dataclass(frozen=True)
class Style:
    """clean: each line ends with a line break. distill: the year has none. model: organisations are made distinct before the cap, without a word cut, and names after it."""

    name: str = "clean"

    @property
    def year_end(self) -> str:
        return "" if self.name == "distill" else "\n"

    @property
    def cuts_words(self) -> bool:
        return self.name != "model"


def authors_in_order(authors: Column) -> Column:
    """By sequence number where the first author has one, else as they are."""
    numbered = F.array_sort(F.transform(authors, lambda a, i: F.struct(a["AuthorSequenceNumber"].alias("n"), i.alias("i"), a.alias("a"))))
    return F.when(F.get(authors, F.lit(0))["AuthorSequenceNumber"].isNotNull(), F.transform(numbered, lambda x: x["a"])).otherwise(authors)


def names(authors: Column, style: Style = Style()) -> Column:
    """The authors' names, the middle of a long list left out; made distinct after that for the model."""
    capped = head_tail(F.transform(authors, lambda a: F.coalesce(a["name"], a["OriginalAuthor"], F.lit(""))))
    return capped if style.cuts_words else F.array_distinct(capped)


def organizations(authors: Column, style: Style) -> Column:
    every = F.transform(authors, lambda a: F.coalesce(a["org"], a["OriginalAffiliation"], F.lit("")))
    if not style.cuts_words:  # it is the number of authors that makes a list long
        distinct = F.array_distinct(every)
        return F.when(F.size(authors) > 10, head_tail(distinct)).otherwise(distinct)
    return F.array_distinct(F.transform(head_tail(every), lambda o: first_words(o)))


def paper(features: tuple[str, ...] = FEATURES, style: Style = Style()) -> Column:
    """The text of a paper (columns title, authors, venue, year, keywords); what is missing is named None, missing lists are empty."""
    authors = authors_in_order(F.coalesce(F.col("authors"), F.array().cast("array<struct<name:string,org:string,OriginalAuthor:string,OriginalAffiliation:string,AuthorSequenceNumber:int>>")))
    none = F.lit("None")
    lines = {
        "title": F.concat(F.lit("Title: "), F.coalesce("title", none), F.lit("\n")),
        "author": F.concat(F.lit("Authors: "), F.array_join(names(authors, style), ", "), F.lit("\n")),
        "organization": F.concat(F.lit("Organizations: "), F.array_join(organizations(authors, style), ", "), F.lit("\n")),
        "venue": F.concat(F.lit("Venue: "), F.coalesce("venue", none), F.lit("\n")),
        "year": F.concat(F.lit("Year: "), F.coalesce(F.col("year").cast("string"), none), F.lit(style.year_end)),
        "keywords": F.concat(F.lit("Keywords: "), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", "), F.lit("\n")),
    }
    return F.concat(*[lines[f] for f in features])


def numbered(items: Column) -> Column:
    """'i: item' for each."""
    return F.transform(items, lambda x, i: F.concat(i.cast("string"), F.lit(": "), x))


def similarity_line(sim: Column) -> Column:
    return F.concat(F.lit("Profile similarity: "), F.when(sim.isNull(), "unknown").otherwise(F.format_string("%.2f", sim)))  # a null would be formatted


def prompt_two_sources(name: Column, inner: Column, outer: Column, sim: Column, targets: Column) -> Column:
    return F.concat(
        F.lit("Name: "), name, F.lit("\nInternal profile: "), F.array_join(inner, "; "), F.lit("\nExternal profile: "), F.array_join(outer, "; "),
        F.lit("\n"), similarity_line(sim), F.lit("\nTargets: "), F.array_join(numbered(targets), "; "),
    )


def prompt_one_source(name: Column, profile: Column, targets: Column) -> Column:
    return F.concat(F.lit("Name: "), name, F.lit("\nProfile: "), F.array_join(profile, "; "), F.lit("\nTargets: "), F.array_join(numbered(targets), "; "))


def prompt_clean(collection: Column, targets: Column) -> Column:
    return F.concat(F.lit("Collection:\n"), F.array_join(collection, "\n"), F.lit("\nTargets:\n"), F.array_join(numbered(targets), "\n"))


def prompt_batches(batches: Column) -> Column:
    """batches: array of (batch_idx, items: array of (text, score))."""
    one = lambda b: F.concat(
        F.lit("Batch "), b["batch_idx"].cast("string"), F.lit(", "), F.size(b["items"]).cast("string"), F.lit(" items\n"),
        F.array_join(F.transform(b["items"], lambda x, i: F.concat(i.cast("string"), F.lit(": "), x["text"], F.lit(" | "), F.format_string("%.2f", x["score"]))), "\n"))
    return F.array_join(F.transform(batches, one), "\n")


def chat_context(name: Column, inner: Column, outer: Column, sim: Column) -> Column:
    """What the first turn opens with: the name, both profiles, none for one that is missing, and their similarity."""
    part = lambda items: F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise("none")
    return F.concat(F.lit("Name: "), name, F.lit("\nInternal profile:\n"), part(inner), F.lit("\nExternal profile:\n"), part(outer), F.lit("\n"), similarity_line(sim))


def chat(system: Column, context: Column, items: Column) -> Column:
    """Messages: system, then a user turn and an empty assistant turn for each item; the first user turn opens with the context."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = F.transform(items, lambda x, i: F.array(said("user", F.when(i == 0, F.concat(context, F.lit("\n"), x)).otherwise(x)), said("assistant", F.lit(""))))
    return F.concat(F.array(said("system", system)), F.flatten(turns))


def flat(system: Column, context: Column, items: Column) -> Column:
    return F.concat_ws("\n", system, context, F.array_join(items, "\n"))


def rendered(papers: DataFrame, features: tuple[str, ...] = FEATURES, style: Style = Style()) -> DataFrame:
    """pid, text: each paper once, before it is joined to the profiles that hold it."""
    return papers.select("pid", paper(features, style).alias("text"))
