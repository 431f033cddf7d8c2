"""Vectors as array columns: dot products with a small head, means, rows for new tokens; logits at the places of a label token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.operators.objective import p_yes


def dot(a: Column, b: Column) -> Column:
    """Null where one is longer."""
    product = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(product, F.lit(0.0), lambda n, x: n + x)


def projected(df: DataFrame, head: DataFrame, names: list[str], vector: str = "embedding", row: str = "row") -> DataFrame:
    """df with a column for each row of a head, in order of its column `row`: the dot product with the vector. head: row and vector, as many rows as names.

    The head is one value of a few rows, as the two of a binary classifier, so that nothing is joined.
    """
    rows = head.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row), F.col(vector)))), lambda x: x[vector])).scalar()
    return df.withColumn("_head", rows).withColumns({n: dot(F.col(vector), F.get("_head", F.lit(i))) for i, n in enumerate(names)}).drop("_head")


def mean_vectors(df: DataFrame, keys: list[str], vector: str = "embedding", size: int | None = None) -> DataFrame:
    """keys and the mean of their vectors, place by place. Sums are made before anything is shuffled. size: of a vector; by default that of the longest."""
    if size is None:
        size = df.agg(F.max(F.size(vector))).first()[0] or 0
    means = df.groupBy(*keys).agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(size)], F.count("*").alias("_n"))
    return means.select(*keys, F.array(*[F.col(f"_{i}") for i in range(size)]).alias(vector))


def with_new_rows(df: DataFrame, new: DataFrame, vector: str = "embedding", size: int | None = None) -> DataFrame:
    """df and a row for each of new (the other columns), whose vector is the mean of all that df has."""
    mean = mean_vectors(df, [], vector, size).scalar()
    return df.unionByName(new.withColumn(vector, mean.cast(dict(df.dtypes)[vector])), allowMissingColumns=True)


def places(ids: Column, label: int) -> Column:
    """Where a token stands, from 0."""
    return F.filter(F.transform(ids, lambda x, i: F.when(x == label, i)), lambda i: i.isNotNull())


def label_logits(ids: Column, no: Column, yes: Column, label: int) -> Column:
    """place, no, yes of each label token: logits predict the next token, so they are those at the place before; null at the first place, which has none before."""
    at = lambda logits, i: F.when(i > 0, F.get(logits, i - 1))
    return F.transform(places(ids, label), lambda i: F.struct(i.alias("place"), at(no, i).alias("no"), at(yes, i).alias("yes")))


def label_scores(ids: Column, no: Column, yes: Column, label: int) -> Column:
    """place and p of each label token. no, yes: of each place the two logits of a binary head, or those of two ids of the vocabulary (`id_logits`)."""
    return F.transform(label_logits(ids, no, yes, label), lambda x: F.struct(x["place"].alias("place"), p_yes(x["no"], x["yes"]).alias("p")))


def id_logits(logits: Column, token: int) -> Column:
    """Of logits over a vocabulary, place by place, those of one id."""
    return F.transform(logits, lambda x: F.get(x, F.lit(token)))
