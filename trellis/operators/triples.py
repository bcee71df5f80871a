"""Triples: validity, support, provenance and lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import norm_predicate, verbalise
from trellis.operators.ranking import top_per_key


def valid(df: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Triples with s, p and o whose normalised predicate is one of relations (a fixed list, tested in the scan)."""
    return df.where(F.col("s").isNotNull() & F.col("o").isNotNull() & norm_predicate(F.col("p")).isin(*[r.lower() for r in relations]))


def min_support(df: DataFrame, k: int = 1) -> DataFrame:
    return df.where(F.coalesce("support", F.lit(1)) >= k)


def fused_support(df: DataFrame) -> DataFrame:
    """Per (s, p, o): how often it was stated and the sorted union of its origins as text.

    Counts and origins are aggregated apart: the first needs no explode, the second dedups (triple, origin) map-side.
    """
    keys = ["s", "p", "o"]
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))
    origin = df.select(*keys, F.explode("origins").alias("origin")).where("origin IS NOT NULL").distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("origin")), ",").alias("origins"))
    return n.join(origin, keys, "left").withColumn("origins", F.coalesce("origins", F.lit("")))


def inverted_index(df: DataFrame) -> DataFrame:
    """Per concept (a subject or object): the number of distinct triples it is in."""
    x = df.select("p", F.col("s"), F.col("o"), F.explode(F.array_distinct(F.array("s", "o"))).alias("concept")).where("concept IS NOT NULL")
    return x.distinct().groupBy("concept").agg(F.count(F.lit(1)).alias("triples"))


def concept_context(df: DataFrame, k: int = 3) -> DataFrame:
    """Per concept its first k distinct triples as text, in the order of (p, s, o): concept, rank, fact."""
    x = df.select(F.explode(F.array_distinct(F.array("s", "o"))).alias("concept"), "s", "p", "o").where("concept IS NOT NULL AND s IS NOT NULL AND o IS NOT NULL").distinct()
    return top_per_key(x, ["concept"], ["p", "s", "o"], k).select("concept", "rank", verbalise(F.col("s"), F.col("p"), F.col("o")).alias("fact"))


def joined_objects(o: Column) -> Column:
    """A JSON list of objects as one text, other text as it is."""
    return F.coalesce(F.array_join(F.from_json(o, "array<string>"), ", "), o)
