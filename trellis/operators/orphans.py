"""References to rows that do not exist, are withdrawn or arrive later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.session import BROADCAST_ROWS, cut


@dataclass(frozen=True)
class Reference:
    """One reference: rows of refs (id_col, key_col, at_col) name rows of targets (target_key, from_col, until_col)."""

    name: str
    refs: DataFrame
    id_col: str
    key_col: str
    at_col: str
    targets: DataFrame
    target_key: str
    from_col: str
    until_col: str


def clean_key(c: Column) -> Column:
    """Blanks and tabs around a key do not count; nothing left is no key."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(" \t")), F.lit(""))


#: A key is heavy from this many times the mean of rows a key.
HEAVY_TIMES = 8


def _spans(r: Reference) -> DataFrame:
    """key, a, b: when target rows with the key are there. Of spans with the same end the longest is kept, so rows sent again collapse."""
    end = F.col(f"`{r.until_col}`").cast("timestamp")
    x = r.targets.select(clean_key(F.col(f"`{r.target_key}`")).alias("key"), F.col(f"`{r.from_col}`").cast("timestamp").alias("a"), end.alias("b")).where("key IS NOT NULL")
    return x.groupBy("key", "b").agg(F.min("a").alias("a"))


def _kind() -> Column:
    there = F.exists("spans", lambda x: (x["a"] <= F.col("at")) & (x["b"].isNull() | (F.col("at") < x["b"])))
    loaded = F.exists("spans", lambda x: x["a"] <= F.col("at"))
    return F.when(F.col("spans").isNull(), "missing").when(F.col("at").isNull() | F.coalesce(there, F.lit(False)), None).when(F.coalesce(loaded, F.lit(False)), "deleted").otherwise("late")


def heavy_threshold(keys: int, rows: int) -> int:
    """References from which a key is heavy: HEAVY_TIMES the mean, and so many that at most BROADCAST_ROWS keys can have them, whatever the data."""
    return max(2, -(-HEAVY_TIMES * rows // max(1, keys)), -(-rows // BROADCAST_ROWS))


def _refs(r: Reference) -> DataFrame:
    x = r.refs.select(F.col(f"`{r.id_col}`").alias("row_id"), clean_key(F.col(f"`{r.key_col}`")).alias("key"), F.col(f"`{r.at_col}`").cast("timestamp").alias("at")).where("key IS NOT NULL")
    return x.withColumn("period", F.trunc("at", "month"))


def _unsettled(r: Reference, heavy_rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, refs, spans): the (key, period) groups of references that no single target row covers from their first to their last.

    References are counted per key and period, with the first and last arrival; heavy keys' groups are checked against their broadcast
    target rows, the others by an anti-join that shuffles counts, not rows; both are united. Columns of groups: key, period, n and missing (no
    target has the key at all).
    """
    refs, spans = _refs(r), _spans(r)
    counted = cut(refs.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count_if(F.col("at").isNull()).alias("undated")))
    per_key = counted.groupBy("key").agg(F.sum("n").alias("held"))
    if heavy_rows is None:
        size = counted.agg(F.count_distinct("key").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        heavy_rows = heavy_threshold(size["k"], size["n"])
    heavy = F.broadcast(cut(per_key.where(F.col("held") >= heavy_rows).select("key")))  # at most BROADCAST_ROWS keys, see heavy_threshold
    of_heavy = spans.join(heavy, "key", "left_semi").select(F.col("key").alias("k"), "a", "b")
    same = (F.col("key") == F.col("k")) & ((F.col("undated") == F.col("n")) | ((F.col("a") <= F.col("lo")) & (F.col("b").isNull() | (F.col("hi") < F.col("b")))))
    # a heavy key's target rows: one a withdrawal time, counted before they are broadcast
    of_heavy = cut(of_heavy)
    few = F.broadcast(of_heavy) if of_heavy.count() <= BROADCAST_ROWS else of_heavy
    hot = counted.join(heavy, "key", "left_semi").join(few, same, "left_anti")
    cold = counted.join(heavy, "key", "left_anti").join(spans.select(F.col("key").alias("k"), "a", "b"), same, "left_anti")
    return hot.unionByName(cold).select("key", "period", "n"), refs, spans


def _one(r: Reference, heavy_rows: int | None) -> DataFrame:
    groups, refs, spans = _unsettled(r, heavy_rows)
    groups = cut(groups)
    arrays = spans.join(groups.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # one span a withdrawal time
    known = cut(groups.join(arrays, "key", "left").select(F.col("key").alias("k"), F.col("period").alias("p"), "spans"))
    few = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    met = refs.join(few, (F.col("key") == F.col("k")) & F.col("period").eqNullSafe(F.col("p")))
    return met.select(F.lit(r.name).alias("table_name"), "row_id", "at", _kind().alias("kind")).where("kind IS NOT NULL")


def orphans(references: list[Reference], heavy_rows: int | None = None) -> DataFrame:
    """Orphan references: table_name, row_id, at (when the referring row arrived), kind.

    A target row is there from its from-time (included) to its until-time (not included; null: for ever).
    kind is missing if no target row has the key, else deleted if one had arrived by then, else late. Any of
    several target rows will do. Null and blank keys are no references. A target row without a from-time is
    never there; a referring row without an arrival time is a case only if its key is missing altogether.
    Empty targets make every reference missing; empty refs give no rows. Columns besides the named ones, of
    whatever name, do not matter.

    References are pre-aggregated per key and period (month) with map-side combination, so a hot key is one row a task and period. Heavy
    keys, from heavy_rows references (by default heavy_threshold of the data), are checked by broadcast, the others by a shuffled anti-join of the
    aggregates. Only rows of the groups that remain, those that may hold an orphan, are looked at one by one.
    """
    out = None
    for r in references:
        x = _one(r, heavy_rows)
        out = x if out is None else out.unionByName(x)
    return out


def orphan_counts(references: list[Reference], heavy_rows: int | None = None) -> DataFrame:
    """table_name, period (yyyy-MM, null for none), kind and orphans, as orphan_report of orphans, from the aggregates: groups whose key no
    target has count as they are, only groups of keys that have targets are looked at by row."""
    out = None
    for r in references:
        groups, refs, spans = _unsettled(r, heavy_rows)
        arrays = spans.join(groups.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
        known = cut(groups.join(arrays, "key", "left"))
        gone = known.where("spans IS NULL").groupBy("period").agg(F.sum("n").alias("orphans")).withColumn("kind", F.lit("missing"))
        rest = known.where("spans IS NOT NULL").select(F.col("key").alias("k"), F.col("period").alias("p"), "spans")
        few = F.broadcast(rest) if rest.count() <= BROADCAST_ROWS else rest
        met = refs.join(few, (F.col("key") == F.col("k")) & F.col("period").eqNullSafe(F.col("p"))).select("period", _kind().alias("kind")).where("kind IS NOT NULL")
        x = gone.select("period", "kind", "orphans").unionByName(met.groupBy("period", "kind").agg(F.count(F.lit(1)).alias("orphans")))
        x = x.select(F.lit(r.name).alias("table_name"), F.date_format("period", "yyyy-MM").alias("period"), "kind", "orphans")
        out = x if out is None else out.unionByName(x)
    return out


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, month of arrival (null for none) and kind: table_name, period (yyyy-MM), kind, orphans."""
    return found.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("period"), "kind").agg(F.count(F.lit(1)).alias("orphans"))
