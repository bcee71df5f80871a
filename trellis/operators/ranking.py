"""Ranks over a whole table without putting it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.session import broadcast_bounded, cut


def global_index(df: DataFrame, order: Sequence[str], name: str = "index", start: int = 0) -> DataFrame:
    """df with a dense index from start in the total order of the columns of order (which must have no ties to be deterministic).

    Rows are range-partitioned, sorted and stored; a row's index is its place in its stored partition after the counts of the partitions before it. Only one count a partition reaches the driver, and nothing is shuffled again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    counts = sorted((r["pid"], r["count"]) for r in part.groupBy(F.spark_partition_id().alias("pid")).count().collect())
    before, offsets = 0, []
    for pid, c in counts:
        offsets.append((pid, before + start))
        before += c
    if not offsets:
        return part.withColumn(name, F.lit(0).cast("bigint"))
    at = F.monotonically_increasing_id()  # partition * 2^33 + place
    offset = F.create_map(*[F.lit(x).cast("bigint") for kv in offsets for x in kv])[F.shiftright("__at", 33)]
    x = part.withColumn("__at", at)
    return x.withColumn(name, (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + offset).cast("bigint")).drop("__at")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each task's rows before the shuffle, so a hot key sends k rows a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that look random and are the same on every run: the least by md5 of key:seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def sample_or_fail(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """hash_sample, or an error if the table has fewer than n rows."""
    if (have := df.count()) < n:
        raise ValueError(f"{have} rows, {n} wanted")
    return hash_sample(df, key, n, seed)


def stratified_folds(df: DataFrame, label: str, key: str, k: int | Column, seed: int = 42, name: str = "fold") -> DataFrame:
    """df with a fold from 0 to k - 1: rows are numbered within each label in the order of a seeded hash (md5 of key:seed) and of key, modulo k, so a label's folds differ by one row at most.

    The numbers are places in one global order less the place where the label starts; no label needs to fit a task. k may be a column that is the same for all rows of a label.
    """
    x = global_index(df.withColumn("__hash", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))), [label, "__hash", key], "__place")
    first = x.groupBy(F.col(label).alias("__label")).agg(F.min("__place").alias("__first"))
    x = x.join(broadcast_bounded(first), F.col(label).eqNullSafe(F.col("__label")))
    return x.withColumn(name, F.pmod(F.col("__place") - F.col("__first"), k if isinstance(k, Column) else F.lit(k)).cast("int")).drop("__hash", "__place", "__label", "__first")
