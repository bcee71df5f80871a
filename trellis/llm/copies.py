"""Records that are the same but for formatting, collapsed to one each with the number of copies.

Canonical records are range-partitioned by (record, id), sorted on disk where memory ends, and scanned once:
neighbours with the same full record form a run. The id is part of the range key, so a record that makes up a
third of all rows spreads over as many partitions as its rows need; the runs cut at a partition's edge
are put together again from one row per edge.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.session import cut, stored

#: Rows of one range on average; more rows make more ranges.
RANGE_ROWS = 2_000_000


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def bare(c: Column, keep: str = "") -> Column:
    """c in folded case with only its letters, marks and digits, points between two digits, and the characters of keep.

    Letters keep script and accents; a letter with its accent in two characters counts as the one composed
    of both. Runs in the JVM; text beyond ASCII is composed and folded by the Unicode library that
    Spark ships.
    """

    def strip(x: Column, letters: str) -> Column:
        plain = F.regexp_replace(x, f"[^{letters}{keep}]+", "")
        pointed = F.regexp_replace(x, rf"(?<![{letters}])\.|(?<=[{letters}])(?<!\p{{Nd}})\.|\.(?!\p{{Nd}})|[^{letters}{keep}.]+", "")
        return F.when(F.contains(x, F.lit(".")), pointed).otherwise(plain)

    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    other = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), strip(composed, r"\p{L}\p{M}\p{Nd}"), F.lit(True))
    return F.when(_is_ascii(c), F.lower(strip(c, "A-Za-z0-9"))).otherwise(other)


def members(c: Column) -> Column:
    """bare text whose parts between commas and semicolons are in order; empty parts do not count, repeated ones do."""
    parts = F.array_sort(F.filter(F.split(bare(c, ",;"), "[,;]"), lambda y: y != ""))
    return F.when(F.contains(c, F.lit(",")) | F.contains(c, F.lit(";")), F.array_join(parts, ",")).otherwise(bare(c))


#: Relations whose two ends may be exchanged, as bare text. Fixed values.
SYMMETRIC = ("associatedwith", "interactswith", "binding")


@dataclass(frozen=True)
class TripleRecord:
    """What makes two triples the same record; symmetric relations take their ends in either order.

    Rows with a null id, s, p or o are left out. Texts without any letter or digit are the empty text and equal each
    other. Parts of s and o that are empty do not count, repeated parts do. Ids should be unique. Columns besides
    the four named ones, of whatever name, do not matter; texts of any length are read whole.
    """

    id_col: str = "id"
    s: str = "s"
    p: str = "p"
    o: str = "o"
    symmetric: Sequence[str] = SYMMETRIC

    def records(self, df: DataFrame) -> DataFrame:
        x = df.select(F.col(f"`{self.id_col}`").cast("bigint").alias("id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((self.s, "s"), (self.p, "p"), (self.o, "o"))])
        x = x.where("id IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        x = x.select("id", members(F.col("s")).alias("s"), bare(F.col("p")).alias("p"), members(F.col("o")).alias("o"))
        swap = F.col("p").isin(*self.symmetric) & (F.col("s") > F.col("o"))
        return x.select("id", F.concat_ws("|", "p", F.when(swap, F.col("o")).otherwise(F.col("s")), F.when(swap, F.col("s")).otherwise(F.col("o"))).alias("record"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, bool]]:
    """Per batch: ids, for each row whether its record differs from the one before, the records, and whether it is the first batch."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        start = np.ones(len(ids), bool)
        if len(ids) > 1:
            start[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        first = last is None
        start[0] = first or not pc.equal(key[:1], last)[0].as_py()
        last = key[len(key) - 1 :]
        yield ids, start, key, first


_PAIR = pa.schema([("keep", pa.int64()), ("copy", pa.int64()), ("edge", pa.string())])
_COUNT = pa.schema([("keep", pa.int64()), ("n", pa.int64()), ("edge", pa.string())])


def _scan_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """keep and copy for every further row of a run; edge rows (copy null) name the first and the last run's record."""
    keep = before = None
    key = None
    for ids, start, key, first in _runs(batches):
        at = np.maximum.accumulate(np.where(start, np.arange(len(ids)), -1))
        kept = np.where(at >= 0, ids[at], 0 if keep is None else keep)
        new = ~start
        new[1:] &= ids[1:] != ids[:-1]  # a repeated id is no copy of itself
        if new[0] and before == ids[0]:
            new[0] = False
        new &= ids != kept
        ks, cs, es = kept[new], ids[new], [None] * int(new.sum())
        if first:
            yield pa.record_batch([pa.array([int(ids[0])], pa.int64()), pa.nulls(1, pa.int64()), pa.array([key[0].as_py()], pa.string())], schema=_PAIR)
        keep, before = int(kept[-1]), int(ids[-1])
        if len(ks):
            yield pa.record_batch([pa.array(ks, pa.int64()), pa.array(cs, pa.int64()), pa.array(es, pa.string())], schema=_PAIR)
    if key is not None:
        yield pa.record_batch([pa.array([keep], pa.int64()), pa.nulls(1, pa.int64()), pa.array([key[len(key) - 1].as_py()], pa.string())], schema=_PAIR)


def _scan_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """keep and number of rows of every run; edge holds the record of the first and the last run."""
    held: tuple[int, int, str | None] | None = None  # the run not ended yet
    key = None
    for ids, start, key, first in _runs(batches):
        at = np.flatnonzero(start)
        head = int(at[0]) if len(at) else len(ids)
        if held is not None:
            held = (held[0], held[1] + head, held[2])
        if not len(at):
            continue
        keeps, ns = ids[at], np.diff(np.append(at, len(ids)))
        out_k, out_n = [keeps[:-1]], [ns[:-1]]
        edge: list[str | None] = [None] * (len(keeps) - 1)
        if first and edge:
            edge[0] = key[0].as_py()
        if held is not None:
            out_k, out_n, edge = [np.array([held[0]]), *out_k], [np.array([held[1]]), *out_n], [held[2], *edge]
        held = (int(keeps[-1]), int(ns[-1]), key[0].as_py() if first and len(keeps) == 1 else None)
        k = np.concatenate(out_k)
        if len(k):
            yield pa.record_batch([pa.array(k, pa.int64()), pa.array(np.concatenate(out_n), pa.int64()), pa.array(edge, pa.string())], schema=_COUNT)
    if held is not None:
        yield pa.record_batch([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([key[len(key) - 1].as_py()], pa.string())], schema=_COUNT)


def _sorted(records: DataFrame) -> DataFrame:
    """The records in order over ranges of about RANGE_ROWS rows. They are stored first, as finding the ranges reads them once more."""
    r = stored(records.where("record IS NOT NULL").select("record", "id"))
    n = max(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-r.count() // RANGE_ROWS))
    return r.repartitionByRange(n, "record", "id").sortWithinPartitions("record", "id")


def _moved(edges: DataFrame) -> DataFrame:
    """keep -> real for runs that began in an earlier partition; at most two rows a partition go in."""
    real = edges.groupBy("edge").agg(F.min("keep").alias("real"))
    return edges.select("edge", "keep").distinct().join(real, "edge").where("keep <> real").select("keep", "real").distinct()


def copy_pairs(records: DataFrame) -> DataFrame:
    """records (id, record): keep_id, copy_id for every row that is not the first of its record; keep_id is the record's smallest id.

    Null records are left out by TripleRecord; here they would be one record. Rows that repeat an id give no
    pair with themselves. An empty table gives no rows; records of any length are compared in full.
    """
    scan = cut(_sorted(records).mapInArrow(_scan_pairs, "keep bigint, copy bigint, edge string"))
    moved = _moved(scan.where("edge IS NOT NULL"))
    pairs = scan.where("copy IS NOT NULL").select("keep", "copy")
    found = pairs.join(F.broadcast(moved), "keep", "left").select(F.coalesce("real", "keep").alias("keep_id"), F.col("copy").alias("copy_id"))
    return found.unionByName(moved.select(F.col("real").alias("keep_id"), F.col("keep").alias("copy_id")))


def collapse(records: DataFrame) -> DataFrame:
    """records (id, record): keep_id and copies (rows of the record, itself included), one row per record. Edge cases as in copy_pairs."""
    scan = cut(_sorted(records).mapInArrow(_scan_counts, "keep bigint, n bigint, edge string"))
    moved = _moved(scan.where("edge IS NOT NULL"))
    inner = scan.where("edge IS NULL").select(F.col("keep").alias("keep_id"), F.col("n").alias("copies"))
    outer = scan.where("edge IS NOT NULL").join(F.broadcast(moved), "keep", "left").groupBy(F.coalesce("real", "keep").alias("keep_id")).agg(F.sum("n").alias("copies"))
    return inner.unionByName(outer)


__all__ = ["SYMMETRIC", "TripleRecord", "bare", "collapse", "copy_pairs", "members"]
