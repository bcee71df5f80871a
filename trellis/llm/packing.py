"""Items packed into containers of fixed capacity by best-two-fit."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import bounded, cut

#: Items that are packed together. A block leaves at most a few containers part-filled, so a larger one wastes less; its memory is in proportion.
BLOCK_ITEMS = 20_000
#: Capacities are a parameter list; a longer one is an error.
MOST_SPECS = 1000


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices into sizes, each size from 1 to capacity.

    A bin is filled greedily with the largest item that still fits. If space is left, its smallest item goes
    back for the two unpacked items that fill the expanded gap most tightly, if they leave less than before.
    Equal sizes are taken in order of index, so the result depends on the input alone.
    """
    order = np.argsort(sizes, kind="stable")[::-1]
    stacks: dict[int, list[int]] = defaultdict(list)
    for i in order:  # the smallest index of a size is on top
        stacks[int(sizes[i])].append(int(i))
    present = bytearray(capacity + 1)
    count = np.zeros(capacity + 1, np.int64)
    for s, st in stacks.items():
        present[s], count[s] = 1, len(st)

    def take(s: int) -> int:
        count[s] -= 1
        if not count[s]:
            present[s] = 0
        return stacks[s].pop()

    bins, left = [], len(sizes)
    while left:
        gap, held = capacity, []
        while gap and (s := present.rfind(1, 1, gap + 1)) > 0:
            for _ in range(min(int(count[s]), gap // s)):
                held.append((s, take(s)))
                gap -= s
        left -= len(held)
        if gap and left:
            m, at = held[-1]  # filled from large to small
            room = gap + m
            a = np.flatnonzero(count[: room // 2 + 1])  # the smaller of the two
            if len(a):
                full = np.flatnonzero(count[:room])
                j = np.searchsorted(full, room - a, side="right") - 1
                b = full[np.maximum(j, 0)]
                ok = (j >= 0) & (b >= a) & ((b > a) | (count[a] > 1)) & (a + b > m)
                if ok.any():
                    k = int(np.argmax(np.where(ok, a + b, -1)))
                    x, y = int(a[k]), int(b[k])
                    held.pop()
                    held += [(y, take(y)), (x, take(x))]
                    stacks[m].append(at)
                    count[m] += 1
                    present[m] = 1
                    left -= 1
        bins.append([i for _, i in held])
    return bins


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One capacity's block: whole pieces of items beyond the capacity get containers of their own, all the rest is packed."""
    pdf = pdf.sort_values(["tokens", "mid"], ascending=[False, True], kind="stable").reset_index(drop=True)
    cap, n = int(pdf["capacity"][0]), pdf["tokens"].to_numpy()
    full, rest = n // cap, n % cap
    bins = best_two_fit(rest[rest > 0], cap)
    where = np.flatnonzero(rest > 0)
    of = np.zeros(len(n), np.int64)
    for b, held in enumerate(bins):
        of[where[held]] = b
    heads = np.repeat(np.arange(len(n)), full)
    piece = np.arange(len(heads)) - np.repeat(np.cumsum(full) - full, full)
    tails = np.flatnonzero((rest > 0) | (n == 0))  # an empty item takes no space: it lies in the block's first container
    base = int(pdf["block"][0]) << 32
    rows = np.concatenate([heads, tails])
    return pd.DataFrame(
        {
            "spec_id": pdf["spec_id"].to_numpy()[rows],
            "container": base + np.concatenate([len(bins) + np.arange(len(heads)), of[tails]]),
            "id": pdf["id"].to_numpy()[rows],
            "piece": np.concatenate([piece, full[tails]]) + 1,
            "start": np.concatenate([piece * cap, full[tails] * cap]),
            "tokens": np.concatenate([np.full(len(heads), cap), rest[tails]]),
        }
    )


def pack(items: DataFrame, specs: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """items (id bigint, tokens) packed for each of specs (spec_id int, capacity int, a short list).

    One row per piece: spec_id, container (unique within a spec), id, piece (from 1), start (first token of the
    item) and tokens. An item is split only if it exceeds the capacity, into pieces of full capacity and one rest.
    Items with null or no tokens take no space and lie in some container. Null ids, repeated ids and
    repeated rows are items like any other. No items or no specs (or specs without a positive capacity): no rows.

    Items are dealt into blocks of about block_items by their place in the stored input, whatever their values
    are, and blocks are packed independently of each other; the number of blocks grows with the input.
    """
    stored = cut(items.select(F.col("id").cast("bigint").alias("id"), F.greatest(F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)), F.lit(0)).alias("tokens")))
    blocks = max(1, -(-stored.count() // block_items))
    x = stored.withColumn("mid", F.monotonically_increasing_id())
    x = x.withColumn("block", F.pmod(F.xxhash64("mid"), F.lit(blocks)))
    s = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("bigint").alias("capacity")).where("capacity > 0 AND spec_id IS NOT NULL")
    wanted = [tuple(r) for r in bounded(s.distinct(), MOST_SPECS, "specs")]  # capacities are a parameter list, not data
    if not wanted:
        return x.select(F.lit(0).alias("spec_id"), F.lit(0).cast("bigint").alias("container"), "id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"), "tokens").where("false")
    each = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in wanted])
    x = x.select("id", "tokens", "mid", "block", F.explode(each).alias("s")).select("s.spec_id", "s.capacity", "block", "mid", "id", "tokens")
    return x.groupBy("spec_id", "block").applyInPandas(_pack, "spec_id int, container bigint, id bigint, piece bigint, start bigint, tokens bigint")


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, pieces, tokens, unused tokens and the share filled."""
    per = packed.groupBy("spec_id", "container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    per = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    bounded(specs, MOST_SPECS, "specs")
    s = specs.select(F.col("spec_id").alias("spec"), F.col("capacity").cast("bigint").alias("capacity"))
    return per.join(F.broadcast(s), F.col("spec_id") == F.col("spec")).select("spec_id", "capacity", "containers", "pieces", "tokens", (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))
