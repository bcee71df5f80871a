"""Sources mixed to target weights under limits on repetition."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.session import BROADCAST_ROWS, bounded, cut

#: Texts that are permuted together.
BLOCK_ITEMS = 10_000
#: Targets are a parameter list; a longer one is an error.
MOST_TARGETS = 10_000


@dataclass(frozen=True)
class Source:
    name: str
    tokens: int
    target: float
    max_repeats: int


def tempered(shares: list[float], exponent: float, towards: list[float] | None = None) -> list[float]:
    """Shares raised to exponent and normalised; with towards, the shares times (towards/shares) to the exponent: 0 gives shares, 1 towards."""
    raw = [s**exponent if towards is None else s * (t / s) ** exponent if t else (0.0 if exponent else s) for s, t in zip(shares, towards or shares)]
    return [r / sum(raw) for r in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def _bisect(ok, lo: float, hi: float) -> float:
    """The largest exponent in [lo, hi] for which ok holds, given that it holds at lo."""
    if ok(hi):
        return hi
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent in [0, 1] at which the tempered shares have the target entropy (0: all alike, the most; 1: as they are)."""
    return _bisect(lambda a: entropy(tempered(shares, a)) >= target, 0.0, 1.0)


def plan(sources: list[Source], budget: int | None = None) -> tuple[float, float, dict[str, float]]:
    """(exponent, budget, weight per source).

    Weights are the sources' natural token shares times (target/natural) to an exponent, found by bisection
    as the largest in [0, 1] at which no source has to repeat beyond its limit. Without a budget it is the
    largest at which the exponent can be 1, that is at which all targets are met exactly; more than what all
    sources hold at their limits is cut to that. Sources without tokens or without a target get no weight.
    """
    live = [s for s in sources if s.tokens > 0 and s.target > 0 and s.max_repeats > 0]
    if not live:
        return 1.0, 0.0, {s.name: 0.0 for s in sources}
    total, aim = sum(s.tokens for s in live), sum(s.target for s in live)
    natural, target = [s.tokens / total for s in live], [s.target / aim for s in live]
    most = min(s.max_repeats * s.tokens / t for s, t in zip(live, target))
    even = min(s.max_repeats for s in live) * total  # at exponent 0 all sources repeat alike
    b = most if budget is None else min(float(budget), max(most, even))
    fits = lambda w: all(x * b <= s.max_repeats * s.tokens * (1 + 1e-9) for x, s in zip(w, live))
    a = _bisect(lambda e: fits(tempered(natural, e, target)), 0.0, 1.0)
    w = dict(zip([s.name for s in live], tempered(natural, a, target)))
    return a, b, {s.name: w.get(s.name, 0.0) for s in sources}


def _fill_rest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block's texts in their permuted order, each that still fits the rest of the budget."""
    pdf = pdf.sort_values(["turn", "id"], kind="stable")
    left, more = float(pdf["rest"].iloc[0] - pdf["before"].iloc[0]), []
    for n in pdf["tokens"]:
        more.append(int(n <= left))
        left -= n * more[-1]
    return pdf.assign(more=more)[["source", "id", "tokens", "block", "passes", "more"]]


def mix(items: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 1, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """items (id, source, tokens, same) mixed to targets (source, target_share, max_repeats; a short list).

    One row per use of a text: source, id, use_no (from 1), tokens, place (above 0, below 1; sorting by it gives the
    order of training) and exponent (the plan's, the same everywhere). Texts are equal if same is equal; of equal texts one stands for all, the one whose
    source allows the fewest repeats (ties: the smaller source name, then the smaller id), so that no text is used more often than
    its copies' strictest limit. Texts without tokens, without a source or from a source without a target
    are not used. Repeated targets of a source: the first by share. Empty items or targets give no rows.

    Each source takes whole passes over its texts and then, in blocks ordered by a seeded hash, as many whole blocks as the rest of
    its budget holds, and of the next block, in its permuted order, each text that still fits: what stays unfilled is less than
    any text left in that block. Only token sums per source and block are summed in order; one block a source is looked at text by text.

    The order is made of block permutations: each pass of a source puts its blocks, and each block its texts, in an order of its own.
    A use's place is the share of its source's tokens that come before its middle, so any stretch of the order holds the
    sources in their weights. Running sums go over one block, or over a source's block sums.
    """
    goals = {}
    listed = targets.select(F.col("source").alias("s"), F.col("target_share").cast("double").alias("t"), F.col("max_repeats").cast("int").alias("m")).where("s IS NOT NULL AND t IS NOT NULL AND m IS NOT NULL")
    for r in sorted(bounded(listed, MOST_TARGETS, "targets"), key=lambda r: (r["s"], -r["t"], r["m"])):
        goals.setdefault(r["s"], (r["t"], r["m"]))
    x = items.select(F.col("id").cast("bigint").alias("id"), F.col("source").cast("string").alias("source"), F.col("tokens").cast("bigint").alias("tokens"), "same").where("source IS NOT NULL AND tokens > 0 AND same IS NOT NULL")
    if not goals:
        return x.select("source", "id", F.lit(1).alias("use_no"), "tokens", F.lit(0.5).alias("place"), F.lit(1.0).alias("exponent")).where("false")
    limits = F.create_map(*[v for s, (_, m) in goals.items() for v in (F.lit(s), F.lit(m))])
    x = x.withColumn("limit", limits[F.col("source")]).where("limit IS NOT NULL")
    one = cut(x.groupBy("same").agg(F.min(F.struct("limit", "source", "id", "tokens")).alias("u")).select("same", "u.source", "u.id", "u.tokens"))
    sums = {r["source"]: (r["n"], r["tokens"]) for r in one.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()}  # one row per source with a target
    a, b, weights = plan([Source(s, sums.get(s, (0, 0))[1], t, m) for s, (t, m) in goals.items()], budget)
    passes, rests, blocks = {}, {}, {}
    for s, (n, tokens) in sums.items():
        want = weights[s] * b
        passes[s] = min(int(want / tokens + 1e-9), goals[s][1])
        rests[s] = max(0.0, want - passes[s] * tokens) if passes[s] < goals[s][1] else 0.0
        blocks[s] = max(1, -(-n // block_items))
    if not sums:
        return x.select("source", "id", F.lit(1).alias("use_no"), "tokens", F.lit(0.5).alias("place"), F.lit(1.0).alias("exponent")).where("false")
    of = lambda d, kind: F.create_map(*[v for s, k in d.items() for v in (F.lit(s), F.lit(k).cast(kind))])[F.col("source")]
    one = one.withColumn("block", F.pmod(F.xxhash64("same", F.lit(seed)), of(blocks, "bigint")))
    sums_of = one.groupBy("source", "block").agg(F.sum("tokens").alias("held"))
    turn = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block")
    sums_of = cut(sums_of.withColumn("before", F.sum("held").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")))
    if sums_of.count() <= BROADCAST_ROWS:
        sums_of = F.broadcast(sums_of)
    y = one.join(sums_of, ["source", "block"]).withColumns({"passes": of(passes, "int"), "rest": of(rests, "double")})
    whole = y.where("before + held <= rest OR before >= rest").withColumn("more", F.when(F.expr("before + held <= rest"), 1).otherwise(0))
    edge = y.where("before + held > rest AND before < rest")  # one block a source
    cols = ["source", "id", "tokens", "block", "passes", "rest", "before", "turn"]
    edge = edge.withColumn("turn", F.xxhash64("same", F.lit(seed + 1))).select(*cols)
    edge = edge.groupBy("source").applyInPandas(_fill_rest, "source string, id bigint, tokens bigint, block bigint, passes int, more int")
    used = whole.select("source", "id", "tokens", "block", "passes", "more").unionByName(edge).withColumn("uses", F.col("passes") + F.col("more")).where("uses > 0")
    used = cut(used.select("source", "id", "tokens", "block", F.explode(F.sequence(F.lit(1), "uses")).alias("use_no")))
    deal = used.groupBy("source", "use_no", "block").agg(F.sum("tokens").alias("in_block"))
    order = Window.partitionBy("source").orderBy("use_no", F.xxhash64("use_no", "block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, 0)
    deal = cut(deal.withColumns({"ahead": F.sum("in_block").over(order) - F.col("in_block"), "of_source": F.sum("in_block").over(Window.partitionBy("source"))}).drop("in_block"))
    own = Window.partitionBy("source", "use_no", "block").orderBy(F.xxhash64("id", "use_no", F.lit(seed)), "id").rowsBetween(Window.unboundedPreceding, 0)
    y = used.withColumn("upto", F.sum("tokens").over(own)).join(F.broadcast(deal) if deal.count() <= BROADCAST_ROWS else deal, ["source", "use_no", "block"])
    place = (F.col("ahead") + F.col("upto") - F.col("tokens") / 2) / F.col("of_source")
    return y.select("source", "id", "use_no", "tokens", place.alias("place"), F.lit(a).alias("exponent"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: target_share, texts used, uses, tokens, share reached, the most times a text was used, and the plan's exponent (null if nothing was mixed)."""
    bounded(targets, MOST_TARGETS, "targets")
    per = mixed.groupBy("source", "id").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("tokens"), F.max("exponent").alias("exponent"))
    per = per.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("uses").alias("uses"), F.max("uses").alias("most_repeats"), F.sum("tokens").alias("tokens"), F.max("exponent").alias("exponent"))
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source IS NOT NULL")
    zero, every = F.lit(0).cast("bigint"), Window.partitionBy(F.lit(1))  # one row a target
    out = F.broadcast(t).join(per, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("texts", "uses", "most_repeats", "tokens")], "exponent")
    return out.withColumns({"share": F.col("tokens") / F.sum("tokens").over(every), "exponent": F.max("exponent").over(every)})


__all__ = ["BLOCK_ITEMS", "MOST_TARGETS", "Source", "entropy", "exponent_for_entropy", "mix", "mix_report", "plan", "tempered"]
