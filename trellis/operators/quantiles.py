"""Per-key results that do not depend on how rows spread over keys.

Rows are first reduced to mergeable histograms (count, sum, min, max per key and bucket) with map-side
combination, so a key that holds a third of all rows travels as a few bucket rows per task. Quantiles come
from distributed exact selection: the bucket that holds the wanted rank is split again and again, until its
smallest and largest value agree. The values of a key are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.session import BROADCAST_ROWS, cut

#: Buckets that a value range is split into in each refinement round.
FANOUT = 256


def _first_bucket(v: Column) -> Column:
    """An order-preserving coarse bucket of a double: sign, binary exponent and four leading bits.

    Needs no knowledge of the range, so the first pass over the data already splits it; whole numbers
    below 32 get a bucket of their own. Rounding in log2 moves a value to the neighbouring bucket's edge,
    never across an order.
    """
    size = F.abs(v)
    e = F.floor(F.log2(size))
    return (
        F.when(v == 0, F.lit(0))
        .when(size == float("inf"), F.signum(v) * 100_000)
        .otherwise(F.signum(v) * (20_000 + e * 16 + F.floor((size / F.pow(F.lit(2.0), e) - 1) * 16)))
        .cast("int")
    )


def key_histogram(df: DataFrame, keys: Sequence[str], value: str | None) -> DataFrame:
    """Mergeable histogram: k0.. (the keys), bucket, rows, n (non-null values), total, lo, hi.

    Null keys form a group of their own. Null and NaN values are counted in rows only, under a null bucket.
    """
    ks = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    if value is None:
        v = F.lit(None).cast("double")
    else:
        v = F.col(f"`{value}`").cast("double")
        v = F.when(~F.isnan(v), v)
    x = df.select(*ks, v.alias("v"))
    return x.groupBy(*[f"k{i}" for i in range(len(keys))], _first_bucket(F.col("v")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("v").alias("n"),
        F.sum("v").alias("total"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )


def _choose(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of each group's buckets the one that holds rank; rank becomes the rank within it. At most FANOUT rows a group, or the doubles' exponents."""
    w = Window.partitionBy(*by).orderBy("bucket")
    x = hist.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(
        *by, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n", "lo", "hi"
    )


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, hist: DataFrame, probs: Sequence[float], heavy_rows: int = 1_000_000, both: bool = False) -> DataFrame:
    """Exact quantiles of value per key: columns k0.., prob, q (with both: also part).

    With both, the two order statistics around place (n-1)p are selected instead, as part 0 and 1.

    The quantile of p over n non-null values is the ceil(p*n)-th smallest (at least the first), so it is
    always a value that occurs; ties need no rule. Keys without a non-null value give no row. hist is the
    result of key_histogram over df or over a part of its keys: only those keys are refined.

    Each round joins the unresolved ranges back to the data. They go by broadcast when there are at most
    BROADCAST_ROWS of them (counted first); beyond that, the ranges of keys of at least heavy_rows rows, of
    which there can be only rows/heavy_rows, are broadcast, those keys' rows leave the shuffle, and the rest
    joins by a shuffle in which no key is large.
    """
    kn = [f"k{i}" for i in range(len(keys))]
    by = [*kn, "prob", *(["part"] if both else [])]
    per_key = hist.where(F.col("bucket").isNotNull())
    totals = Window.partitionBy(*kn)
    ranked = (
        per_key.withColumn("all", F.sum("n").over(totals))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    )
    if both:
        below = F.floor(F.round(F.col("prob") * (F.col("all") - 1), 9)).cast("bigint")
        ranked = ranked.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rank", F.least(below + 1 + F.col("part"), F.col("all")))
    else:
        ranked = ranked.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("prob") * F.col("all"), 6))).cast("bigint"))
    heavy = None
    state = cut(_choose(ranked, by))
    done: list[DataFrame] = []
    data = None
    while True:
        done.append(state.where("lo = hi").select(*by, F.col("lo").alias("q")))
        left = state.where("lo < hi")
        size = left.count()
        if not size:
            break
        if data is None:
            v = F.col(f"`{value}`").cast("double")
            data = df.select(*[F.col(f"`{k}`").alias(f"d{i}") for i, k in enumerate(keys)], v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
        same = reduce(lambda a, b: a & b, [F.col(f"d{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(keys))], F.lit(True))
        inside = same & F.col("v").between(F.col("lo"), F.col("hi"))
        if size <= BROADCAST_ROWS:
            met = data.join(F.broadcast(left), inside)
        else:
            if heavy is None:
                heavy = cut(per_key.groupBy(*kn).agg(F.sum("n").alias("held")).where(F.col("held") >= heavy_rows).drop("held"))
            of = reduce(lambda a, b: a & b, [F.col(f"d{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(keys))])
            hot, cold = left.join(F.broadcast(heavy), kn, "left_semi"), left.join(F.broadcast(heavy), kn, "left_anti")
            met = data.join(F.broadcast(hot), inside).unionByName(data.join(F.broadcast(heavy), of, "left_anti").join(cold.hint("merge"), inside))
        step = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        # a range wider than the largest double has an infinite width; its halves are finite
        step = F.when((F.col("hi") - F.col("lo")) == float("inf"), (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(step)
        bucket = F.when(F.col("v") >= F.col("hi"), FANOUT - 1).when(F.col("v") <= F.col("lo"), 0).otherwise(F.least(F.floor(step * FANOUT), F.lit(FANOUT - 1)))
        finer = met.groupBy(*by, "rank", bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        state = cut(_choose(finer, by))
    return reduce(DataFrame.unionByName, done)


def _partners(df: DataFrame, base: DataFrame, sides: Sequence[tuple[str, str | None]], restricted: bool) -> DataFrame:
    """k0 (side), k1 (key), partners: distinct non-null partners. Pairs are made distinct spread over both columns, so no key is hot; two columns
    that are each other's partners share one set of distinct pairs."""
    if restricted:
        pairs = base.where("partner IS NOT NULL").select(F.col("side").alias("k0"), F.col("key").alias("k1"), "partner").distinct()
        return pairs.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("partners"))
    out = None
    for x, y in dict.fromkeys(tuple(sorted(s)) for s in sides if s[1]):
        of = [k for k, p in sides if p and {k, p} == {x, y}]
        c = {n: F.col(f"`{n}`").cast("string") for n in (x, y)}
        pairs = df.select(c[x].alias("x"), c[y].alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()
        ends = pairs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k0"), F.col("x" if k == x else "y").alias("k1")) for k in of])).alias("e")).select("e.*")
        n = ends.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("partners"))
        out = n if out is None else out.unionByName(n)
    return out


def key_profile(
    df: DataFrame,
    sides: Sequence[tuple[str, str | None]],
    value: str | None = None,
    probs: Sequence[float] = (0.5,),
    min_share: float = 0.0,
) -> DataFrame:
    """Results per key of one or more columns of df, balanced whatever the keys hold.

    sides: (key column, partner column or None) pairs. Columns out: side (the key column's name), key_value,
    n_rows, n_values, value_sum, partners (distinct non-null partners) and q_<percent> for each of probs.
    Keys are compared exactly as stored; null keys give no row but count in the total that min_share (a share of all
    rows, 0 for every key) is taken of. Null and NaN values count in n_rows only. An empty table gives no
    rows. Other columns of df, of whatever name, do not matter.
    """
    picked = [F.struct(F.lit(k).alias("side"), F.col(f"`{k}`").cast("string").alias("key"), (F.col(f"`{p}`").cast("string") if p else F.lit(None).cast("string")).alias("partner")) for k, p in sides]
    v = (F.col(f"`{value}`").cast("double") if value else F.lit(None).cast("double")).alias("v")
    base = df.select(F.explode(F.array(*picked)).alias("x"), v).select("x.side", "x.key", "x.partner", "v").where("key IS NOT NULL")
    if min_share > 0:
        least = df.count() * min_share
        counts = base.groupBy("side", "key").agg(F.count(F.lit(1)).alias("held"))
        hot = cut(counts.where(F.col("held") >= least).select("side", "key"))  # at most 1/min_share keys a side
        base = base.join(F.broadcast(hot), ["side", "key"], "left_semi")
    hist = cut(key_histogram(base, ["side", "key"], "v"))
    out = hist.groupBy("k0", "k1").agg(F.sum("rows").alias("n_rows"), F.sum("n").alias("n_values"), F.sum("total").alias("value_sum"))
    if any(p for _, p in sides):
        out = out.join(_partners(df, base, sides, min_share > 0), ["k0", "k1"], "left")
    else:
        out = out.withColumn("partners", F.lit(None).cast("bigint"))
    if value and probs:
        q = select_ranks(base, ["side", "key"], "v", hist, probs)
        names = {p: f"q_{100 * p:g}".replace(".", "_") for p in probs}
        q = q.groupBy("k0", "k1").agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n) for p, n in names.items()])
        out = out.join(q, ["k0", "k1"], "left")
    return out.withColumn("partners", F.coalesce("partners", F.lit(0).cast("bigint"))).withColumnsRenamed({"k0": "side", "k1": "key_value"})


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles interpolated linearly between the two values around place (n-1)p: the keys, prob, n, q."""
    hist = cut(key_histogram(df, keys, value))
    kn = [f"k{i}" for i in range(len(keys))]
    n = hist.groupBy(*kn).agg(F.sum("n").alias("n"))
    q = select_ranks(df, keys, value, hist, probs, both=True).withColumnsRenamed({f"k{i}": f"r{i}" for i in range(len(keys))})
    q = q.groupBy(*[f"r{i}" for i in range(len(keys))], "prob").agg(F.max(F.when(F.col("part") == 0, F.col("q"))).alias("a"), F.max(F.when(F.col("part") == 1, F.col("q"))).alias("b"))
    on = reduce(lambda a, b: a & b, [F.col(f"k{i}").eqNullSafe(F.col(f"r{i}")) for i in range(len(keys))], F.lit(True))
    place = F.round(F.col("prob") * (F.col("n") - 1), 9)
    return n.join(q, on).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "prob", "n", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("q"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Columns: the keys under their own names, prob, n (non-null values of the key), q. See select_ranks."""
    hist = cut(key_histogram(df, keys, value))
    kn = [f"k{i}" for i in range(len(keys))]
    n = hist.groupBy(*kn).agg(F.sum("n").alias("n"))
    q = select_ranks(df, keys, value, hist, probs).withColumnsRenamed({f"k{i}": f"r{i}" for i in range(len(keys))})
    on = reduce(lambda a, b: a & b, [F.col(f"k{i}").eqNullSafe(F.col(f"r{i}")) for i in range(len(keys))])
    return n.join(q, on).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "prob", "n", "q")
