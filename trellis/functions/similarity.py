"""String and vector similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one machine word operation per 64 characters of a and character of b."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity, 0 to 100; two empty texts are the same."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def token_sort(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(token_sort(a), token_sort(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer, windows at the ends cut short included."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    n, best, inside = len(s), 0.0, set(s)
    for i in range(1 - n, len(t)):
        w = t[max(0, i) : i + n]
        if (i >= 0 and w[0] not in inside) or (i + n <= len(t) and w[-1] not in inside):
            continue  # a window that starts or ends outside the text cannot be the best
        best = max(best, ratio(s, w))
        if best == 100.0:
            break
    return best


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        out = []
        for p in zip(a, b):
            if p not in known:
                known[p] = None if p[0] is None or p[1] is None else f(*p)
            out.append(known[p])
        return pd.Series(out, dtype="float64")

    return run


ratio_udf, token_sort_ratio_udf, partial_ratio_udf = _pairwise(ratio), _pairwise(token_sort_ratio), _pairwise(partial_ratio)


@F.pandas_udf(T.StringType())
def token_sort_udf(s: pd.Series) -> pd.Series:
    return s.map(token_sort, na_action="ignore")


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that ratio can be, from the lengths: lossless as a filter before the similarity itself."""
    return 200.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a) + F.length(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in the JVM; null if either has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)
