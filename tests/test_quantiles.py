import math
import random

import numpy as np

from trellis.operators import quantiles as Q
from trellis.operators.ranking import global_index

SCHEMA = "k string, v double, p string, bucket int, rows long"


def data(n=3000):
    rnd = random.Random(1)
    out = []
    for _ in range(n):
        k = rnd.choice(["hot"] * 5 + ["a", "b", None, "", "x" * 10_000])
        v = rnd.choice([None, float("nan"), rnd.random() * 10 ** rnd.randrange(-5, 6), -rnd.random(), float(rnd.randrange(5)), 0.0])
        out.append((k, v, rnd.choice(["p", "q", None, str(rnd.randrange(30))]), 1, 2))
    return out + [("inf", float("inf"), "p", 0, 0), ("inf", float("-inf"), "p", 0, 0), ("inf", 1e308, "p", 0, 0), ("inf", -1e308, "p", 0, 0)]


def groups(rows):
    by = {}
    for k, v, *_ in rows:
        by.setdefault(k, []).append(v)
    return {k: sorted(v for v in vs if v is not None and not math.isnan(v)) for k, vs in by.items()}


def test_exact_quantiles_against_sorting(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (200_000, 2):  # by broadcast, and by the shuffle beyond its limit
        monkeypatch.setattr(Q, "BROADCAST_ROWS", limit)
        got = {(r.k, r.prob): r.q for r in Q.exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
        want = {(k, p): vs[max(1, math.ceil(round(p * len(vs), 6))) - 1] for k, vs in groups(rows).items() if vs for p in (0.0, 0.1, 0.5, 0.99, 1.0)}
        assert got == want


def test_linear_quantiles_against_numpy(spark):
    rows = [r for r in data() if r[0] != "inf"]
    got = {(r.k, r.prob): r.q for r in Q.linear_quantiles(spark.createDataFrame(rows, SCHEMA), ["k"], "v", [0.25, 0.5, 0.9]).collect()}
    for k, vs in groups(rows).items():
        for p in (0.25, 0.5, 0.9):
            assert math.isclose(got[k, p], np.quantile(vs, p), rel_tol=1e-9, abs_tol=1e-12)


def test_profile_counts_every_row(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.side, r.key_value): r for r in Q.key_profile(df, [("k", "p"), ("p", "k")], "v", (0.5,)).collect()}
    for k in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == k]
        assert got["k", k].n_rows == len(mine) and got["k", k].partners == len({r[2] for r in mine} - {None})
    assert ("k", None) not in got
    hot = Q.key_profile(df, [("k", None)], "v", (0.5,), min_share=0.2).collect()
    assert [r.key_value for r in hot] == ["hot"] and hot[0].q_50 == got["k", "hot"].q_50


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not Q.key_profile(empty, [("k", "p")], "v").count() and not Q.key_profile(empty, [("k", None)], "v", min_share=0.01).count()
    assert not Q.exact_quantiles(spark.createDataFrame([("a", None, None, 1, 1)], SCHEMA), ["k"], "v", [0.5]).count()


def test_global_index(spark):
    got = global_index(spark.createDataFrame([(c,) for c in "hgfedcba"], "c string"), ["c"], "i", 5).collect()
    assert sorted((r.i, r.c) for r in got) == list(zip(range(5, 13), "abcdefgh"))
    assert not global_index(spark.createDataFrame([], "c string"), ["c"], "i").count()
