import random
from datetime import datetime, timedelta

from trellis.operators.orphans import Reference, orphan_report, orphans

DAY = datetime(2024, 1, 1)
REFS, TARGETS = "row_id long, k string, loaded_at timestamp, key string, at timestamp", "id string, loaded_at timestamp, deleted_at timestamp, spans string"


def day(n):
    return None if n is None else DAY + timedelta(days=n)


def run(spark, refs, targets, heavy):
    r = spark.createDataFrame([(i, k, day(t), None, None) for i, k, t in refs], REFS)
    t = spark.createDataFrame([(k, day(a), day(b), None) for k, a, b in targets], TARGETS)
    return orphans([Reference("x", r, "row_id", "k", "loaded_at", t, "id", "loaded_at", "deleted_at")], heavy)


def brute(refs, targets):
    out = set()
    for i, k, t in refs:
        k = (k or "").strip(" \t")
        if not k:
            continue
        spans = [(a, b) for x, a, b in targets if (x or "").strip(" \t") == k]
        if not spans:
            out.add((i, "missing"))
        elif t is not None and not any(a is not None and a <= t and (b is None or t < b) for a, b in spans):
            out.add((i, "deleted" if any(a is not None and a <= t for a, _ in spans) else "late"))
    return out


def test_against_brute_force_with_and_without_heavy_keys(spark):
    rnd = random.Random(3)
    keys = ["a", " a", "a\t", "b", "c", "d", "", " ", None, "hot", "gone", "z" * 50_000]
    refs = [(i, rnd.choice([*keys, *["hot"] * 8]), rnd.choice([None, *range(20)])) for i in range(400)]
    targets = [(k, a, b) for k in ["a", "a ", "b", "c", "hot", "hot", None, ""] for a, b in [(rnd.randrange(20), rnd.choice([None, rnd.randrange(20)]))]] + [("d", None, None)]
    for heavy in (10**9, 50):
        assert {(r.row_id, r.kind) for r in run(spark, refs, targets, heavy).collect()} == brute(refs, targets)


def test_bounds_of_presence(spark):
    refs = [(1, "k", 4), (2, "k", 5), (3, "k", 9), (4, "k", 10)]
    got = {r.row_id: r.kind for r in run(spark, refs, [("k", 5, 10)], 100).collect()}
    assert got == {1: "late", 4: "deleted"}


def test_empty_tables_and_report(spark):
    assert not run(spark, [], [("k", 1, None)], 10).count()
    found = run(spark, [(1, "k", 1), (2, "k", 40), (3, "j", 41)], [], 2)
    assert sorted(map(tuple, orphan_report(found).collect())) == [("x", "2024-01", "missing", 1), ("x", "2024-02", "missing", 2)]


def test_heavy_threshold_bounds_what_is_broadcast():
    from trellis.operators.orphans import heavy_threshold
    from trellis.session import BROADCAST_ROWS

    for keys, rows in ((10, 100), (1000, 10**6), (10**6, 10**12), (1, 0)):
        t = heavy_threshold(keys, rows)
        assert rows // t <= BROADCAST_ROWS and t >= 2


def test_heavy_branch_runs_on_skewed_data_with_the_default(spark, monkeypatch):
    """At the query's own setting: a key far above the mean is found heavy from the data and goes the broadcast way."""
    from trellis.operators import orphans as O

    rnd = random.Random(5)
    refs = [(i, "hot" if i % 3 == 0 else f"k{rnd.randrange(600)}", rnd.randrange(300)) for i in range(3000)]
    targets = [("hot", 50, 200)] + [(f"k{i}", rnd.randrange(200), rnd.choice([None, rnd.randrange(200, 300)])) for i in range(0, 600, 2)]
    size = O.heavy_threshold(len({k for _, k, _ in refs}), len(refs))
    assert [k for k in {k for _, k, _ in refs} if sum(x[1] == k for x in refs) >= size] == ["hot"]
    r = spark.createDataFrame([(i, k, day(t), None, None) for i, k, t in refs], REFS)
    t = spark.createDataFrame([(k, day(a), day(b), None) for k, a, b in targets], TARGETS)
    ref = [O.Reference("x", r, "row_id", "k", "loaded_at", t, "id", "loaded_at", "deleted_at")]
    groups, _, _ = O._unsettled(ref[0], None)
    assert "hot" in {g.key for g in groups.collect()}  # its months outside the target row
    found = O.orphans(ref).collect()
    assert {(x.row_id, x.kind) for x in found} == brute([(i, k, day(n)) for i, k, n in refs], [(k, day(a), day(b)) for k, a, b in targets])
    counts = {(c.period, c.kind): c.orphans for c in O.orphan_counts(ref).collect()}
    assert counts == {(c.period, c.kind): c.orphans for c in orphan_report(O.orphans(ref)).collect()}
