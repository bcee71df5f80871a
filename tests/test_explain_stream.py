from datetime import datetime

from pyspark.sql import functions as F

from trellis.operators import explain as X
from trellis.operators.graph import two_hop_segments
from trellis.streaming import merge as S


def test_segments_score_what_lies_between(spark):
    e = spark.createDataFrame([("a", "p", "pathway"), ("p", "b", "drug"), ("a", "d", "disease"), ("d", "b", "drug"), ("a", "b", "drug")], "src string, dst string, dst_type string")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    new = spark.createDataFrame([("b", "p")], "u string, v string")
    got = two_hop_segments(e, pairs, new, ["pathway"], 6).orderBy("rank").collect()
    assert [(r.mid, r.n_new) for r in got] == [("p", 1), (None, 0), ("d", 0)]


def paths(spark):
    node = "struct<type:string,name:string>"
    rows = [
        ("a > g > d", "a", "g", "d", 1.0, ["a", "g", "d"], [("anatomy", "a"), ("gene/protein", "g"), ("drug", "d")]),
        ("a > p > g > d", "a", "g", "d", 2.0, ["a", "p", "g", "d"], [("anatomy", "a"), ("pathway", "p"), ("gene/protein", "g"), ("drug", "d")]),
        ("cancer > g > d", "cancer", "g", "d", 9.0, ["cancer", "g", "d"], [("disease", "cancer"), ("gene/protein", "g"), ("drug", "d")]),
    ]
    return spark.createDataFrame(rows, f"path_id string, anchor string, gene string, drug string, seg_score double, names array<string>, nodes array<{node}>")


def test_paths_are_scored_by_mode_and_chosen_apart(spark):
    edges = spark.createDataFrame(
        [("a", "g", True, False, [], 1, 1), ("d", "g", False, True, ["o"], 1, 1), ("a", "p", True, False, [], 1, 1), ("g", "p", True, False, [], 1, 1), ("cancer", "g", True, False, [], 1, 1)],
        "u string, v string, in_base boolean, in_new boolean, origins array<string>, u_degree long, v_degree long",
    )
    f = X.features(paths(spark), edges)
    got = {r.path_id: r for r in X.rank_paths(f).collect()}
    assert set(got) == {"a > g > d", "a > p > g > d"}  # a path from disease in general is never allowed
    long = got["a > p > g > d"]
    assert (long["mode"], long.n_new, long.n_pathway, long.novel, long.tier) == ("strict_pathway", 1, 1, 1, "mechanistic_novel")
    hub = 2.2 * 0.6931471805599453  # the gene at 1.2 and one node between
    assert abs(long.score - (30 + 10 + 14 + 4 - 3.2 * hub - 6 + 14 + 6 + 8 - 4)) < 1e-5
    many = spark.createDataFrame([("p", f"{g}{i}", g, [g, str(i)], 100.0 - i) for g in "xy" for i in range(4)], "patient string, path_id string, gene string, names array<string>, score double")
    chosen = [r.path_id for r in X.diverse(many, 4, 2).orderBy("diverse_rank").collect()]
    assert sorted(c[0] for c in chosen) == ["x", "x", "y", "y"] and chosen[0] == "x0"


def test_stream_merges_in_turn_and_again(spark, tmp_path):
    def batch(name, rows):
        df = spark.createDataFrame([(i, s, p, o, ["u"], 1, datetime(2024, 1, i)) for i, s, p, o in rows], S.TRIPLE)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.merge_stream(S.read_triples(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()

    batch("one", [(1, "x drug", "Treats", "y disease"), (2, "x drug", "Treats", "Y Disease")])
    batch("two", [(3, "x drug", "treats", "y disease"), (4, "x drug", "Contraindicated-For", "y disease"), (5, "z drug", "Treats", "y disease")])
    got = {(r.batch, r.x_name, r.relation): (r.status, r.statements) for r in S.state(spark, str(tmp_path / "state")).collect()}
    assert got == {(0, "x drug", "indication"): ("added", 2), (1, "x drug", "indication"): ("duplicate", 1), (1, "x drug", "contraindication"): ("conflict", 1), (1, "z drug", "indication"): ("added", 1)}
    again = spark.createDataFrame([(5, "z drug", "Treats", "y disease", ["u"], 1, datetime(2024, 1, 5))], S.TRIPLE)
    S.merge_batch(spark, again, 1, str(tmp_path / "state"))  # a repeated batch replaces its own folder only
    assert S.state(spark, str(tmp_path / "state")).where("batch = 1").count() == 1


def test_windows_of_a_table(spark):
    ev = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "a", 1.0), (datetime(2024, 1, 1, 0, 50), "a", 2.0), (datetime(2024, 1, 1, 1, 0), "a", 4.0)], "ts timestamp, event_type string, value double")
    assert [(r.n, r.total) for r in S.event_counts(ev).orderBy("start").select("n", F.col("total")).collect()] == [(2, 3.0), (1, 4.0)]
