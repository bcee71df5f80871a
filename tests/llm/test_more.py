import random

import pytest
from pyspark.sql import functions as F

from trellis.llm import canonical as C
from trellis.llm import lookalike as L
from trellis.llm import mixing as X
from trellis.llm import packing as P
from trellis.llm import tokens as K


def test_further_lookalikes_are_a_parameter(spark, tmp_path):
    f = tmp_path / "confusables.txt"
    f.write_text("﻿# public form\n13AA ; 0041 ; MA # cherokee go to A\n03B1 ; 0061 ; MA # alpha keeps its shape\n0430 ; 0061 ; MA\n2FDF4 ; 0041 0042 ; MA\n\n", encoding="utf-8")
    more = L.confusables(str(f))
    assert more == {"Ꭺ": "A", "а": "a"}
    df = spark.createDataFrame([(1, "Ꭺb"), (2, "Ab"), (3, "αb")], "id long, t string")
    assert not L.same_looking(df, "id", "t").count()
    assert {tuple(r) for r in L.same_looking(df, "id", "t", more).collect()} == {(1, 2)}
    assert {r.id: r.t for r in L.normalised(df, "t", fold=False, others=more).collect()} == {1: "Ab", 2: "Ab", 3: "αb"}


def test_plain_repeats_are_not_paired(spark):
    """Two looks, each in many plain repeats: every pair between them, none within."""
    rows = [(i, "fine") for i in range(40)] + [(100 + i, "ﬁne") for i in range(30)] + [(200 + i, "other") for i in range(500)]
    got = {tuple(r) for r in L.same_looking(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == {(i, 100 + j) for i in range(40) for j in range(30)}


ITEMS = "id long, source string, tokens int, same binary"


def mixed(spark, rows, targets, **k):
    return X.mix(spark.createDataFrame(rows, ITEMS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **k).toPandas().sort_values("place")


def test_order_holds_the_weights_in_every_stretch(spark):
    rnd = random.Random(2)
    rows = [(i, "ab"[i % 4 == 0], rnd.randrange(1, 40), str(i).encode()) for i in range(4000)]
    got = mixed(spark, rows, [("a", 0.6, 1), ("b", 0.4, 3)], block_items=300)
    assert got.place.between(0, 1, inclusive="neither").all() and not got.duplicated(["source", "id", "use_no"]).any()
    for k in range(10):
        part = got.iloc[k * len(got) // 10 : (k + 1) * len(got) // 10]
        assert abs(part[part.source == "a"].tokens.sum() / part.tokens.sum() - 0.6) < 0.03
    b = got[got.source == "b"]
    first = b[b.use_no == 1]
    assert list(first.id) != sorted(first.id)  # permuted
    assert b.groupby("use_no").place.max().is_monotonic_increasing  # pass by pass


def test_exponent_found_by_bisection_when_a_limit_binds(spark):
    rows = [(i, "a" if i < 100 else "b", 10, str(i).encode()) for i in range(1000)]
    got = mixed(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)], budget=8000)
    a = got.exponent.iloc[0]
    assert 0 < a < 1 and (got.exponent == a).all()
    assert got[got.source == "a"].tokens.sum() == 1000 and abs(got.tokens.sum() - 8000) <= 20
    assert mixed(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)]).exponent.iloc[0] == 1.0


def test_lists_beyond_their_bound_are_errors(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_SPECS", 2)
    monkeypatch.setattr(X, "MOST_TARGETS", 2)
    monkeypatch.setattr(C, "MOST_WORDS", 2)
    specs = spark.createDataFrame([(i, 10 + i) for i in range(3)], "spec_id int, capacity int")
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 5)], "id long, tokens int"), specs)
    with pytest.raises(ValueError):
        mixed(spark, [(1, "a", 5, b"x")], [("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.4, 1)])
    ref = spark.createDataFrame([(i, "f", f"term{i} word{i}", None) for i in range(4)], "ref_id int, field_name string, term string, aliases array<string>")
    with pytest.raises(ValueError):
        C.map_to_list(spark.createDataFrame([(1, "f", 1, "x")], "row_id long, field_name string, item_no int, value string"), ref, 2)


def test_words_without_weight_are_left_out(spark):
    ref = spark.createDataFrame([(1, "f", "Upper Lobe of Lung", ["lobus superior"]), (2, "f", "Velorin", [])], "ref_id int, field_name string, term string, aliases array<string>")
    typed = ["hx of uper lobe of lung, probable", "velorin 40 mg daily", "vellorin q12h", "mg", "40", "left over words"]
    got = C.map_to_list(spark.createDataFrame([(i, "f", 1, v) for i, v in enumerate(typed)], "row_id long, field_name string, item_no int, value string"), ref)
    by = {r.row_id: (r.ref_id, r.how) for r in got.collect()}
    assert [by[i][0] for i in range(6)] == [1, 2, 2, 0, 0, 0] and by[1][1] == "stripped"


def test_one_value_of_a_third_of_all_rows(spark):
    ref = spark.createDataFrame([(1, "f", "Velorin", [])], "ref_id int, field_name string, term string, aliases array<string>")
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.lit("f").alias("field_name"), F.lit(1).alias("item_no"), F.when(F.col("id") % 3 == 0, "velorinn").otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("value"))
    assert C.map_to_list(df, ref).groupBy("ref_id").count().orderBy("ref_id").collect()[1]["count"] == 1000


def test_sizes_of_long_runs_are_whole():
    enc = K.encoder(open(K.VOCABULARY, "rb").read())
    for s in ("ab" * 120_000, "x" * 250_000 + " tail " + "y" * 130_000, "a  b\n" * 60_000, " " * 200_000, "word " * 60_000):
        assert "".join(K.pieces(s)) == s and K.count_tokens(enc, s) == len(enc.encode_ordinary(s))
