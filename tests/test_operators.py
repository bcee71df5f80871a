import math
import random

import pytest
from pyspark.sql import functions as F

from trellis.functions import jsonx as J
from trellis.functions import similarity as S
from trellis.functions.text import clean_text, flexible_list, json_list, norm_predicate, slug
from trellis.operators import evidence as E
from trellis.operators import graph as G
from trellis.operators import kgstats as K
from trellis.operators import merge as M
from trellis.operators import survival as V


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, clean_text, "Aspirin 40 mg treats fever (Smith et al. 2004a) at 10:30 am, \\cite now!") == "aspirin treats fever smith 2004a at 10 now"  # the point after al and the colon keep year and hour
    assert one(spark, norm_predicate, " Associated_With  it") == "associated-with-it"
    assert one(spark, slug, "--A b/c--") == "a_b_c" and one(spark, slug, "??") == "unknown"
    assert one(spark, json_list, '["a", " ", " b "]') == ["a", "b"] and one(spark, json_list, "x") == [] and one(spark, json_list, None) == []
    assert one(spark, flexible_list, "['a', 'b']") == ["a", "b"] and one(spark, flexible_list, "a|b; c") == ["a", "b", "c"]


def test_similarity_against_plain_recursion():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(12))) for _ in "ab")
        assert S.lcs(a, b) == plain(a, b)
    assert S.token_sort_ratio("b a", "a b") == 100 and S.partial_ratio("art", "heart") == 100 and S.ratio("", "") == 100


def test_answers_are_read_as_far_as_they_go(spark):
    t = '{"s": "a", "p": "b", "o": ["c", "d"]}'
    assert J.as_triples(J.rescue_array(f"```json\n[{t}, {t[:9]}")) == [{"s": "a", "p": "b", "o": "c, d"}]
    assert J.rescue_array(f"prose {t} more")[0]["s"] == "a" and J.rescue_array("nothing") == [] and J.rescue_array(None) == []
    assert J.parse_scores('{"Relevancy": 4, "coverage": 3.5}') == {"relevancy": 4.0, "coverage": 3.5, "convincity": 0.0, "factuality": 0.0}
    log = spark.createDataFrame([('("entity"<|>"A"<|>"EVENT"<|>"d")##("relationship"<|>"A"<|>"B"<|>"d")',)], "value string")
    assert [tuple(r) for r in J.parse_graph_log(log).collect()] == [("A", "B", "d", "1")]


def test_backend_is_asked_once_per_prompt(spark):
    class Echo:  # local, so that workers get it by value
        def complete(self, prompts):
            return [p.upper() for p in prompts]

    got = J.answers(spark.createDataFrame([("a",), ("a",), (None,)], "prompt string"), "prompt", Echo()).collect()
    assert sorted((r.answer or "") for r in got) == ["", "A", "A"]


def test_relation_and_type_rules(spark):
    cases = [
        ("Treats", "drug", "disease", "indication", "indication"),
        ("causes", "drug", "disease", "drug_effect", "side effect"),
        ("associated with", "gene/protein", "disease", "disease_protein", "associated with"),
        ("part_of", "drug", "drug", "ext_part_of", "part of"),
        ("Foo Bar", "x", "y", "ext_foo_bar", "foo bar"),
    ]
    df = spark.createDataFrame(cases, "p string, x string, y string, r string, d string").select("r", "d", M.map_relation(F.col("p"), F.col("x"), F.col("y")).alias("m"))
    assert all((r.m.relation, r.m.display_relation) == (r.r, r.d) for r in df.collect())
    types = spark.createDataFrame([("Kinase", "x", "gene/protein"), ("signaling cascade", "x", "effect/phenotype"), ("widget", "w", "widget"), (None, "lung", "anatomy")], "raw string, name string, want string")
    assert all(r[0] == r[1] for r in types.select("want", M.map_type(F.col("raw"), F.col("name"))).collect())


def test_merge_is_idempotent(spark):
    t = [(1, "drug x", "Treats", "disease y", 1), (2, "drug x", "Contraindicated-For", "disease y", 1), (3, "Drug X ", "treats", "disease y", 2), (4, "a", "Treats", "b", 0)]
    e = M.typed_edges(spark.createDataFrame(t, "id long, s string, p string, o string, support long").withColumn("loaded_at", F.timestamp_seconds("id")))
    none = e.where("false")
    s = M.merge_stats(none, e).first()
    assert (s.total, s.added, s.duplicate, s.conflict, s.skipped) == (4, 2, 1, 1, 1)
    again = M.merge_stats(e, e).first()
    assert again.added == 0 and again.duplicate == 3
    ids = M.new_entities(none, e).orderBy("index").collect()
    assert [(r.name, r["index"]) for r in ids] == [("drug x", 0), ("disease y", 1)]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "r") for a, b in pairs], "src string, dst string, relation string")


def test_graph_against_brute_force(spark):
    rnd = random.Random(5)
    pairs = [(str(rnd.randrange(25)), str(rnd.randrange(25))) for _ in range(40)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in near:
        seen, front, h = {s: 0}, [s], 0
        while front:
            h += 1
            front = [y for x in front for y in near[x] if y not in seen and not seen.update({y: h})]
        want.update({(s, n): h for n, h in seen.items()})
    seeds = spark.createDataFrame([(s,) for s in near], "node string")
    got = {(r.source, r.node): r.hops for r in G.distances(edges(spark, pairs), seeds, max_hops=30).collect()}
    assert got == want
    with pytest.raises(ValueError):
        G.neighbours(edges(spark, pairs), seeds, "sideways")


def test_shortest_path_takes_the_smallest(spark):
    e = edges(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e")])
    p = G.shortest_paths(e, spark.createDataFrame([("a", "e"), ("e", "a")], "start string, end string")).collect()
    assert [(r.path, r.hops) for r in p] == [(["a", "b", "d", "e"], 3)]


def test_two_hop_paths_by_degrees(spark):
    rnd = random.Random(7)
    pairs = [(str(rnd.randrange(9)), str(rnd.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "x_id string, y_id string")
    assert K.two_hop_paths(df).first().paths == sum(b == c for _, b in pairs for c, _ in pairs)


def test_concordance_against_all_pairs(spark):
    rnd = random.Random(11)
    rows = [(float(rnd.randrange(30)), rnd.randrange(2), float(rnd.randrange(12))) for _ in range(400)]
    c = u = n = 0
    for t, e, r in rows:
        for t2, e2, r2 in rows:
            if e and (t2 > t or (t2 == t and not e2)):
                n, c, u = n + 1, c + (r2 < r), u + (r2 == r)
    df = spark.createDataFrame(rows, "t double, e int, r double")
    for block in (20, 10_000):
        got = V.concordance(df, "t", "e", "r", block).first()
        assert (got.concordant, got.tied, got.comparable) == (c, u, n)


def test_survival_statistics(spark):
    assert math.isclose(V._chi2_tail(3.841458820694124, 1), 0.05, abs_tol=1e-9) and math.isclose(V._t_tail(2.7764451051977987, 4), 0.05, abs_tol=1e-6)
    km = V.kaplan_meier(spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 0), ("g", 3.0, 1)], "g string, t double, e int"), ["g"], "t", "e").orderBy("time").collect()
    assert [round(r.survival, 6) for r in km] == [round(2 / 3, 6), round(2 / 3, 6), 0.0]
    same = spark.createDataFrame([("a", float(i), 1) for i in range(5)] + [("b", float(i), 1) for i in range(5)], "g string, t double, e int")
    assert V.log_rank(same, "g", "t", "e")[2] == pytest.approx(1.0)


def test_documents_and_evidence(spark):
    lines = spark.createDataFrame([("p1|||T|||Text one",), ("p2|||Text two",), ("one part",), ("  ",)], "value string")
    assert [tuple(r) for r in E.document_lines(lines).orderBy("origin").collect()] == [("p1", "T", "Text one"), ("p2", None, "Text two")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a cat", "scatter", "Cat, sat", "cat", "the cat", None])], "id long, t string")
    got = E.evidence(spark.createDataFrame([("cat",), ("dog",)], "concept string"), docs, "id", "t", 3)
    assert sorted((r.concept, r.doc) for r in got.collect()) == [("cat", 0), ("cat", 2), ("cat", 3)]
