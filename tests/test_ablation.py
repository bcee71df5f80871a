import math
import random
import time
from collections import deque
from datetime import datetime

import pytest

from trellis.operators import ablation as A
from trellis.operators import kgfeatures as K
from trellis.operators import merge as M
from trellis.operators.survival import concordance


def brute(rows):
    c = u = n = 0
    for t, e, r in rows:
        for t2, e2, r2 in rows:
            if e and (t2 > t or (t2 == t and not e2)):
                n, c, u = n + 1, c + (r2 < r), u + (r2 == r)
    return c, u, n


@pytest.mark.parametrize("block", [5, 1000])
def test_concordance_by_group(spark, block):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice([1, 2]), float(rnd.randrange(12)), rnd.randrange(2), float(rnd.choice([0, 1, 1, 1, 5, 9]))) for _ in range(300)]
    got = {(r.g, r.f): (r.concordant, r.tied, r.comparable) for r in concordance(spark.createDataFrame(rows, "g string, f int, t double, e int, r double"), "t", "e", "r", block, ["g", "f"]).collect()}
    assert got == {(g, f): brute([x[2:] for x in rows if x[:2] == (g, f)]) for g in "ab" for f in (1, 2)}


def test_concordance_of_one_large_group_among_small_ones(spark):
    """Few rows a group on average, but one group of many; row by row it has 2 * 10^10 pairs."""
    n, began = 200_000, time.time()
    large = spark.range(n).selectExpr("0L AS g", "double(id) AS t", "1 AS e", "double(-(id DIV 2)) AS r")
    small = spark.range(1, 1001).selectExpr("CASE WHEN id > 1 THEN id END AS g", "explode(array(1.0D, 2.0D)) AS t", "1 AS e", "5.0D AS r")
    got = {r.g: (r.concordant, r.tied, r.comparable) for r in concordance(large.unionByName(small), "t", "e", "r", keys=["g"]).collect()}
    assert got[0] == (n * (n - 1) // 2 - n // 2, n // 2, n * (n - 1) // 2)
    assert len(got) == 1001 and all(v == (0, 1, 1) for k, v in got.items() if k != 0)  # the group of null too
    assert time.time() - began < 90


def test_splits_and_datasets(spark):
    assert A.infer_splits([100, 3], 5) == 3 and A.infer_splits([100, 50], 5) == 5 and A.infer_splits([2, 9], 5) == 2
    for bad in ([5], [5, 1]):
        with pytest.raises(ValueError):
            A.infer_splits(bad, 5)
    rows = [(i, "X" if i < 30 else "Y", "Stage IV" if i % 2 else None, i % 3 == 0, float(i + 1)) for i in range(40)]
    df = spark.createDataFrame([(i, c, s, int(e), t) for i, c, s, e, t in rows], "id long, cancer_type string, stage_group string, event int, time double")
    x = A.with_folds(A.datasets(df), "id")
    assert {r.dataset: r["count"] for r in x.groupBy("dataset").count().collect()} == {"all_cancers": 40, "X": 30}
    per = x.groupBy("dataset", "event", "fold").count().collect()
    for d in ("all_cancers", "X"):
        for e in (0, 1):
            n = [r["count"] for r in per if (r.dataset, r.event) == (d, e)]
            assert max(n) - min(n) <= 1


def test_hazards_of_the_other_folds(spark):
    rnd = random.Random(3)
    rows = [("d", i % 3, i, float(rnd.randrange(1, 50)), rnd.randrange(2), rnd.choice(["x", "y", None]), rnd.choice("pq")) for i in range(90)]
    df = spark.createDataFrame(rows, "dataset string, fold int, id long, time double, event int, a string, b string")
    got = {(r.key, r.model): r.risk for r in A.hazard_risks(df, {"clinical": ("a",), "treatment": (), "molecular": ("b",), "kg": ()}, "id").collect()}
    for _, f, i, _, _, a, b in rows:
        train = [r for r in rows if r[1] != f]
        rate = sum(r[4] for r in train) / sum(r[3] for r in train)

        def w(at, v):
            same = [r for r in train if r[at] == v]
            return math.log((sum(r[4] for r in same) + 1) / (sum(r[3] for r in same) + 1 / rate) / rate)

        assert abs(got[i, "clinical_only"] - w(5, a)) < 2e-6 and abs(got[i, "clinical_molecular"] - w(5, a) - w(6, b)) < 2e-6
        assert got[i, "clinical_kg"] == got[i, "clinical_only"]


def test_weights_of_more_values_than_may_be_broadcast(spark, monkeypatch):
    """Common values' weights are broadcast though there are too many values for one broadcast; only rows of rare values are shuffled, and every row has its weight."""
    rows = [("d", i % 3, i, float(i % 17 + 1), i % 2, "common" if i % 2 else f"rare{i}", "pq"[i % 4 < 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "dataset string, fold int, id long, time double, event int, a string, b string")
    groups = {"clinical": ("a",), "treatment": (), "molecular": ("b",), "kg": ()}
    whole = sorted(A.hazard_risks(df, groups, "id").collect())
    monkeypatch.setattr(A, "BROADCAST_ROWS", 10)
    monkeypatch.setattr("trellis.session.BROADCAST_ROWS", 10)
    split = A.hazard_risks(df, groups, "id")
    assert "LeftOuter, BuildRight" in split._jdf.queryExecution().executedPlan().toString()  # the common values
    assert sorted(split.collect()) == whole and len(whole) == 400 * len(A.MODELS)


def test_graph_features_against_plain_search(spark):
    edges = [("disease", "Lung Cancer", "gene/protein", "KRV1"), ("gene/protein", "krv1", "drug", "Velorin"), ("disease", "cancer", "disease", "lung cancer"), ("anatomy", "Lung", "disease", "lung cancer"), ("gene/protein", "ALONE", "gene/protein", "alone2"), ("disease", "", "drug", "x")]
    g = K.typed_graph(spark.createDataFrame(edges, "x_type string, x_name string, y_type string, y_name string"))
    said = [(1, "cancer", "LUNG CANCER"), (1, "cancer", "cancer"), (1, "site", "left lung"), (1, "treatment", "velorin"), (1, "gene", "KRV-1"), (1, "gene", "alone"), (2, "gene", "nope"), (3, "cancer", None)]
    m, ids = spark.createDataFrame(said, "id long, kind string, query string"), spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    got = {r.id: r.asDict() for r in K.kg_features(ids, m, g).collect()}
    adj = {}
    for a, b, c, d in edges[:5]:
        u, v = f"{a}|{b.lower()}", f"{c}|{d.lower()}"
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)

    def dist(a, b):
        seen, todo = {a: 0}, deque([a])
        while todo:
            x = todo.popleft()
            for y in adj.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen.get(b)

    nodes = {"cancer": ["disease|lung cancer", "disease|cancer"], "site": ["anatomy|lung"], "treatment": ["drug|velorin"], "gene": ["gene/protein|krv1", "gene/protein|alone"]}
    for name, ls, r in K.DISTANCES:
        d = [x for kind in ls for a in nodes[kind] for b in nodes[r] if (x := dist(a, b)) is not None]
        assert (got[1][f"kg_{name}_pairs"], got[1][f"kg_{name}_min_dist"]) == (len(d), min(d)) and math.isclose(got[1][f"kg_{name}_mean_dist"], sum(d) / len(d))
    assert [got[1][f"kg_num_{n}_nodes"] for n, _ in K.COUNTS] == [2, 1, 1, 2]
    assert set(got) == {1, 2, 3, 4} and got[4]["kg_num_gene_nodes"] == 0 and got[2]["kg_cancer_gene_min_dist"] == K.FAR
    diag = {r.id: r for r in K.mapping_diagnostics(ids, m, g).collect()}
    assert diag[1].kg_gene_mapping_rate == 1.0 and diag[2].kg_gene_mapping_rate == 0.0 and diag[3].kg_gene_mapping_rate is None and diag[3].kg_has_disease_mapping == 0
    one = K.diagnostics_summary(K.mapping_diagnostics(ids, m, g)).first()
    assert (one.n_patients, one.patients_with_unmapped_genes, one.gene_mapping_rate_nonempty) == (4, 1, 0.5)


def test_graph_features_in_blocks_without_joining_pairs(spark, monkeypatch):
    """Distances are looked up within a record's row, for a table of any size: no join of pairs with distances (whose common pairs would be one task's), however few rows may be broadcast."""
    rnd = random.Random(5)
    edges = [("disease", f"c{rnd.randrange(6)}", *rnd.choice([("drug", f"drug{rnd.randrange(9)}"), ("gene/protein", f"gene{rnd.randrange(9)}"), ("anatomy", f"site{rnd.randrange(3)}")])) for _ in range(25)]
    g = K.typed_graph(spark.createDataFrame(edges, "x_type string, x_name string, y_type string, y_name string"))
    said = [(i, *rnd.choice([("cancer", f"c{rnd.randrange(6)}"), ("site", f"site{rnd.randrange(3)}"), ("treatment", f"drug{rnd.randrange(9)}"), ("gene", f"gene{rnd.randrange(9)}")])) for i in range(60) for _ in range(8)]
    m = spark.createDataFrame(said, "id long, kind string, query string")
    monkeypatch.setattr("trellis.session.BROADCAST_ROWS", 0)
    whole = K.kg_features(m.select("id"), m, g)
    assert "hops" not in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(K, "PAIRS", 3)
    assert sorted(whole.collect()) == sorted(K.kg_features(m.select("id"), m, g, cells=100).collect())
    assert max(r.kg_disease_or_site_gene_pairs for r in whole.collect()) > 3


def test_merge_with_alignment(spark):
    base = spark.createDataFrame(
        [("indication", "indication", 5, "d5", "drug", "Velorin Therapy", "P", 9, "x9", "disease", "Lung Cancer", "P"), ("ppi", "ppi", 3, "g3", "gene/protein", "krv1", "P", 4, "g4", "gene/protein", "krv2", "P")],
        "relation string, display_relation string, x_index int, x_id string, x_type string, x_name string, x_source string, y_index int, y_id string, y_type string, y_name string, y_source string",
    )
    t = [
        (1, "velorin  therapy", "Treats", "Lung  cancr", ["u1"], 1, 1), (2, "Velorin Therapy", "Contraindicated For", "lung cancer", ["u2"], None, 2), (3, "zorin tablet", "Treats", "lung cancer", None, 2, 3),
        (4, "Zorin Tablet", "treats", "LUNG CANCER", ["u4"], 1, 4), (5, "low support", "Treats", "nobody", [], 0, 5), (6, None, "Treats", "x", [], 1, 6), (7, "krv1", "Frobs", "krv9 protein", ["a\"b"], 1, 7),
    ]
    new = spark.createDataFrame([(i, s, p, o, a, k, datetime(2024, 1, d)) for i, s, p, o, a, k, d in t], "id long, s string, p string, o string, origins array<string>, support long, loaded_at timestamp")
    rows, alignment = M.merge_full(base, new)
    how = {r.mention: (r.how, r["name"], r["index"]) for r in alignment.collect()}
    assert how["lung  cancr"] == ("fuzzy", "lung cancer", 9) and how["velorin therapy"][0] == "exact" and how["zorin tablet"] == ("new", "zorin tablet", 10)
    assert "low support" not in how
    got = [r.asDict() for r in rows.collect()]
    assert sum(r["status"] == "base" for r in got) == 2 and M.next_index(base) == 10
    added = {(r["x_name"], r["relation"], r["y_name"]): r for r in got if r["status"] != "base"}
    assert set(added) == {("velorin therapy", "contraindication", "lung cancer"), ("zorin tablet", "indication", "lung cancer"), ("krv1", "ext_frobs", "krv9 protein")}
    clash, fresh, odd = added["velorin therapy", "contraindication", "lung cancer"], added["zorin tablet", "indication", "lung cancer"], added["krv1", "ext_frobs", "krv9 protein"]
    assert (clash["status"], clash["x_source"], clash["x_index"], clash["_support"]) == ("conflict", "P|CONFLICT", 5, 1)
    assert (fresh["x_id"], fresh["x_source"], fresh["_support"], fresh["_origins"], fresh["_input_predicate"]) == ("zorin_tablet", "CUSTOM", 2, "[]", "Treats")
    assert (odd["y_index"], odd["display_relation"], odd["_origins"]) == (11, "frobs", '["a\\"b"]')
    assert M.next_index(base.where("false")) == 0
