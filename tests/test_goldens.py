"""Published figures, transcribed, that the operators must give from the published tables below them."""

import math

import pytest

from trellis.operators import answers as A
from trellis.operators import kgstats as K
from trellis.operators import survival as V

# c_index of five folds and six models
FOLDS = [
    (1, "clinical_only", 0.7126391863448074),
    (1, "clinical_kg", 0.7289064808038501),
    (1, "clinical_molecular", 0.7301624434026894),
    (1, "clinical_molecular_kg", 0.735231493715582),
    (1, "clinical_treatment_molecular", 0.7576995367362684),
    (1, "clinical_treatment_molecular_kg", 0.7527296711953961),
    (2, "clinical_only", 0.7241708360286702),
    (2, "clinical_kg", 0.739278980707314),
    (2, "clinical_molecular", 0.7384032057640524),
    (2, "clinical_molecular_kg", 0.7422373238198745),
    (2, "clinical_treatment_molecular", 0.7636505381773712),
    (2, "clinical_treatment_molecular_kg", 0.7589635912466698),
    (3, "clinical_only", 0.7210902315466172),
    (3, "clinical_kg", 0.7396814019630646),
    (3, "clinical_molecular", 0.7403513096829596),
    (3, "clinical_molecular_kg", 0.7450545937504265),
    (3, "clinical_treatment_molecular", 0.76510750253027),
    (3, "clinical_treatment_molecular_kg", 0.7620808873118409),
    (4, "clinical_only", 0.7252825434804281),
    (4, "clinical_kg", 0.739987634474383),
    (4, "clinical_molecular", 0.7428301334774373),
    (4, "clinical_molecular_kg", 0.7445966674823495),
    (4, "clinical_treatment_molecular", 0.763197635426013),
    (4, "clinical_treatment_molecular_kg", 0.7583429770838431),
    (5, "clinical_only", 0.7209756964062165),
    (5, "clinical_kg", 0.7410394696578783),
    (5, "clinical_molecular", 0.7411589706083964),
    (5, "clinical_molecular_kg", 0.7474353744771306),
    (5, "clinical_treatment_molecular", 0.7700601840004977),
    (5, "clinical_treatment_molecular_kg", 0.7648134025735072),
]
# model, mean, sample deviation, best first
SUMMARY = [
    ("clinical_treatment_molecular", 0.7639430793740841, 0.004427130616970346),
    ("clinical_treatment_molecular_kg", 0.7593861058822514, 0.0045357511884993795),
    ("clinical_molecular_kg", 0.7429110906490727, 0.004672662243417125),
    ("clinical_molecular", 0.7385812125871071, 0.004968369196398988),
    ("clinical_kg", 0.737778793521298, 0.005002484399167243),
    ("clinical_only", 0.7208316987613479, 0.004953904788682879),
]
# type pair, triples from text, triples of the base
PAIRS = [
    ("effect/phenotype", "exposure", 2368, 0),
    ("biological_process", "effect/phenotype", 1521, 0),
    ("anatomy", "effect/phenotype", 1216, 0),
    ("anatomy", "disease", 1016, 0),
    ("anatomy", "biological_process", 863, 0),
    ("anatomy", "exposure", 820, 0),
    ("biological_process", "disease", 788, 0),
    ("biological_process", "drug", 666, 0),
    ("anatomy", "cellular_component", 527, 0),
    ("biological_process", "cellular_component", 514, 0),
    ("drug", "exposure", 365, 0),
    ("biological_process", "pathway", 257, 0),
    ("biological_process", "molecular_function", 236, 0),
    ("anatomy", "drug", 206, 0),
    ("cellular_component", "effect/phenotype", 167, 0),
    ("cellular_component", "disease", 162, 0),
    ("cellular_component", "drug", 113, 0),
    ("drug", "molecular_function", 108, 0),
    ("disease", "pathway", 107, 0),
    ("drug", "pathway", 94, 0),
    ("cellular_component", "molecular_function", 92, 0),
    ("effect/phenotype", "pathway", 87, 0),
    ("exposure", "pathway", 73, 0),
    ("effect/phenotype", "molecular_function", 72, 0),
    ("disease", "molecular_function", 66, 0),
    ("cellular_component", "pathway", 64, 0),
    ("anatomy", "pathway", 52, 0),
    ("anatomy", "molecular_function", 43, 0),
    ("disease", "procedure", 22, 0),
    ("anatomy", "procedure", 21, 0),
    ("molecular_function", "pathway", 18, 0),
    ("effect/phenotype", "procedure", 10, 0),
    ("biological_process", "procedure", 9, 0),
    ("drug", "procedure", 6, 0),
    ("exposure", "procedure", 3, 0),
    ("cellular_component", "exposure", 107, 20),
    ("exposure", "molecular_function", 45, 90),
    ("exposure", "gene/protein", 203, 2424),
    ("biological_process", "exposure", 1521, 3250),
    ("exposure", "exposure", 1976, 4140),
    ("disease", "exposure", 1371, 4608),
    ("pathway", "pathway", 22, 5070),
    ("effect/phenotype", "gene/protein", 748, 6660),
    ("cellular_component", "cellular_component", 439, 9690),
    ("molecular_function", "molecular_function", 75, 27148),
    ("anatomy", "anatomy", 1901, 28064),
    ("effect/phenotype", "effect/phenotype", 2670, 37472),
    ("drug", "gene/protein", 333, 51306),
    ("disease", "disease", 1287, 64388),
    ("disease", "drug", 994, 85262),
    ("gene/protein", "pathway", 228, 85292),
    ("biological_process", "biological_process", 1936, 105772),
    ("drug", "effect/phenotype", 1008, 129568),
    ("gene/protein", "molecular_function", 233, 139060),
    ("disease", "gene/protein", 721, 160822),
    ("cellular_component", "gene/protein", 867, 166804),
    ("biological_process", "gene/protein", 1239, 289610),
    ("disease", "effect/phenotype", 2606, 303020),
    ("gene/protein", "gene/protein", 764, 642150),
    ("drug", "drug", 275, 2672628),
    ("anatomy", "gene/protein", 425, 3076180),
]
# of these the pairs that the base has not: rank, type pair, log10(count + 1)
NEW = [
    (1, "effect/phenotype", "exposure", 3.374565060722765),
    (2, "biological_process", "effect/phenotype", 3.182414652434554),
    (3, "anatomy", "effect/phenotype", 3.0852905782300653),
    (4, "anatomy", "disease", 3.0073209529227447),
    (5, "anatomy", "biological_process", 2.936513742478893),
    (6, "anatomy", "exposure", 2.9143431571194407),
    (7, "biological_process", "disease", 2.89707700320942),
    (8, "biological_process", "drug", 2.824125833916549),
    (9, "anatomy", "cellular_component", 2.722633922533812),
    (10, "biological_process", "cellular_component", 2.711807229041191),
    (11, "drug", "exposure", 2.5634810853944106),
    (12, "biological_process", "pathway", 2.41161970596323),
    (13, "biological_process", "molecular_function", 2.374748346010104),
    (14, "anatomy", "drug", 2.315970345456918),
    (15, "cellular_component", "effect/phenotype", 2.225309281725863),
    (16, "cellular_component", "disease", 2.2121876044039577),
    (17, "cellular_component", "drug", 2.0569048513364727),
    (18, "drug", "molecular_function", 2.037426497940624),
    (19, "disease", "pathway", 2.03342375548695),
    (20, "drug", "pathway", 1.9777236052888478),
    (21, "cellular_component", "molecular_function", 1.9684829485539352),
    (22, "effect/phenotype", "pathway", 1.9444826721501687),
    (23, "exposure", "pathway", 1.8692317197309762),
    (24, "effect/phenotype", "molecular_function", 1.863322860120456),
    (25, "disease", "molecular_function", 1.8260748027008264),
    (26, "cellular_component", "pathway", 1.8129133566428557),
    (27, "anatomy", "pathway", 1.7242758696007892),
    (28, "anatomy", "molecular_function", 1.6434526764861874),
    (29, "disease", "procedure", 1.3617278360175928),
    (30, "anatomy", "procedure", 1.3424226808222062),
    (31, "molecular_function", "pathway", 1.2787536009528289),
    (32, "effect/phenotype", "procedure", 1.0413926851582251),
    (33, "biological_process", "procedure", 1.0),
    (34, "drug", "procedure", 0.8450980400142568),
    (35, "exposure", "procedure", 0.6020599913279624),
]
# type, nodes of the merged graph, of them in the base, added, share added
NOVELTY = [
    ("biological_process", 30851, 28642, 2209, 0.0716022171080354),
    ("gene/protein", 28513, 27610, 903, 0.03166976466874759),
    ("disease", 18064, 17080, 984, 0.05447298494242692),
    ("effect/phenotype", 17841, 15311, 2530, 0.14180819460792557),
    ("anatomy", 15665, 14033, 1632, 0.1041812958825407),
    ("molecular_function", 11306, 11169, 137, 0.012117459755881833),
    ("drug", 8701, 7957, 744, 0.08550741294104126),
    ("cellular_component", 4679, 4176, 503, 0.10750160290660397),
    ("exposure", 3696, 818, 2878, 0.7786796536796536),
    ("pathway", 2573, 2516, 57, 0.022153128643606686),
    ("procedure", 16, 0, 16, 1.0),
]


def test_ablation_summary(spark):
    got = V.summary(spark.createDataFrame(FOLDS, "fold int, model string, c_index double"), ["model"], ["c_index"]).orderBy("c_index_mean", ascending=False).collect()
    assert [r.model for r in got] == [m for m, _, _ in SUMMARY]
    for r, (_, mean, sd) in zip(got, SUMMARY):
        assert math.isclose(r.c_index_mean, mean, rel_tol=1e-12) and math.isclose(r.c_index_std, sd, rel_tol=1e-9)


def edges(spark, counts):
    rows = spark.createDataFrame(counts, "x_type string, y_type string, n long")
    return rows.selectExpr("x_type", "y_type", "explode(sequence(1L, n)) AS i").drop("i")


def test_new_type_pairs(spark):
    """From the published counts, rows made as many as counted, to the published ranks: 61 pairs of which 35 are new."""
    text = edges(spark, [(x, y, n) for x, y, n, _ in PAIRS])
    base = edges(spark, [(x, y, 1) for x, y, _, b in PAIRS if b])
    got = K.new_type_pair_links(base, text).orderBy("rank").collect()
    assert len(PAIRS) == 61 and len(got) == len(NEW) == 35
    sizes = {(x, y): n for x, y, n, _ in PAIRS}
    assert [r.edges for r in got] == [sizes[x, y] for _, x, y, _ in NEW]  # equal counts may change places
    assert {(r.x_type, r.y_type) for r in got} == {(x, y) for _, x, y, _ in NEW}
    logs = {(x, y): v for _, x, y, v in NEW}
    assert all(math.isclose(r.log_edges, logs[r.x_type, r.y_type], rel_tol=1e-12) for r in got)


@pytest.mark.parametrize("row", NOVELTY, ids=[r[0] for r in NOVELTY])
def test_entity_novelty_adds_up(row):
    _, merged, old, added, share = row
    assert old + added == merged and math.isclose(added / merged, share, rel_tol=1e-12)


def test_entity_novelty_of_a_scaled_graph(spark):
    """The published counts per type, a hundredth each, as edges of a base and a merged graph."""
    base, merged, want = [], [], {}
    for kind, total, _, added, _ in NOVELTY:
        n, a = max(1, total // 100), min(max(1, total // 100), added // 100)
        want[kind] = (n, n - a, a)
        merged += [(f"{kind}{i}", kind, f"{kind}{i}", kind) for i in range(n)]
        base += [(f"{kind}{i}", kind, f"{kind}{i}", kind) for i in range(n - a)]
    schema = "x_id string, x_type string, y_id string, y_type string"
    got = K.entity_novelty(spark.createDataFrame(base, schema), spark.createDataFrame(merged, schema)).collect()
    assert {r.node_type: (r.merged_nodes, r.base_existing, r.text_added) for r in got} == want


def test_shannon_entropy_in_nats(spark):
    """Even shares give the logarithm of their number; the published entropies 1.655931 and 1.677025 lie below those of 18 and 37 relations."""
    even = K.entropy(spark.createDataFrame([(f"r{i}", 7) for i in range(18)], "r string, edges long"), "edges").first()[0]
    assert math.isclose(even, math.log(18), rel_tol=1e-12) and 1.655931 < even
    one = K.entropy(spark.createDataFrame([("a", 3), ("b", 1)], "r string, edges long"), "edges").first()[0]
    assert math.isclose(one, -(0.75 * math.log(0.75) + 0.25 * math.log(0.25)), rel_tol=1e-12)


def test_substring_resolution(spark):
    """A gene that the graph has under a shorter name is found by it."""
    from trellis.operators import kgfeatures as G

    g = spark.createDataFrame([("gene/protein|ist1", "drug|d"), ("gene/protein|alb", "drug|d")], "src string, dst string")
    q = spark.createDataFrame([("gene/protein", "HIST1H1C"), ("gene/protein", "ALB"), ("gene/protein", "  "), ("drug", "HIST1H1C")], "type string, query string")
    assert {(r.type, r.query, r.node) for r in G.resolve_typed(q, g).collect()} == {("gene/protein", "HIST1H1C", "gene/protein|ist1"), ("gene/protein", "ALB", "gene/protein|alb")}


def test_mention_equality_and_containment(spark):
    rows = [("Congestive Heart Failure", "congestive heart failure", True, True), ("It is congestive heart failure.", "Congestive Heart Failure", False, True), ("Heart", "Congestive Heart Failure", False, False), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "answer string, target string, same boolean, named boolean")
    got = df.select(A.same_answer(df.answer, df.target).alias("a"), A.names_target(df.answer, df.target).alias("b"), "same", "named").collect()
    assert all((r.a, r.b) == (r.same, r.named) for r in got)
