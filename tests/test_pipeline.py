import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.functions import jsonx as J
from trellis.functions.text import clean_text, singularize, tokens, words
from trellis.operators import answers as A
from trellis.operators import pipeline as P
from trellis.operators.retrieval import align, chunks

CLEANED = [
    (r"\usepackage{amsmath}Dose 40 mg of Aspirin", "dose of aspirin"),
    ("seen by Smith et al 2004a and Jones et al", "seen by and jones"),
    ("at 8 am and 10 30 PM fever", "at and fever"),
    ("7 am blood sample", "blood sample"),
    ("5ml and 10 mcg, 3 IU / day", "and / day"),
    (r"\alpha IL-6 \cite{x}", "il-6 x"),
    ("Straße, naïve", "stra e na ve"),
    ("a  b\tc", "a b c"),
    ("", ""),
]


@pytest.mark.parametrize("text,want", CLEANED)
def test_cleaning(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(clean_text(F.col("t"))).first()[0] == want


def test_words_of_every_script(spark):
    row = spark.createDataFrame([("Лёгкое, cœur d’été 12mǵ — naïve x",)], "t string").select(words(F.col("t")), tokens(F.col("t"))).first()
    assert row[0] == ["лёгкое", "cœur", "d", "été", "12mǵ", "naïve", "x"] and len(row[1]) == 7


def test_singular(spark):
    df = spark.createDataFrame([("lung metastases and biopsies of masses",), ("diabetes mellitus status",), ("mice  genes boxes",), (None,)], "t string")
    assert [r[0] for r in df.select(singularize(F.col("t"))).collect()] == ["lung metastasis and biopsy of mass", "diabete mellitus status", "mouse gene box", ""]


def relations(spark):
    return spark.createDataFrame([("Associated-With", "goes with"), ("Treats", "is given for")], "relation string, description string")


def test_evidence_to_triples_to_fused(spark):
    ev = spark.createDataFrame([("b", ["text two", "x" * 20_000], ["o2", "o1"]), ("a", ["text"], ["o3"])], "concept string, abstracts array<string>, origins array<string>")
    got = P.extract_triples(ev, relations(spark), P.Stub()).orderBy("id").collect()
    assert [(r.id, r.s, r.p, r.o, r.concept, r.origins) for r in got] == [(0, "a", "Associated-With", "finding", "a", ["o3"]), (1, "b", "Associated-With", "finding", "b", ["o2", "o1"])]
    prompt = ev.select(P.triple_prompt(F.col("concept"), F.col("abstracts"), P.definitions(relations(spark)), 100).alias("p")).first().p
    assert prompt.startswith("Concept: b\n") and "Treats: is given for" in prompt and prompt.endswith("text two " + "x" * 91)
    raw = spark.createDataFrame([("a", "Associated-With", "finding", ["u2"]), ("a", "Associated-With", "finding", ["u1", None]), ("c", "Treats", "a", None), (None, "Treats", "a", ["u"])], "s string, p string, o string, origins array<string>")
    plain = [tuple(r) for r in P.fuse(raw, relations(spark)).orderBy("id").collect()]
    assert plain == [(0, "a", "Associated-With", "finding", ["u1", "u2"], 2), (1, "c", "Treats", "a", [], 1)]
    known = spark.createDataFrame([("a", "z")], "head string, tail string")
    model = [tuple(r) for r in P.fuse(raw, relations(spark), P.Stub(), evidence_of=ev, known=known).orderBy("id").collect()]
    assert model == [(0, "a", "Associated-With", "finding", ["u1", "u2"], 1), (1, "c", "Associated-With", "finding", [], 1), (2, "finding", "Associated-With", "finding", [], 1)]
    assert not P.extract_triples(ev.where("false"), relations(spark), P.Stub()).count()


def test_a_failing_backend_is_reported(spark):
    class Down:
        def complete(self, prompts):
            raise TimeoutError("no answer")

    got = J.answers(spark.createDataFrame([("a",), (None,)], "prompt string"), "prompt", Down(), retries=2, delay=0.01).collect()
    assert [r.answer for r in got] == [None, None] and all(r.answer_error == "TimeoutError: no answer" for r in got)


def test_parse_error_triple_and_table_function(spark):
    assert J.strict_triples('```json\n[{"s": "a", "p": "b", "o": ["c", "d"]}]\n```') == [{"s": "a", "p": "b", "o": "c, d"}]
    assert J.strict_triples("no list") == J.strict_triples(None) == J.strict_triples("[{broken}]") == [{"s": "None", "p": "None", "o": "ParseError"}]
    spark.udtf.register("rescue_triples", J.RescueTriples)
    got = spark.sql("""SELECT * FROM rescue_triples('[{"s": "a", "p": "b", "o": "c"}, {"s": "cut')""").collect()
    assert [tuple(r) for r in got] == [("a", "b", "c")]


def test_seed_variants(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"the lung lesions grew in patient number{i} with lung lesions") for i in range(8)] + [(9, "a", "short")], "id long, cls string, text string")
    onto = spark.createDataFrame([("Lung lesions",), ("lung lesion",)], "term string")
    for v in P.VARIANTS:
        got = {r.concept: r.score for r in P.seed_concepts(docs, "id", "cls", "text", onto, v).collect()}
        assert got and all(len(c) >= 3 for c in got)
        if v.rule == "members":
            assert set(got) == {"lung lesion"}
        if v.rule == "weighted":
            assert max(got, key=got.get) == "lung lesion"  # lifted, in the singular, and by half again
        if v.rule == "heavy":
            assert all(" " in c for c in got)


def test_semantic_hits_against_plain_search(spark):
    stub = P.Stub()
    rows = [(1, "lung cancer --[causes]--> chest pain", ["chest pain", "zzz"]), (2, "lungs cancers | abdominal pains", ["abdomen pain"]), (3, "nothing alike", ["quux", "xyzzy"]), (4, "any", []), (5, None, ["a"]), (6, "", ["a"])]
    df = spark.createDataFrame(rows, "id int, answer string, mids array<string>")
    got = {r.id: r.hit for r in A.semantic_hits(df, "answer", "mids", stub, 0.7).collect()}
    parts = {r.id: r.c for r in df.select("id", chunks(F.col("answer")).alias("c")).collect()}
    assert parts[1] == ["lung cancer --[causes]--> chest pain", "lung cancer", "chest pain"]
    assert got[1][:3] == (True, "chest pain", 1.0) and got[4][:3] == (True, None, 1.0) and got[5][0] is False and got[6][0] is False
    e = stub.encode(["abdomen pain", *parts[2]])
    assert got[2][0] == bool((e[1:] @ e[0]).max() >= 0.7) and abs(got[2][2] - (e[1:] @ e[0]).max()) < 1e-9
    assert got[3][0] is False and got[3][2] < 0.7


def test_judging(spark):
    class Judge:
        def complete(self, prompts):
            return [f'{{"Relevancy": {4 if "hint one" in p else 1}, "coverage": 3}}' for p in prompts]

    ans = spark.createDataFrame([("c1", "graph", "x"), ("c1", "plain", None), ("c2", "graph", "y")], "case_id string, model string, answer string")
    meta = spark.createDataFrame([("c1", "d", "e", ["hint one", "b"])], "case_id string, description string, expected_diagnosis string, graph_evidence_hint array<string>")
    scores = A.judge(ans, meta, Judge())
    means = {r.model: (r.n, r.relevancy, r.coverage, r.factuality) for r in A.judge_means(scores).collect()}
    assert means == {"graph": (2, 2.5, 3.0, 0.0), "plain": (1, 4.0, 3.0, 0.0)}
    rubric = spark.createDataFrame([(3, 3), (2, 3), (1, 0), (2, 1)], "entity int, relation int")
    assert A.valid_rubric(rubric).count() == 2

    class Says:
        def complete(self, prompts):
            return ["Relationship: Treats\nbecause" if "Tail: b" in p else "unsure" for p in prompts]

    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "s string, o string")
    assert {(r.o, r.relation, r.valid) for r in A.predict_relations(pairs, ["Treats", "Causes"], Says()).collect()} == {("b", "Treats", True), ("c", "unsure", False)}


def test_alignment_stages(spark):
    m = spark.createDataFrame([(x,) for x in ("ASPIRIN ", "aspirim", "aspxyrin", "qqq", "aspppp")], "mention string")
    e = spark.createDataFrame([("aspirin",), ("ibuprofen",)], "entity string")
    plain = {r.mention: (r.entity, r.how) for r in align(m, e).collect()}
    assert plain["ASPIRIN "] == ("aspirin", "exact") and plain["aspirim"] == ("aspirin", "fuzzy") and plain["qqq"] == (None, "new")
    semantic = {r.mention: (r.entity, r.how) for r in align(m, e, 95.0, 50.0, rerank=lambda a, b: F.when(F.length(a) == 8, 0.9).otherwise(0.1)).collect()}
    assert semantic["aspxyrin"] == ("aspirin", "semantic") and semantic["aspirim"] == (None, "ask")
    told = {r.mention: (r.entity, r.how) for r in align(m, e, 95.0, 50.0, confirm=lambda x: x.select("mention", F.when(F.col("mention") == "aspirim", F.col("candidates")[0]).alias("entity"))).collect()}
    assert told["aspirim"] == ("aspirin", "model") and told["aspxyrin"] == (None, "new")


def test_graph_evidence_of_vectors(spark):
    rnd = np.random.default_rng(1)
    v = [(i, [float(x) for x in rnd.normal(size=8)], f"s{i % 3}", "p", f"o{i % 2}") for i in range(20)]
    facts = spark.createDataFrame(v, "id long, vector array<double>, s string, p string, o string")
    got = A.graph_evidence(facts.where("id < 2").select("id", "vector"), facts, 3, 2, 1)
    texts = {r.query_id: r.text for r in A.evidence_text(got).collect()}
    for q in (0, 1):
        sims = sorted(((-float(np.dot(v[q][1], x[1]) / np.linalg.norm(v[q][1]) / np.linalg.norm(x[1])), x[0]) for x in v))[:3]
        direct = sorted({f"{v[i][2]} p {v[i][4]}" for _, i in sims})
        anchors = sorted({n for _, i in sims for n in (v[i][2], v[i][4])})[:2]
        near = sorted({min(f"{x[2]} p {x[4]}" for x in v if a in (x[2], x[4])) for a in anchors})
        assert texts[q] == "--- Direct Semantic Matches ---\n" + "\n".join(direct) + "\n\n--- Structural Context (Reasoning) ---\n" + "\n".join(near)
