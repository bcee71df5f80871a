from pyspark.sql import functions as F

from trellis.sources import readers as R
from trellis.sources import writers as W


def test_text_forms(spark, tmp_path):
    (tmp_path / "a.txt").write_text("p1|||T|||Some text\np2|||Other\nnothing\n\n")
    got = R.documents(spark, str(tmp_path)).orderBy("origin").collect()
    assert [(r.origin, r.title, r.abstract) for r in got] == [("p1", "T", "Some text"), ("p2", None, "Other")]
    (tmp_path / "e.json").write_text('{"cat": {"abstracts": ["a"], "origins": ["o"], "label": 1}, "dog": {"abstracts": [], "origins": [], "label": 0}}')
    assert {(r.concept, r.label) for r in R.evidence_object(spark, str(tmp_path / "e.json")).collect()} == {("cat", 1), ("dog", 0)}
    (tmp_path / "t.jsonl").write_text('{"s": "a", "p": "b", "o": ["c", "d"], "id": 1}\n{"s": "a", "p": "b", "o": "e"}\n')
    assert [r.o for r in R.triples(spark, str(tmp_path / "t.jsonl")).collect()] == ["c, d", "e"]
    (tmp_path / "bad.jsonl").write_text('{"s": "a", "p": "b", "o": "e"}\n{broken\n{"s": "x"}\n')
    assert R.triples(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 1
    (tmp_path / "array.json").write_text('[{"s": "a", "o": "b"},\n {"s": "c", "o": "d"}]')
    (tmp_path / "lines.json").write_text('{"s": "a", "o": "b"}\n{"s": "c", "o": "d"}')
    for f in ("array.json", "lines.json"):
        assert sorted(map(tuple, R.pairs(spark, str(tmp_path / f)).collect())) == [("a", "b"), ("c", "d")]
    (tmp_path / "g.tsv").write_text("h\tr\tt\nonly\ttwo\n")
    assert R.tab_triples(spark, str(tmp_path / "g.tsv")).count() == 1
    (tmp_path / "c.tsv").write_text("#comment\nPATIENT_ID\tAGE\np1\t\n")
    assert R.clinical_tsv(spark, str(tmp_path / "c.tsv"), ["patient_id"]).first().age == ""
    (tmp_path / "g.graphml").write_text('<graphml><graph><edge source="a" target="b"><data key="d3">1.0</data><data key="d4">x</data></edge></graph></graphml>')
    assert R.graphml_edges(spark, str(tmp_path / "g.graphml")).first().data == {"d3": "1.0", "d4": "x"}


def test_tables_and_writers(spark, tmp_path):
    head = "relation,display_relation,x_index,x_id,x_type,x_name,x_source,y_index,y_id,y_type,y_name,y_source"
    (tmp_path / "kg.csv").write_text(f"{head}\nr,d,7,1,drug,a,S,oops,2,,b,S\n")
    e = R.edges(spark, str(tmp_path / "kg.csv"))
    assert (e.first().x_index, e.first().y_index, e.first().y_type) == (7, 0, "none")
    W.edges(e, e.where("false"), str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/merged")).count() == 1
    fused = spark.createDataFrame([("b", "p", "o"), ("a", "p", "o")], "s string, p string, o string")
    W.fused(fused, str(tmp_path / "fused"))
    assert {(r.s, r.id) for r in R.triples(spark, str(tmp_path / "fused")).collect()} == {("a", 0), ("b", 1)}
    W.concepts(spark.createDataFrame([(1, "bone marrow")], "id int, concept string"), str(tmp_path / "con"))
    assert R.concepts(spark, str(tmp_path / "con")).first().concept == "bone marrow"
    for name in ("a", "b"):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "m.csv").write_text("model,c\nx,1.0\n")
    got = R.named_folders(spark, str(tmp_path / "runs"), {"a": "A"}, "model string, c double")
    assert {r.dataset for r in got.select(F.col("dataset")).collect()} == {"A", "b"}
