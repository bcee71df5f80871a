import pytest

from trellis.operators.kgstats import type_name, unique_columns
from trellis.operators import rules as R
from trellis.operators.ranking import global_index, sample_or_fail
from trellis.sources import readers, writers
from pyspark.sql import functions as F


def test_cohorts_and_predictions(spark, tmp_path):
    (tmp_path / "c.csv").write_text('age,stage_is_4,os_time,os_event,sex,cancer_type,treatments,altered_genes,tmb\n60,True,12.5,1,F,,"[""a"", "" ""]",,x\n,0,,,NA,Lung,not a list,"[""g""]",3\n')
    got = readers.cohort(spark, str(tmp_path / "c.csv")).orderBy("patient_id").collect()
    assert [r.patient_id for r in got] == ["patient_0", "patient_1"]
    a, b = got
    assert (a.age, a.stage_is_4, a.os_event, a.sex, a.cancer_type, a.treatments_list, a.altered_genes_list, a.tmb, a.stage_group) == (60.0, 1, 1, "F", "Unknown", ["a"], [], None, "Stage IV")
    assert (b.age, b.os_event, b.sex, b.treatments_list, b.altered_genes_list, b.stage_group) == (None, 0, "Unknown", [], ["g"], "Stage I-III")
    with pytest.raises(ValueError):
        readers.cohort(spark, str(tmp_path / "c.csv"), strict=True)
    (tmp_path / "s.csv").write_text('patient_id,treatments,altered_genes\np1,"[""a""]",[]\n')
    s = readers.cohort(spark, str(tmp_path / "s.csv"), strict=True).first()
    assert (s.patient_id, s.cancer_type, s.stage_is_4, s.os_event, s.os_time) == ("p1", "", 0, 0, None)
    (tmp_path / "o.csv").write_text("patient_id,risk_score,model\np1,0.5,m\n,0.5,m\np2,bad,m\n")
    assert [tuple(r) for r in readers.predictions(spark, str(tmp_path / "o.csv")).select("patient_id", "risk_score", "fold", "dataset").collect()] == [("p1", 0.5, 0, "")]


def test_small_readers(spark, tmp_path):
    assert not readers.tab_triples(spark, None).count()
    (tmp_path / "g.csv").write_text("1|Lung Metastases\n2|\n3| masses \n")
    assert sorted(r.concept for r in readers.gold_concepts(spark, str(tmp_path / "g.csv")).collect()) == ["lung metastasis", "mass"]
    text, labels = readers.relation_lines(spark.createDataFrame([("Treats", "x"), ("Causes", "y")], "label string, description string"))
    assert text == "- Causes: y\n- Treats: x" and labels == ["Causes", "Treats"]
    writers.explanation(*[spark.createDataFrame([(1, [1, 2])], "a int, b array<int>").select("a") for _ in range(2)], spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), spark.createDataFrame([(1,)], "n int"), str(tmp_path / "out"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "out/paths")).first().b == "[1,2]"


def test_columns_types_index_and_samples(spark):
    with pytest.raises(ValueError):
        unique_columns(spark.createDataFrame([(1, 2)], "a int, A int"))
    kinds = [("Gene", "gene/protein", "gene/protein"), ("Biological Process", "biological_process", "biological_process"), ("BP", "bp", "biological_process"), (None, "", None), ("", "", "none"), ("Widget", "widget", "widget")]
    df = spark.createDataFrame(kinds, "k string, a string, b string")
    for r in df.select(type_name(F.col("k")).alias("x"), type_name(F.col("k"), R.TYPE_NAMES_WIDE).alias("y"), "a", "b").collect():
        assert (r.x, r.y) == (r.a, r.b)
    x = global_index(spark.range(1000).select((1000 - F.col("id")).alias("v")), ["v"], "i", 5).collect()
    assert sorted((r.v, r.i) for r in x) == [(v, v + 4) for v in range(1, 1001)]
    assert sample_or_fail(spark.range(10), "id", 3).count() == 3
    with pytest.raises(ValueError):
        sample_or_fail(spark.range(2), "id", 3)
