from pyspark.sql import functions as F

from trellis.operators.fill import Category, FillSpec, Number, fill_missing, fill_table, mine_dependencies, prepared

SCHEMA = "row_id long, v double, kind string, det string, extra string, value string, source string"


def spec(**k):
    return FillSpec("row_id", {"v": Number(0, 10), "kind": Category()}, [("det",), ("det", "extra")], {"v": [("kind",), ()], "kind": [()]}, min_keys=2, min_group=1, **k)


def rows():
    """det d0..d2 determine kind; v is present twice per det."""
    out = [(i, float(i % 3 + 1), f"K{i % 3}", f"d{i % 3}", "e", "x", "y") for i in range(30)]
    out += [(100, None, "K0", "d0", None, None, None), (101, float("nan"), "  ", "d1", "e", "", ""), (102, 11.0, "n/a", None, None, None, None), (103, -1.0, None, "d9", "", None, None), (104, 0.0, "Unknown", "d2", "e", None, None)]
    return out


def test_missing_values_are_listed_and_marked(spark):
    got = {(r.row_id, r.field_name): r for r in fill_missing(spark.createDataFrame(rows(), SCHEMA), spec()).collect()}
    assert set(got) == {(100, "v"), (101, "v"), (101, "kind"), (102, "v"), (102, "kind"), (103, "v"), (103, "kind"), (104, "kind")}
    assert got[101, "kind"].value == "K1" and got[101, "kind"].source == "dependency"
    assert got[100, "v"].value == "1.0" and got[100, "v"].source == "dependency"
    assert got[102, "kind"].source == "group" and got[103, "v"].source == "group"


def test_table_keeps_observed_values(spark):
    out = {r.row_id: r for r in fill_table(spark.createDataFrame(rows(), SCHEMA), spec()).collect()}
    assert len(out) == 35
    assert out[104].v == 0.0 and out[104].v_source == "observed" and out[104].kind == "K2" and out[104].kind_source == "dependency"
    assert out[5].kind == "K2" and out[5].source == "y"


def test_unverified_dependency_is_not_used(spark):
    noisy = [(i, float(i % 7), "ab"[i % 2], "same", "e", None, None) for i in range(20)] + [(99, None, None, "same", "e", None, None)]
    df = spark.createDataFrame(noisy, SCHEMA)
    report, dictionary = mine_dependencies(prepared(df, spec()), spec())
    assert not report.where("verified").count() and not dictionary.count()
    got = {r.field_name: r for r in fill_missing(df, spec()).collect()}
    assert got["kind"].value == "a" and got["kind"].source == "group"  # a tie breaks to the smaller
    assert got["v"].source == "group"


def test_empty_wholly_missing_and_long(spark):
    assert not fill_missing(spark.createDataFrame([], SCHEMA), spec()).count()
    nothing = spark.createDataFrame([(i, None, None, None, None, None, None) for i in range(3)], SCHEMA)
    got = fill_missing(nothing, spec()).collect()
    assert len(got) == 6 and {r.source for r in got} == {"none"} and {r.value for r in got} == {None}
    long = spark.createDataFrame([(1, 1.0, "k" * 100_000, "d", "e", None, None), (2, None, "k" * 100_000, "d", "e", None, None)], SCHEMA)
    assert fill_missing(long, spec()).first().value == "1.0"


def test_what_says_nothing(spark):
    words = ["None", "Unknown", " ", "", "N/A", "n.a.", "?", "not available", "unknown", "-", "UNK", "#N/A", "not recorded", "nan", "NA", "--", None]
    values = ["Unknown Primary Carcinoma", "Glial Tumor", "nano", "unknown tumor"]
    df = spark.createDataFrame([(w,) for w in words + values], "c string")
    kept = [r[0] for r in df.select(Category().value(F.col("c"))).collect()]
    assert kept == [None] * len(words) + values
