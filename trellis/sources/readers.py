"""Readers of every file form the pipeline meets. Each takes paths or globs and explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.jsonx import parse_graph_log
from trellis.functions.text import json_list, singularize, trimmed
from trellis.operators.cohort import unknown
from trellis.operators.evidence import document_lines
from trellis.operators.kgstats import EDGE_COLUMNS, normalise_edges, require_columns, unique_columns
from trellis.operators.ranking import global_index
from trellis.session import bounded, cut

TRIPLE = "id long, s string, p string, o string, concept string, origins array<string>, support long"


def documents(spark: SparkSession, path: str, with_title: bool = False, glob: str = "*.txt") -> DataFrame:
    """origin|||title|||abstract lines of one file or of every *.txt below a folder."""
    return document_lines(spark.read.option("pathGlobFilter", glob if not path.endswith(".txt") else "*").option("recursiveFileLookup", "true").text(path), with_title)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def evidence_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object concept -> {abstracts, origins, label} as one row per concept."""
    value = "struct<abstracts:array<string>,origins:array<string>,label:int>"
    x = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("concept", "v"))
    return x.select("concept", "v.*")


def evidence_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("concept string, abstracts array<string>, origins array<string>, label int").json(path)


def triples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines of triples; o may be a list. strict: a malformed line is an error, else it is skipped, as are triples without text in s, p or o."""
    x = spark.read.schema(TRIPLE).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    x = x.withColumn("o", F.coalesce(F.array_join(F.try_variant_get(F.try_parse_json("o"), F.lit("$"), "array<string>"), ", "), "o")) if not strict else x.withColumn("o", F.coalesce(F.array_join(F.from_json("o", "array<string>"), ", "), "o"))
    return x if strict else x.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """s, o pairs of one JSON array or of JSON lines; Spark's line reader takes both an array a line and an object a line."""
    multi = spark.read.schema("s string, o string").option("multiLine", "true").json(path)
    lines = spark.read.schema("s string, o string").json(path)
    return multi if spark.read.option("wholetext", "true").text(path).select(F.startswith(F.ltrim("value"), F.lit("["))).first()[0] else lines


def edges(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """An edge table CSV as text; indices become integers, 0 where unreadable; with normalise blanks become none."""
    x = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    require_columns(x, EDGE_COLUMNS)
    x = x.withColumns({c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ("x_index", "y_index") if c in x.columns})
    return normalise_edges(x) if normalise else x


def trimmed_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Every column trimmed text, null as empty."""
    x = require_columns(spark.read.option("header", "true").option("escape", '"').csv(path), required)
    return x.select(*[F.coalesce(trimmed(F.col(f"`{c}`")), F.lit("")).alias(c) for c in x.columns])


def clinical_tsv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Tab-separated text below # comment lines, null as empty, names in lower case."""
    x = spark.read.option("header", "true").option("sep", "\t").option("comment", "#").csv(path)
    x = x.toDF(*[c.lower() for c in x.columns])
    return require_columns(x, required).na.fill("")


def concepts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "|").schema("id int, concept string").csv(path)


def gold_concepts(spark: SparkSession, path: str) -> DataFrame:
    """The second column of a headerless pipe CSV, lower case, in the singular."""
    x = spark.read.option("sep", "|").schema("id string, concept string").csv(path)
    return x.select("id", singularize(F.lower(F.trim("concept"))).alias("concept")).where("concept <> ''")


def terms(spark: SparkSession, path: str) -> DataFrame:
    """One term a line, lower case, distinct."""
    return spark.read.text(path).select(F.lower(trimmed(F.col("value"))).alias("term")).where("term <> ''").distinct()


def tab_triples(spark: SparkSession, path: str | None) -> DataFrame:
    """Lines with at least three tab-separated parts as head, relation, tail; without a path there are none."""
    if path is None:
        return spark.createDataFrame([], "head string, relation string, tail string")
    p = F.split("value", "\t")
    return spark.read.text(path).where(F.size(p) >= 3).select(p[0].alias("head"), p[1].alias("relation"), p[2].alias("tail"))


def relation_schema(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object relation -> {label, description, example} as rows."""
    x = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", "map<string,struct<label:string,description:string,example:string>>")).alias("relation", "v"))
    return x.select("relation", "v.*")


def graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """source, target and the data of each edge (key -> value)."""
    schema = "_source string, _target string, data array<struct<_key:string,_VALUE:string>>"
    x = spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path)
    return x.select(F.col("_source").alias("source"), F.col("_target").alias("target"), F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data"))


def extraction_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_graph_log(spark.read.option("wholetext", "true").text(path))


def named_folders(spark: SparkSession, path: str, names: Mapping[str, str], schema: str) -> DataFrame:
    """CSV files of all folders below path, united; dataset is the folder's name, mapped by names where listed."""
    x = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").schema(schema).csv(path).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dataset"))
    if not names:
        return x
    return x.withColumn("dataset", F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("dataset")), "dataset"))


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array of test cases."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def relation_lines(relations: DataFrame) -> tuple[str, list[str]]:
    """Lines - label: description of a relation schema (a short list), and its labels in order."""
    rows = bounded(relations.select("label", "description").where("label IS NOT NULL").orderBy("label"), 10_000, "relations")
    return "\n".join(f"- {r['label']}: {r['description']}" for r in rows), [r["label"] for r in rows]


#: Columns of a cohort that are texts with Unknown where blank. Fixed values.
COHORT_TEXT = ("sex", "race", "ethnicity", "stage", "sample_type", "cancer_type", "cancer_type_detailed", "primary_site", "smoking_history", "msi_type", "gene_panel")


def cohort(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A cohort CSV with numbers read, blank, nan and NA texts as Unknown, lists parsed (treatments_list, altered_genes_list) and stage_group by stage_is_4.

    Rows without a patient_id column get patient_<i> in file order. strict: patient_id, treatments and altered_genes must be there, other missing columns get defaults (texts empty).
    """
    x = unique_columns(spark.read.option("header", "true").option("escape", '"').csv(path), "cohort")
    if strict:
        require_columns(x, ["patient_id", "treatments", "altered_genes"])
        x = x.withColumns({c: F.lit("") for c in ("cancer_type", "cancer_type_detailed", "primary_site", "stage") if c not in x.columns} | {c: F.lit(None).cast("string") for c in ("stage_is_4", "os_time", "os_event") if c not in x.columns})
    if "patient_id" not in x.columns:
        stored = cut(x)
        x = global_index(stored.withColumn("__i", F.monotonically_increasing_id()), ["__i"], "__n").withColumn("patient_id", F.concat(F.lit("patient_"), F.col("__n").cast("string"))).drop("__i", "__n")
    flag = lambda c: F.coalesce((F.lower(F.trim(c)).isin("true", "yes", "y") | (F.col(c).try_cast("double") == 1)).cast("int"), F.lit(0))
    out = {c: F.col(c).try_cast("double") for c in ("age", "os_time", "tmb", "tumor_purity") if c in x.columns}
    out |= {c: flag(c) for c in ("stage_is_4", "prior_treatment_binary", "sample_is_metastasis", "missing_tmb", "missing_tumor_purity") if c in x.columns}
    out |= {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("num_treatments", "num_altered_genes") if c in x.columns}
    if "os_event" in x.columns:
        out["os_event"] = F.coalesce(F.col("os_event").try_cast("double").cast("int"), F.lit(0))
    text = {c: (F.coalesce(c, F.lit("")) if strict else unknown(F.col(c))) for c in COHORT_TEXT if c in x.columns}
    x = x.withColumns(out | text | {"treatments_list": json_list(F.col("treatments")), "altered_genes_list": json_list(F.col("altered_genes"))})
    return x.withColumn("stage_group", F.when(F.col("stage_is_4") == 1, "Stage IV").otherwise("Stage I-III")) if "stage_is_4" in x.columns else x


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """An out-of-fold CSV: risk_score and model must be there; rows without a patient or a readable risk are left out, missing text columns are empty, a missing fold is 0."""
    x = require_columns(spark.read.option("header", "true").option("escape", '"').csv(path), ["patient_id", "risk_score", "model"])
    x = x.withColumns({c: F.lit("") for c in ("cancer_type", "stage_group", "dataset") if c not in x.columns} | ({} if "fold" in x.columns else {"fold": F.lit("0")}))
    x = x.withColumns({"risk_score": F.col("risk_score").try_cast("double"), "fold": F.coalesce(F.col("fold").try_cast("int"), F.lit(0))} | {c: F.col(c).try_cast("double") for c in ("os_time", "os_event") if c in x.columns})
    return x.where("patient_id IS NOT NULL AND risk_score IS NOT NULL AND NOT isnan(risk_score)")
