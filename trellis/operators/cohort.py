"""Patient-level cohorts from clinical tables, and features of tabular cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import json_list, trimmed
from trellis.operators.quantiles import linear_quantiles
from trellis.operators.ranking import top_per_key


def filled(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(trimmed(c), F.lit(""))


def unknown(c: Column) -> Column:
    """Blank, nan and NA as Unknown."""
    t = filled(c)
    return F.when(t.isNull() | t.isin("nan", "NA"), "Unknown").otherwise(t)


def stage_group(stage: Column) -> Column:
    """Stage IV, Stage I-III, or null where the stage is not known."""
    t = unknown(stage)
    return F.when(F.contains(t, F.lit("4")) | F.contains(F.upper(t), F.lit("IV")), "Stage IV").when(t != "Unknown", "Stage I-III")


def os_event(status: Column) -> Column:
    """1 for 1:DECEASED and the like, 0 for 0:LIVING, null otherwise."""
    s = F.upper(trimmed(F.coalesce(status, F.lit(""))))
    return F.when(F.startswith(s, F.lit("1")) | s.contains("DECEASED"), 1).when(F.startswith(s, F.lit("0")) | s.contains("LIVING"), 0)


def index_sample(samples: DataFrame) -> DataFrame:
    """One sample per patient: primary before metastasis before others, then the smallest sample id; a minimum, so it combines map-side."""
    kind = F.lower(filled(F.col("sample_type")))
    rank = F.when(kind == "primary", 0).when(kind == "metastasis", 1).otherwise(2)
    cols = ["sample_id", "cancer_type", "cancer_type_detailed", "sample_type", "primary_site", "msi_type", "tmb_nonsynonymous", "tumor_purity", "gene_panel"]
    x = samples.select(filled(F.col("patient_id")).alias("patient_id"), F.struct(rank.alias("r"), filled(F.col("sample_id")).alias("k"), "row_id", *cols).alias("s")).where("patient_id IS NOT NULL")
    return x.groupBy("patient_id").agg(F.min("s").alias("s")).select("patient_id", *[f"s.{c}" for c in cols])


def list_per(df: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """Per key its distinct non-blank values in order as a JSON list; values are made distinct before they are collected."""
    x = df.select(filled(F.col(key)).alias(key), filled(F.col(value)).alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull()).distinct()
    return x.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list("v"))).alias(into), F.count(F.lit(1)).alias(f"num_{into}"))


def mutated_genes(mutations: DataFrame, samples: DataFrame) -> DataFrame:
    """(patient_id, gene) of mutations whose barcode is a sample."""
    owner = samples.select(filled(F.col("sample_id")).alias("sample"), filled(F.col("patient_id")).alias("patient_id")).where("sample IS NOT NULL AND patient_id IS NOT NULL").groupBy("sample").agg(F.min("patient_id").alias("patient_id"))
    m = mutations.select(filled(F.col("tumor_sample_barcode")).alias("sample"), "hugo_symbol").where("sample IS NOT NULL").distinct()
    return m.join(owner, "sample").select("patient_id", "hugo_symbol")


def sample_ambiguity(samples: DataFrame) -> DataFrame:
    """Per patient how many different samples, cancer types, detailed types and sites it has, and whether more than one cancer type."""
    cols = {"n_samples": "sample_id", "n_cancer_types": "cancer_type", "n_detailed": "cancer_type_detailed", "n_sites": "primary_site"}
    x = samples.select(filled(F.col("patient_id")).alias("patient_id"), *[filled(F.col(c)).alias(c) for c in cols.values()]).where("patient_id IS NOT NULL")
    parts = [x.select("patient_id", F.col(c).alias("v"), F.lit(n).alias("what")) for n, c in cols.items()]
    d = reduce(DataFrame.unionByName, parts).where("v IS NOT NULL").distinct()  # one shuffle for all four counts
    got = d.groupBy("patient_id").agg(*[F.count_if(F.col("what") == n).alias(n) for n in cols])
    return got.withColumn("multi_cancer", F.col("n_cancer_types") > 1)


def patient_level(patients: DataFrame, samples: DataFrame, mutations: DataFrame, treatments: DataFrame) -> DataFrame:
    """One row per patient: first loaded clinical row, index sample, treatment and gene lists ([] where none)."""
    cols = ["os_months", "os_status", "current_age_deid", "gender", "race", "ethnicity", "stage_highest_recorded", "smoking_predictions_3_classes", "prior_med_to_msk"]
    p = patients.select(filled(F.col("patient_id")).alias("patient_id"), F.struct("loaded_at", "row_id", *cols).alias("s")).where("patient_id IS NOT NULL").groupBy("patient_id").agg(F.min("s").alias("s"))
    p = p.select("patient_id", F.col("s.os_months").try_cast("double").alias("os_time"), os_event(F.col("s.os_status")).alias("os_event"), F.col("s.current_age_deid").try_cast("double").alias("age"), F.col("s.gender").alias("sex"), F.col("s.stage_highest_recorded").alias("stage"), F.col("s.prior_med_to_msk").alias("prior"))
    agents = list_per(treatments, "patient_id", "agent", "treatments")
    genes = list_per(mutated_genes(mutations, samples), "patient_id", "hugo_symbol", "altered_genes")
    out = p.join(index_sample(samples), "patient_id", "left").join(agents, "patient_id", "left").join(genes, "patient_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.withColumns({"treatments": F.coalesce("treatments", F.lit("[]")), "altered_genes": F.coalesce("altered_genes", F.lit("[]")), "num_treatments": F.coalesce("num_treatments", zero), "num_altered_genes": F.coalesce("num_altered_genes", zero)})


def strict_cohort(level: DataFrame, ambiguity: DataFrame) -> DataFrame:
    """Patients with survival time above 0, age and a known single cancer type; a patient without samples drops out with its null flag."""
    x = level.withColumn("cancer_type", unknown(F.col("cancer_type"))).join(ambiguity.select("patient_id", "multi_cancer"), "patient_id", "left")
    x = x.where(F.col("os_time").isNotNull() & (F.col("os_time") > 0) & F.col("age").isNotNull() & (F.col("cancer_type") != "Unknown") & ~F.col("multi_cancer"))
    return x.withColumns({"stage_is_4": F.contains(F.coalesce("stage", F.lit("")), F.lit("4")).cast("int"), "had_prior_treatment": F.ilike(F.coalesce("prior", F.lit("")), F.lit("%prior medications%")).cast("int"), "missing_tmb": F.col("tmb_nonsynonymous").try_cast("double").isNull().cast("int")})


def cohort_qc(level: DataFrame, strict: DataFrame) -> DataFrame:
    """One row: patients before and after, dropped, event rate and median survival."""
    median = linear_quantiles(strict.select("os_time"), [], "os_time", [0.5]).select(F.col("q").alias("median_os"), F.lit(1).alias("k"))
    a = level.agg(F.count(F.lit(1)).alias("patients")).withColumn("k", F.lit(1))
    b = strict.agg(F.count(F.lit(1)).alias("kept"), F.avg("os_event").alias("event_rate")).withColumn("k", F.lit(1))
    return a.join(F.broadcast(b), "k").join(F.broadcast(median), "k").select("patients", "kept", (F.col("patients") - F.col("kept")).alias("dropped"), "event_rate", "median_os")


def feature_distribution(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: n, mean, sd, min, quartiles (linear), max, distinct values and the share of zeros."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.*").where("v IS NOT NULL AND NOT isnan(v)")
    base = long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg((F.col("v") == 0).cast("int")).alias("share_zero"))
    kinds = long.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))
    q = linear_quantiles(long, ["feature"], "v", [0.25, 0.5, 0.75]).groupBy("feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return base.join(F.broadcast(kinds), "feature").join(F.broadcast(q), "feature")


def top_items(df: DataFrame, list_col: str, k: int) -> DataFrame:
    """The k most frequent items of JSON lists: item, n; ties by item."""
    return df.select(F.explode(json_list(F.col(list_col))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(k)


def multi_hot(df: DataFrame, id_col: str, list_col: str, vocabulary: Sequence[str], prefix: str) -> DataFrame:
    """A 0/1 column per vocabulary item; the vocabulary comes from the training part."""
    items = json_list(F.col(list_col))
    return df.select(id_col, *[F.array_contains(items, v).cast("int").alias(f"{prefix}_{i}") for i, v in enumerate(vocabulary)])


def one_hot(df: DataFrame, id_col: str, col: str, categories: Sequence[str]) -> DataFrame:
    """A 0/1 column per category; unseen categories are all 0."""
    return df.select(id_col, *[F.coalesce((F.col(col) == c).cast("int"), F.lit(0)).alias(f"{col}_{i}") for i, c in enumerate(categories)])


def impute_by_fold(df: DataFrame, fold: str, features: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """For each test fold all rows with missing features filled by the median of the other folds' rows (0 where they have none): test_fold, part and the row."""
    each = df.select("*", F.explode(F.array(*[F.lit(f) for f in folds])).alias("test_fold")).withColumn("part", F.when(F.col(fold) == F.col("test_fold"), "test").otherwise("train"))
    train = each.where("part = 'train'").select("test_fold", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("test_fold", "x.*")
    q = linear_quantiles(train, ["test_fold", "feature"], "v", [0.5]).groupBy("test_fold").agg(*[F.max(F.when(F.col("feature") == f, F.col("q"))).alias(f"__m_{f}") for f in features])
    out = each.join(F.broadcast(q), "test_fold", "left")
    return out.withColumns({f: F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), f"__m_{f}", F.lit(0.0)) for f in features}).drop(*[f"__m_{f}" for f in features])


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_per_key(df, keys, order, 1).drop("rank")
