"""Queries p1, p3 and p4 over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators.fill import NOTHING_KNOWN, Category, FillSpec, Number, fill_missing, fill_table, mine_dependencies, prepared
from trellis.operators.orphans import Reference, orphan_counts, orphans
from trellis.operators.quantiles import key_profile
from trellis.session import cut, table


def patient_fill_spec(spark: SparkSession, d: str) -> FillSpec:
    terms = table(spark, d, "canonical_terms").select("field_name", F.col("term").alias("name"), F.explode(F.array_union(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    numeric = [("cancer_type", "sample_type", "gene_panel", "quarter"), ("cancer_type", "gene_panel"), ("cancer_type",), ("quarter",), ()]
    return FillSpec(
        id_col="row_id",
        fields={"tmb": Number(0, 500), "tumor_purity": Number(1, 100), "cancer_type": Category()},
        determinants=[("sample_id",), ("patient_id",), ("cancer_type_detailed",), ("primary_site",), ("cancer_type_detailed", "primary_site"), ("patient_id", "month")],
        groups={"tmb": numeric, "tumor_purity": numeric, "cancer_type": [("primary_site", "sex"), ("primary_site",), ("sex",), ()]},
        canonical={c: terms.where(F.col("field_name") == c) for c in ("cancer_type_detailed", "primary_site")},
        derived={"month": F.date_format("recorded_at", "yyyy-MM"), "quarter": F.date_trunc("quarter", F.col("recorded_at"))},
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every missing value, as the operator filled and marked it."""
    return fill_missing(table(spark, d, "msk_chord_patient_level"), patient_fill_spec(spark, d)).where("source IS NOT NULL").select("row_id", "field_name")


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """The whole table with its three fields filled and marked."""
    return fill_table(table(spark, d, "msk_chord_patient_level"), patient_fill_spec(spark, d))


def p1_dependencies(spark: SparkSession, d: str) -> DataFrame:
    spec = patient_fill_spec(spark, d)
    report, _ = mine_dependencies(prepared(table(spark, d, "msk_chord_patient_level"), spec), spec)
    return report.select("field", "determinant", "repeated_keys", "repeated_rows", F.round("confidence", 6).alias("confidence"), "verified")


def _references(spark: SparkSession, d: str) -> list[Reference]:
    sample = table(spark, d, "data_clinical_sample")
    return [
        Reference("data_mutations", table(spark, d, "data_mutations"), "row_id", "tumor_sample_barcode", "loaded_at", sample, "sample_id", "loaded_at", "deleted_at"),
        Reference("data_clinical_sample", sample, "row_id", "patient_id", "loaded_at", table(spark, d, "data_clinical_patient"), "patient_id", "loaded_at", "deleted_at"),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(_references(spark, d)).select("table_name", "row_id", "kind")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_references(spark, d))


TRIPLE_SIDES = [("s", "o"), ("o", "s")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the full profile, histograms, quantiles and partners of all keys included, that hold a hundredth of all rows; cut, or the partners, which are not asked for, would be planned away."""
    x = table(spark, d, "step_03")
    return cut(key_profile(x, TRIPLE_SIDES, "support", (0.5,))).where(F.col("n_rows") >= x.count() * 0.01).select("side", "key_value")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, support, distinct partners and support quantiles of every subject and object."""
    x = key_profile(table(spark, d, "step_03"), TRIPLE_SIDES, "support", (0.5, 0.9))
    return x.select("side", "key_value", "n_rows", F.col("value_sum").cast("bigint").alias("support_sum"), "partners", F.col("q_50").cast("bigint").alias("support_p50"), F.col("q_90").cast("bigint").alias("support_p90"))


QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p1_dependencies": p1_dependencies, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_profile": p4_profile}

_NOTHING = ", ".join(f"'{w}'" for w in NOTHING_KNOWN)
_P1 = f"""
SELECT row_id, 'tmb' AS field_name FROM msk_chord_patient_level WHERE tmb IS NULL OR isnan(tmb) OR tmb < 0 OR tmb > 500
UNION ALL SELECT row_id, 'tumor_purity' FROM msk_chord_patient_level WHERE tumor_purity IS NULL OR isnan(tumor_purity) OR tumor_purity < 1 OR tumor_purity > 100
UNION ALL SELECT row_id, 'cancer_type' FROM msk_chord_patient_level
WHERE cancer_type IS NULL OR lower(regexp_replace(cancer_type, '[^a-zA-Z0-9]+', '', 'g')) IN ({_NOTHING})"""

_P3 = """
WITH refs AS (
  SELECT 'data_mutations' AS table_name, row_id, nullif(trim(tumor_sample_barcode, ' \t'), '') AS k, loaded_at AS came FROM data_mutations
  UNION ALL SELECT 'data_clinical_sample', row_id, nullif(trim(patient_id, ' \t'), ''), loaded_at FROM data_clinical_sample),
targets AS (
  SELECT 'data_mutations' AS table_name, nullif(trim(sample_id, ' \t'), '') AS k, loaded_at AS a, deleted_at AS b FROM data_clinical_sample
  UNION ALL SELECT 'data_clinical_sample', nullif(trim(patient_id, ' \t'), ''), loaded_at, deleted_at FROM data_clinical_patient),
met AS (
  SELECT r.table_name, r.row_id, any_value(r.came) AS came, count(t.k) AS n, count(*) FILTER (WHERE t.a <= r.came) AS loaded, count(*) FILTER (WHERE t.a <= r.came AND (t.b IS NULL OR r.came < t.b)) AS there
  FROM refs r LEFT JOIN targets t ON r.table_name = t.table_name AND r.k = t.k WHERE r.k IS NOT NULL GROUP BY 1, 2),
found AS (
  SELECT table_name, row_id, came, CASE WHEN n = 0 THEN 'missing' WHEN loaded > 0 THEN 'deleted' ELSE 'late' END AS kind FROM met WHERE there = 0)
"""

_P4 = """
WITH x AS (SELECT 's' AS side, s AS key_value, o AS partner, support FROM step_03 UNION ALL SELECT 'o', o, s, support FROM step_03)
"""

ORACLE = {
    "p1_found": _P1,
    "p3_found": _P3 + "SELECT table_name, row_id, kind FROM found",
    "p3_report": _P3 + "SELECT table_name, strftime(came AT TIME ZONE 'UTC', '%Y-%m') AS period, kind, count(*) AS orphans FROM found GROUP BY ALL",
    "p4_found": _P4 + "SELECT side, key_value FROM x WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM step_03)",
    "p4_profile": _P4
    + """, r AS (SELECT side, key_value, support, row_number() OVER (PARTITION BY side, key_value ORDER BY support) AS i, count(*) OVER (PARTITION BY side, key_value) AS n FROM x WHERE key_value IS NOT NULL AND support IS NOT NULL),
q AS (SELECT side, key_value, max(support) FILTER (WHERE i = greatest(1, ceil(0.5 * n))) AS support_p50, max(support) FILTER (WHERE i = greatest(1, ceil(round(0.9 * n, 6)))) AS support_p90 FROM r GROUP BY ALL)
SELECT a.side, a.key_value, a.n_rows, a.support_sum, a.partners, q.support_p50, q.support_p90
FROM (SELECT side, key_value, count(*) AS n_rows, CAST(sum(support) AS BIGINT) AS support_sum, count(DISTINCT partner) AS partners FROM x WHERE key_value IS NOT NULL GROUP BY ALL) a LEFT JOIN q USING (side, key_value)""",
}
