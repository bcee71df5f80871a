"""Queries p2, p5, p6, p7 and p8 over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.canonical import map_to_list, unmatched_report
from trellis.llm.copies import TripleRecord, collapse, copy_pairs
from trellis.llm.lookalike import look_classes, normalised, same_looking
from trellis.llm.mixing import mix, mix_report
from trellis.llm.packing import pack, packing_report
from trellis.llm.tokens import sized
from trellis.session import cut, table


def _typed_values(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "msk_chord_patient_level").select("row_id", "treatments", "cancer_type_detailed", "primary_site")
    agents = m.select("row_id", F.lit("treatments").alias("field_name"), F.posexplode(F.from_json("treatments", "array<string>")).alias("i", "value"))
    agents = agents.select("row_id", "field_name", (F.col("i") + 1).alias("item_no"), "value")
    one = m.select("row_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(1).alias("item_no"), F.col(c).alias("value")) for c in ("cancer_type_detailed", "primary_site")])).alias("x")).select("row_id", "x.*")
    return agents.unionByName(one)


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return map_to_list(_typed_values(spark, d), table(spark, d, "canonical_terms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("row_id", "field_name", "item_no", "ref_id")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_report(_mapped(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_pairs(TripleRecord().records(table(spark, d, "step_03")))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapse(TripleRecord().records(table(spark, d, "step_03")))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return cut(sized(docs, "text").withColumnsRenamed({"__tokens": "tokens", "__same": "same"}))


def _specs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "container_spec").select("spec_id", F.col("capacity_tokens").alias("capacity"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d).select("id", "tokens"), _specs(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p6_packed(spark, d), _specs(spark, d))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(p7_mixed(spark, d), table(spark, d, "mix_targets"))


def p7_epoch_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix as large as one pass over all texts: a budget at which limits on repetition bind, so that the exponent is found by bisection."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    budget = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    return mix_report(mix(sizes, targets, budget), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return same_looking(table(spark, d, "documents"), "doc_id", "text").withColumnsRenamed({"a": "doc_id_a", "b": "doc_id_b"})


def p8_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its one form, case kept."""
    return normalised(table(spark, d, "documents").select("doc_id", "text"), "text", fold=False)


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_classes(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched, "p5_found": p5_found, "p5_collapsed": p5_collapsed, "p6_packed": p6_packed, "p6_report": p6_report, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p7_epoch_shares": p7_epoch_shares, "p8_found": p8_found, "p8_normalised": p8_normalised, "p8_classes": p8_classes}
_BARE = "lower(regexp_replace(nfc_normalize({c}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}{keep}]+', '', 'g'))"
#: RE2 has no look-around: a point between two digits first becomes a sign that nothing else uses; twice, for 1.2.3.
_POINT = "regexp_replace(regexp_replace({c}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1\u2400\\2', 'g'), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1\u2400\\2', 'g')"


def _bare_sql(c: str, keep: str = "") -> str:
    return _BARE.format(c=_POINT.format(c=c), keep="\u2400" + keep)


def _members_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({_bare_sql(c, ',;')}, '[,;]'), lambda x: x <> '')), ',')"


_P5 = f"""
WITH a AS (SELECT id, {_members_sql("s")} AS s, {_bare_sql("p")} AS p, {_members_sql("o")} AS o FROM step_03 WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL),
b AS (SELECT id, p, CASE WHEN p IN ('associatedwith', 'interactswith', 'binding') AND s > o THEN o ELSE s END AS s, CASE WHEN p IN ('associatedwith', 'interactswith', 'binding') AND s > o THEN s ELSE o END AS o FROM a)
"""

ORACLE = {
    "p5_found": _P5 + "SELECT keep_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY s, p, o) AS keep_id FROM b) WHERE id <> keep_id",
    "p5_collapsed": _P5 + "SELECT min(id) AS keep_id, count(*) AS copies FROM b GROUP BY s, p, o",
}
