"""Knowledge-graph statistics over the graph views, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import kgstats as K
from trellis.plans.views import KG_SQL, base_and_merged, kg

TYPES = ("customer", "part", "supplier", "nation", "region")

QUERIES = {
    "kg_quant_report": lambda s, d: K.quant_report(*base_and_merged(s, d)),
    "kg_summary_table": lambda s, d: K.summary_table(K.quant_report(*base_and_merged(s, d))),
    "kg_filtering_summary": lambda s, d: (lambda e: K.filtering_summary(e, K.low_frequency_types(e, 10), ["region", "none"]))(kg(s, d)),
    "kg_node_type_counts": lambda s, d: K.node_type_counts(kg(s, d)),
    "kg_nodes": lambda s, d: K.nodes(kg(s, d)),
    "kg_relation_counts": lambda s, d: K.relation_counts(kg(s, d), "relation", drop_none=True),
    "kg_relation_entropy": lambda s, d: K.entropy(K.relation_counts(kg(s, d), "display_relation"), "edges").select(F.round("entropy", 6).alias("entropy")),
    "kg_two_hop_paths": lambda s, d: K.two_hop_paths(kg(s, d)).select(F.col("paths").cast("bigint").alias("paths")),
    "kg_low_freq_types": lambda s, d: K.low_frequency_types(kg(s, d), 10, 0.05).select("node_type", "nodes", F.round("ratio", 6).alias("ratio")),
    "kg_filter_types": lambda s, d: (lambda e: K.drop_types(e, K.excluded_types(K.low_frequency_types(e, 10), ["nation"])))(kg(s, d)).select("relation", "x_id", "y_id"),
    "kg_core_types": lambda s, d: kg(s, d).where(F.col("x_type").isin("customer", "part") & F.col("y_type").isin("customer", "part")).groupBy("relation").agg(F.count(F.lit(1)).alias("edges")),
    "kg_new_nodes": lambda s, d: K.new_of(*base_and_merged(s, d), "nodes"),
    "kg_new_triples": lambda s, d: K.new_of(*base_and_merged(s, d), "triples"),
    "kg_new_entity_pairs": lambda s, d: K.new_of(*base_and_merged(s, d), "entity_pairs"),
    "kg_new_type_pairs": lambda s, d: K.new_of(*base_and_merged(s, d), "type_pairs"),
    "kg_new_relations": lambda s, d: K.new_of(*base_and_merged(s, d), "display_relations"),
    "kg_relation_pair_counts": lambda s, d: K.relation_pair_counts(kg(s, d)),
    "kg_relation_pair_rollup": lambda s, d: K.relation_pair_rollup(kg(s, d)),
    "kg_relation_pair_topk_other": lambda s, d: K.top_pairs_other(kg(s, d), top_k=1, min_pct=0.2),
    "kg_shown_labels": lambda s, d: K.shown_labels(kg(s, d)),
    "kg_top_plus_other": lambda s, d: K.top_plus_other(kg(s, d).groupBy("x_source").agg(F.count(F.lit(1)).alias("edges")), "x_source", "edges", 8),
    "kg_resource_counts": lambda s, d: K.resource_counts(kg(s, d)),
    "kg_entity_novelty": lambda s, d: K.entity_novelty(*base_and_merged(s, d)).withColumn("new_fraction", F.round("new_fraction", 6)),
    "kg_type_pair_counts": lambda s, d: K.type_pair_counts(kg(s, d), undirected=True),
    "kg_type_pair_heatmap": lambda s, d: K.type_pair_matrix(kg(s, d), TYPES),
    "kg_type_pair_new_links": lambda s, d: K.new_type_pair_links(*base_and_merged(s, d)).withColumn("log_edges", F.round("log_edges", 6)),
    "kg_edge_provenance": lambda s, d: K.edge_provenance(kg(s, d)),
    "kg_edge_source": lambda s, d: kg(s, d).groupBy(K.edge_source(F.when(F.col("relation") == "part_customer", F.col("x_source"))).alias("edge_source")).agg(F.count(F.lit(1)).alias("edges")),
    "kg_union_all": lambda s, d: (lambda b, m: b.unionByName(m))(*base_and_merged(s, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("edges")),
}

_PAIR = "replace(x_type, '_', ' ') || ' -> ' || replace(y_type, '_', ' ')"


def _side(tag: str, t: str, e: str) -> str:
    return f"""{tag}_s AS (SELECT
  (SELECT count(*) FROM (SELECT DISTINCT node_id, node_type FROM {e})) AS nodes, (SELECT count(*) FROM {t}) AS n_rows,
  (SELECT count(DISTINCT node_type) FROM {e}) AS types, (SELECT count(DISTINCT relation) FROM {t}) AS rels, (SELECT count(DISTINCT display_relation) FROM {t}) AS drels,
  (SELECT round(-sum(n / total * ln(n / total)), 6) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM {t} GROUP BY relation)) AS ent,
  (SELECT round(-sum(n / total * ln(n / total)), 6) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM {t} GROUP BY display_relation)) AS dent,
  (SELECT CAST(sum(i * o) AS BIGINT) FROM (SELECT x_id AS v, count(*) AS o FROM {t} GROUP BY 1) JOIN (SELECT y_id AS v, count(*) AS i FROM {t} GROUP BY 1) USING (v)) AS hops,
  (SELECT count(*) FROM (SELECT DISTINCT x_type, y_type FROM {t})) AS tpairs)"""


_REPORT = (
    KG_SQL
    + ", "
    + _side("b", "base", "base_ends")
    + ", "
    + _side("m", "kg", "ends")
    + """, n AS (SELECT
  (SELECT count(*) FROM (SELECT node_id, node_type FROM ends EXCEPT SELECT node_id, node_type FROM base_ends)) AS nodes,
  (SELECT count(*) FROM (SELECT x_id, display_relation, y_id FROM kg EXCEPT SELECT x_id, display_relation, y_id FROM base)) AS triples,
  (SELECT count(*) FROM (SELECT node_type FROM ends EXCEPT SELECT node_type FROM base_ends)) AS types,
  (SELECT count(*) FROM (SELECT relation FROM kg EXCEPT SELECT relation FROM base)) AS rels,
  (SELECT count(*) FROM (SELECT display_relation FROM kg EXCEPT SELECT display_relation FROM base)) AS drels,
  (SELECT count(*) FROM (SELECT x_id, y_id FROM kg EXCEPT SELECT x_id, y_id FROM base)) AS pairs,
  (SELECT count(*) FROM (SELECT x_type, y_type FROM kg EXCEPT SELECT x_type, y_type FROM base)) AS tpairs),
report AS (SELECT 'base' AS base_name, b.nodes AS base_node_count, m.nodes AS merged_node_count, n.nodes AS new_node_count, round(n.nodes / b.nodes * 100, 4) AS node_coverage_lift_pct,
  b.n_rows AS base_triple_count, m.n_rows AS merged_triple_count, n.triples AS new_triple_count, round((m.n_rows - b.n_rows) / b.n_rows * 100, 4) AS triple_growth_pct,
  b.types AS base_entity_type_count, m.types AS merged_entity_type_count, n.types AS new_entity_type_count,
  b.rels AS base_relation_count, m.rels AS merged_relation_count, n.rels AS new_relation_count, round((m.rels - b.rels) / b.rels * 100, 4) AS relation_diversity_lift_pct,
  b.drels AS base_display_relation_count, m.drels AS merged_display_relation_count, n.drels AS new_display_relation_count,
  b.ent AS base_relation_entropy, m.ent AS merged_relation_entropy, b.dent AS base_display_relation_entropy, m.dent AS merged_display_relation_entropy,
  b.hops AS base_2hop_paths, m.hops AS merged_2hop_paths, m.hops - b.hops AS estimated_new_2hop_paths, n.pairs AS new_entity_pair_count, n.tpairs AS new_type_pair_count,
  CASE WHEN n.triples > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS novel_triple_rate_pct, CASE WHEN n.pairs > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS novel_entity_pair_rate_pct,
  round(n.rels / m.rels * 100, 4) AS novel_relation_usage_rate_pct, round(n.tpairs / m.tpairs * 100, 4) AS novel_type_pair_rate_pct
  FROM b_s b, m_s m, n)
"""
)
_FIGURES = [
    "base_node_count", "merged_node_count", "new_node_count", "node_coverage_lift_pct", "base_triple_count", "merged_triple_count", "new_triple_count", "triple_growth_pct", "base_entity_type_count", "merged_entity_type_count",
    "new_entity_type_count", "base_relation_count", "merged_relation_count", "new_relation_count", "relation_diversity_lift_pct", "base_display_relation_count", "merged_display_relation_count", "new_display_relation_count",
    "base_relation_entropy", "merged_relation_entropy", "base_display_relation_entropy", "merged_display_relation_entropy", "base_2hop_paths", "merged_2hop_paths", "estimated_new_2hop_paths", "new_entity_pair_count",
    "new_type_pair_count", "novel_triple_rate_pct", "novel_entity_pair_rate_pct", "novel_relation_usage_rate_pct", "novel_type_pair_rate_pct",
]

_LOW = "low AS (SELECT node_type, nodes, ratio FROM (SELECT node_type, count(*) AS nodes, count(*) / sum(count(*)) OVER () AS ratio FROM (SELECT DISTINCT node_id, node_type FROM ends) GROUP BY 1) WHERE nodes < 10)"
_PAIRS = f"pairs AS (SELECT display_relation, {_PAIR} AS pair, count(*) AS edges FROM kg GROUP BY ALL)"

ORACLE = {
    "kg_quant_report": _REPORT + "SELECT * FROM report",
    "kg_summary_table": _REPORT + " UNION ALL ".join(f"SELECT '{f}' AS metric, {f}::DOUBLE AS value FROM report" for f in _FIGURES),
    "kg_filtering_summary": KG_SQL
    + f""", {_LOW}, gone AS (SELECT DISTINCT node_type FROM low UNION SELECT 'region' UNION SELECT 'none'), kept AS (SELECT * FROM kg WHERE x_type NOT IN (SELECT node_type FROM gone) AND y_type NOT IN (SELECT node_type FROM gone)),
a AS (SELECT count(*) AS n FROM kg), b AS (SELECT count(*) AS n FROM kept), c AS (SELECT count(*) AS n FROM (SELECT DISTINCT node_id, node_type FROM ends)),
e AS (SELECT count(*) AS n FROM (SELECT x_id, x_type FROM kept UNION SELECT y_id, y_type FROM kept)), l AS (SELECT count(*) AS n, coalesce(string_agg(node_type, '; ' ORDER BY node_type), '') AS t FROM low),
g AS (SELECT count(*) AS n, string_agg(node_type, '; ' ORDER BY node_type) AS t FROM gone)
SELECT 'original_merged_triples' AS item, n::VARCHAR AS value FROM a UNION ALL SELECT 'filtered_merged_triples', n::VARCHAR FROM b UNION ALL SELECT 'removed_triples', (a.n - b.n)::VARCHAR FROM a, b
UNION ALL SELECT 'original_merged_nodes', n::VARCHAR FROM c UNION ALL SELECT 'filtered_merged_nodes', n::VARCHAR FROM e UNION ALL SELECT 'removed_nodes', (c.n - e.n)::VARCHAR FROM c, e
UNION ALL SELECT 'low_frequency_entity_type_count', n::VARCHAR FROM l UNION ALL SELECT 'low_frequency_entity_types', t FROM l UNION ALL SELECT 'forced_excluded_entity_type_count', '2' UNION ALL SELECT 'forced_excluded_entity_types', 'none; region'
UNION ALL SELECT 'final_removed_entity_type_count', n::VARCHAR FROM g UNION ALL SELECT 'final_removed_entity_types', t FROM g""",
    "kg_node_type_counts": KG_SQL + "SELECT node_type, count(DISTINCT node_id) AS nodes FROM ends GROUP BY 1",
    "kg_nodes": KG_SQL + "SELECT node_id, node_type, min(name) AS node_name FROM ends GROUP BY ALL",
    "kg_relation_counts": KG_SQL + "SELECT relation, count(*) AS edges FROM kg WHERE trim(relation) <> '' AND lower(trim(relation)) <> 'none' GROUP BY 1",
    "kg_relation_entropy": KG_SQL + "SELECT round(-sum(n / total * ln(n / total)), 6) AS entropy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM kg GROUP BY display_relation)",
    "kg_two_hop_paths": KG_SQL + "SELECT CAST(sum(i * o) AS BIGINT) AS paths FROM (SELECT x_id AS v, count(*) AS o FROM kg GROUP BY 1) JOIN (SELECT y_id AS v, count(*) AS i FROM kg GROUP BY 1) USING (v)",
    "kg_low_freq_types": KG_SQL + "SELECT node_type, nodes, round(ratio, 6) AS ratio FROM (SELECT node_type, count(*) AS nodes, count(*) / sum(count(*)) OVER () AS ratio FROM (SELECT DISTINCT node_id, node_type FROM ends) GROUP BY 1) WHERE nodes < 10 OR ratio < 0.05",
    "kg_filter_types": KG_SQL + f", {_LOW} SELECT relation, x_id, y_id FROM kg WHERE x_type NOT IN (SELECT node_type FROM low UNION SELECT 'nation') AND y_type NOT IN (SELECT node_type FROM low UNION SELECT 'nation')",
    "kg_core_types": KG_SQL + "SELECT relation, count(*) AS edges FROM kg WHERE x_type IN ('customer', 'part') AND y_type IN ('customer', 'part') GROUP BY 1",
    "kg_new_nodes": KG_SQL + "SELECT node_id, node_type FROM ends EXCEPT SELECT node_id, node_type FROM base_ends",
    "kg_new_triples": KG_SQL + "SELECT x_id, display_relation, y_id FROM kg EXCEPT SELECT x_id, display_relation, y_id FROM base",
    "kg_new_entity_pairs": KG_SQL + "SELECT x_id, y_id FROM kg EXCEPT SELECT x_id, y_id FROM base",
    "kg_new_type_pairs": KG_SQL + "SELECT x_type, y_type FROM kg EXCEPT SELECT x_type, y_type FROM base",
    "kg_new_relations": KG_SQL + "SELECT display_relation FROM kg EXCEPT SELECT display_relation FROM base",
    "kg_relation_pair_counts": KG_SQL + f", {_PAIRS} SELECT * FROM pairs",
    "kg_relation_pair_rollup": KG_SQL + f", {_PAIRS} SELECT display_relation, pair, CAST(sum(edges) AS BIGINT) AS edges FROM pairs GROUP BY ROLLUP (display_relation, pair)",
    "kg_relation_pair_topk_other": KG_SQL
    + f", {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY display_relation ORDER BY edges DESC, pair) AS i, sum(edges) OVER (PARTITION BY display_relation) AS total, count(*) OVER (PARTITION BY display_relation) AS n FROM pairs) SELECT display_relation, CASE WHEN i <= 1 OR edges / total >= 0.2 OR (display_relation = 'parent-child' AND n <= 10) THEN pair ELSE 'Other' END AS pair, CAST(sum(edges) AS BIGINT) AS edges FROM r GROUP BY ALL",
    "kg_shown_labels": KG_SQL + f", {_PAIRS} SELECT display_relation, pair, edges, row_number() OVER (PARTITION BY display_relation ORDER BY edges DESC, pair) = 1 OR edges / sum(edges) OVER () >= 0.025 AS shown FROM pairs",
    "kg_top_plus_other": KG_SQL + ", c AS (SELECT x_source, count(*) AS edges, row_number() OVER (ORDER BY count(*) DESC, x_source) AS i FROM kg GROUP BY 1) SELECT CASE WHEN i <= 8 THEN x_source ELSE 'Other' END AS x_source, CAST(sum(edges) AS BIGINT) AS edges FROM c GROUP BY 1",
    "kg_resource_counts": KG_SQL + "SELECT node_type, CASE WHEN upper(source) = 'CUSTOM' THEN 'text-based' ELSE upper(source) END AS source, count(DISTINCT node_id) AS nodes FROM ends GROUP BY ALL",
    "kg_entity_novelty": KG_SQL
    + ", m AS (SELECT node_type, count(DISTINCT node_id) AS n FROM ends GROUP BY 1), a AS (SELECT node_type, count(*) AS n FROM (SELECT node_id, node_type FROM ends EXCEPT SELECT node_id, node_type FROM base_ends) GROUP BY 1) SELECT m.node_type, m.n AS merged_nodes, greatest(0, least(m.n, m.n - coalesce(a.n, 0))) AS base_existing, coalesce(a.n, 0) AS text_added, round(coalesce(a.n, 0) / m.n, 6) AS new_fraction FROM m LEFT JOIN a USING (node_type)",
    "kg_type_pair_counts": KG_SQL + "SELECT least(x_type, y_type) AS x_type, greatest(x_type, y_type) AS y_type, count(*) AS edges FROM kg GROUP BY ALL",
    "kg_type_pair_heatmap": KG_SQL + "SELECT t.x_type, " + ", ".join(f"count(*) FILTER (WHERE y_type = '{t}') AS {t}" for t in TYPES) + " FROM (VALUES " + ", ".join(f"('{t}')" for t in TYPES) + ") t(x_type) LEFT JOIN kg ON kg.x_type = t.x_type GROUP BY 1",
    "kg_type_pair_new_links": KG_SQL
    + "SELECT x_type, y_type, edges, row_number() OVER (ORDER BY edges DESC, x_type, y_type) AS rank, round(log10(edges + 1), 6) AS log_edges FROM (SELECT x_type, y_type, count(*) AS edges FROM kg WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.x_type = kg.x_type AND b.y_type = kg.y_type) GROUP BY ALL)",
    "kg_edge_provenance": KG_SQL
    + "SELECT least(x_id, y_id) AS u, greatest(x_id, y_id) AS v, string_agg(DISTINCT relation, '|' ORDER BY relation) AS relations, string_agg(DISTINCT display_relation, '|' ORDER BY display_relation) AS display_relations, string_agg(DISTINCT x_source, '|' ORDER BY x_source) AS sources FROM kg GROUP BY 1, 2",
    "kg_edge_source": KG_SQL + "SELECT CASE WHEN relation = 'part_customer' AND trim(x_source) <> '' THEN 'literature' ELSE 'base' END AS edge_source, count(*) AS edges FROM kg GROUP BY 1",
    "kg_union_all": KG_SQL + "SELECT relation, count(*) AS edges FROM (SELECT * FROM kg UNION ALL SELECT * FROM base) GROUP BY 1",
}
