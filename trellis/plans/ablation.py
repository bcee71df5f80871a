"""Graph features of patients and the comparison of survival models over feature sets, and their SQL.

The graph is made of the clinical tables: detailed cancer types under their parents, and sites, agents and genes that at least MIN_ROWS patients of a cancer type have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.text import json_list
from trellis.operators import ablation as A
from trellis.operators import cohort as C
from trellis.operators import kgfeatures as K
from trellis.operators import survival as V
from trellis.session import cut, stored, table

MIN_ROWS = 20
MAX_HOPS = 8


def patients(s: SparkSession, d: str) -> DataFrame:
    """The patients that are followed, with their lists read as tx and genes; stored, for all that reads them again."""
    x = table(s, d, "msk_chord_patient_level").where("os_time > 0 AND os_event IS NOT NULL")
    return stored(x.select("*", json_list(F.col("treatments")).alias("tx"), json_list(F.col("altered_genes")).alias("genes")).drop("treatments", "altered_genes"))


def mentions(p: DataFrame) -> DataFrame:
    """id, kind, query: what each record says of its cancer, site, agents and genes."""
    one = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("query")) for k, c in (("cancer", "cancer_type"), ("cancer", "cancer_type_detailed"), ("site", "primary_site"))]

    def said(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("query"))

    many = [F.transform(F.col(c), said(k)) for k, c in (("treatment", "tx"), ("gene", "genes"))]
    x = p.select(F.col("row_id").alias("id"), F.explode(F.concat(F.array(*one), *many)).alias("m"))
    return x.select("id", "m.kind", "m.query")


def graph(p: DataFrame, s: SparkSession, d: str) -> DataFrame:
    kinds = (("anatomy", F.array("primary_site")), ("drug", F.col("tx")), ("gene/protein", F.col("genes")))
    parts = [p.select(F.col("cancer_type").alias("x_name"), F.lit(k).alias("y_type"), F.explode(v).alias("y_name")) for k, v in kinds]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("x_name", "y_type", "y_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS).drop("n")
    up = table(s, d, "canonical_terms").where("parent_term IS NOT NULL").select(F.col("term").alias("x_name"), F.lit("disease").alias("y_type"), F.col("parent_term").alias("y_name"))
    return cut(K.typed_graph(x.unionByName(up).withColumn("x_type", F.lit("disease"))))


def features(p: DataFrame, s: SparkSession, d: str) -> DataFrame:
    return K.kg_features(p.select(F.col("row_id").alias("id")), mentions(p), graph(p, s, d), MAX_HOPS)


def diagnostics(s: SparkSession, d: str) -> DataFrame:
    p = patients(s, d)
    return K.mapping_diagnostics(p.select(F.col("row_id").alias("id")), mentions(p), graph(p, s, d))


GROUPS = {
    "clinical": ("age_band", "stage", "prior_treatment_to_msk", "sex", "race", "ethnicity", "sample_type", "cancer_type", "primary_site", "smoking_history"),
    "treatment": ("n_tx",),
    "molecular": ("msi_type", "gene_panel", "tmb_band", "purity_band", "genes_band"),
    "kg": ("kg_genes", "kg_treatment", "kg_gene", "kg_near"),
}


def coded(s: SparkSession, d: str) -> DataFrame:
    """Patients with every feature as a value of few kinds, in all datasets they are in, with folds."""
    band = lambda c, lo, hi, width, most: F.when(~F.isnan(c) & F.col(c).between(lo, hi), F.floor(F.least(F.col(c), F.lit(float(most))) / width).cast("int"))
    p = patients(s, d)
    k = features(p, s, d).select(F.col("id").alias("row_id"), F.least(F.col("kg_num_gene_nodes"), F.lit(10)).cast("int").alias("kg_genes"), *[F.col(f"kg_{n}_min_dist").cast("int").alias(c) for n, c in (("cancer_treatment", "kg_treatment"), ("cancer_gene", "kg_gene"), ("disease_or_site_gene", "kg_near"))])
    x = p.select(
        "row_id", "os_time", "os_event", C.unknown(F.col("cancer_type")).alias("cancer_type"), C.stage_group(F.col("stage")).alias("stage_group"), "stage", "prior_treatment_to_msk", "sex", "race", "ethnicity", "sample_type", "primary_site", "smoking_history", "msi_type", "gene_panel",
        band("age", 0, 150, 10, 150).alias("age_band"), band("tmb", 0, 500, 5, 50).alias("tmb_band"), band("tumor_purity", 1, 100, 20, 100).alias("purity_band"),
        F.least(F.size("tx"), F.lit(5)).alias("n_tx"), F.least(F.floor(F.size("genes") / 3), F.lit(5)).cast("int").alias("genes_band"),
    ).join(k, "row_id")
    x = x.withColumnsRenamed({"os_time": "time", "os_event": "event"})
    return A.with_folds(A.datasets(stored(x)), "row_id")


def risks(s: SparkSession, d: str) -> DataFrame:
    return A.hazard_risks(coded(s, d), GROUPS, "row_id")


def metrics(s: SparkSession, d: str) -> DataFrame:
    return A.fold_metrics(stored(risks(s, d)))


def paired_t(s: SparkSession, d: str) -> DataFrame:
    rows = [(r["dataset"], r["n"], r["t"], r["p"]) for r in V.paired_t(metrics(s, d), "clinical_only", "clinical_treatment_molecular_kg", "c_index")]
    return s.createDataFrame(rows, "dataset string, n long, t double, p double").withColumns({"t": F.round("t", 6), "p": F.round("p", 6)})


def slices(s: SparkSession, d: str) -> DataFrame:
    """How many predictions each stage file holds, of the cancers with most patients."""
    x = coded(s, d)
    top = [r[0] for r in x.where("dataset = 'all_cancers'").groupBy("cancer_type").count().orderBy(F.desc("count"), "cancer_type").limit(5).collect()]  # five names
    y = A.stage_slices(x.select("row_id", "dataset", "cancer_type", "stage_group", "fold"), top)
    return y.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"))


_ROUND = [c for c in K.FEATURES if c.endswith("mean_dist")]
QUERIES = {
    "cohort_kg_features": lambda s, d: features(patients(s, d), s, d).withColumns({c: F.round(c, 6) for c in _ROUND}),
    "cohort_kg_diagnostics": lambda s, d: diagnostics(s, d).withColumns({c: F.round(c, 6) for c in ("kg_treatment_mapping_rate", "kg_gene_mapping_rate")}),
    "kg_diagnostics_summary": lambda s, d: K.diagnostics_summary(diagnostics(s, d)).withColumns({c: F.round(c, 6) for c in ("disease_mapping_patient_rate", "anatomy_mapping_patient_rate", "treatment_mapping_rate_nonempty", "gene_mapping_rate_nonempty")}),
    "ablation_folds": lambda s, d: coded(s, d).select("dataset", "row_id", "fold"),
    "ablation_fold_metrics": lambda s, d: metrics(s, d).withColumn("c_index", F.round("c_index", 6)),
    "ablation_summary": lambda s, d: V.summary(metrics(s, d).where("dataset = 'all_cancers'"), ["model"], ["c_index"]).select("model", F.round("c_index_mean", 6).alias("c_index_mean"), F.round("c_index_std", 6).alias("c_index_std")),
    "ablation_by_dataset": lambda s, d: V.summary(metrics(s, d), ["dataset", "model"], ["c_index"]).select("dataset", "model", F.round("c_index_mean", 6).alias("c_index_mean"), F.round("c_index_std", 6).alias("c_index_std")),
    "paired_t_test": paired_t,
    "oof_stage_slices": slices,
}

_TRIM = "regexp_replace({c}, '^[\\s\\xA0]+|[\\s\\xA0]+$', '', 'g')"
_LIST = f"list_filter(list_transform(coalesce(from_json({{c}}, '[\"VARCHAR\"]'), []), lambda x: {_TRIM.format(c='x')}), lambda x: x <> '')"
_NORM = f"lower(regexp_replace({_TRIM}, '\\s+', ' ', 'g'))"
_COMPACT = f"regexp_replace({_NORM}, '[^a-z0-9]+', '', 'g')"


def _node(kind: str, name: str) -> str:
    return f"'{kind}|' || {_NORM.format(c=name)}"


_GRAPH = f"""WITH RECURSIVE pat AS (SELECT *, {_LIST.format(c='treatments')} AS tx, {_LIST.format(c='altered_genes')} AS genes FROM msk_chord_patient_level WHERE os_time > 0 AND os_event IS NOT NULL),
co AS (SELECT cancer_type AS x, 'anatomy' AS k, primary_site AS y FROM pat UNION ALL SELECT cancer_type, 'drug', unnest(tx) FROM pat UNION ALL SELECT cancer_type, 'gene/protein', unnest(genes) FROM pat),
ed AS (SELECT x, k, y FROM co GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_ROWS} UNION ALL SELECT term, 'disease', parent_term FROM canonical_terms WHERE parent_term IS NOT NULL),
gr AS (SELECT DISTINCT {_node('disease', 'x')} AS src, k || '|' || {_NORM.format(c='y')} AS dst FROM ed WHERE {_NORM.format(c="coalesce(x, '')")} <> '' AND {_NORM.format(c="coalesce(y, '')")} <> ''),
nd AS (SELECT node, split_part(node, '|', 1) AS type, substr(node, instr(node, '|') + 1) AS name FROM (SELECT src AS node FROM gr UNION SELECT dst FROM gr)),
nc AS (SELECT *, {_COMPACT.format(c='name')} AS nc FROM nd),
mn AS (SELECT row_id AS id, 'cancer' AS kind, 'disease' AS type, cancer_type AS query FROM pat UNION ALL SELECT row_id, 'cancer', 'disease', cancer_type_detailed FROM pat UNION ALL SELECT row_id, 'site', 'anatomy', primary_site FROM pat
  UNION ALL SELECT row_id, 'treatment', 'drug', unnest(tx) FROM pat UNION ALL SELECT row_id, 'gene', 'gene/protein', unnest(genes) FROM pat),
qs AS (SELECT type, query, {_NORM.format(c='query')} AS qn, {_COMPACT.format(c='query')} AS qc FROM (SELECT DISTINCT type, query FROM mn WHERE query IS NOT NULL) WHERE qn <> ''),
sm AS (SELECT q.type, query, node, name, qn = name AS exact FROM qs q JOIN nc n ON q.type = n.type AND qc = n.nc),
ins AS (SELECT q.type, query, node, name, false AS exact FROM qs q JOIN nc n ON q.type = n.type AND (contains(name, qn) OR contains(qn, name)) WHERE length(qn) >= 4 AND NOT EXISTS (SELECT 1 FROM sm WHERE sm.type = q.type AND sm.query = q.query)),
rs AS (SELECT type, query, node FROM (SELECT * FROM sm UNION ALL SELECT * FROM ins) QUALIFY row_number() OVER (PARTITION BY type, query ORDER BY exact DESC, name) <= 5),
rn AS (SELECT DISTINCT id, kind, node FROM mn JOIN rs USING (type, query))"""
_FEATURES = f"""{_GRAPH},
u AS (SELECT src, dst FROM gr WHERE src <> dst UNION SELECT dst, src FROM gr WHERE src <> dst),
bfs(source, node, hops) AS (SELECT DISTINCT node, node, 0 FROM rn WHERE kind IN ('cancer', 'site', 'treatment') UNION SELECT source, u.dst, hops + 1 FROM bfs JOIN u ON u.src = bfs.node WHERE hops < {MAX_HOPS}),
dist AS (SELECT source, node, min(hops) AS hops FROM bfs GROUP BY 1, 2),
cnt AS (SELECT id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}')::DOUBLE AS kg_num_{n}_nodes" for n, k in K.COUNTS)} FROM rn GROUP BY 1),
""" + ",\n".join(
    f"f_{n} AS (SELECT id, count(*)::DOUBLE AS kg_{n}_pairs, min(hops)::DOUBLE AS kg_{n}_min_dist, avg(hops) AS kg_{n}_mean_dist FROM (SELECT DISTINCT id, node FROM rn WHERE kind IN ({', '.join(repr(x) for x in ls)})) l JOIN rn r USING (id) JOIN dist ON dist.source = l.node AND dist.node = r.node WHERE r.kind = '{r}' GROUP BY 1)"
    for n, ls, r in K.DISTANCES
) + ",\nft AS (SELECT row_id AS id, " + ", ".join(f"coalesce({c}, {99.0 if c.endswith('_dist') else 0.0})::DOUBLE AS {c}" for c in K.FEATURES) + " FROM pat LEFT JOIN cnt ON cnt.id = row_id " + " ".join(f"LEFT JOIN f_{n} ON f_{n}.id = row_id" for n, _, _ in K.DISTANCES) + ")"
_DIAG = f"""{_GRAPH}, tm AS (SELECT id, {', '.join(f"count(query) FILTER (WHERE kind = '{k}') AS total_{k}, count(*) FILTER (WHERE kind = '{k}' AND EXISTS (SELECT 1 FROM rs WHERE rs.type = mn.type AND rs.query = mn.query)) AS mapped_{k}" for k in K.KINDS)} FROM mn GROUP BY 1),
dn AS (SELECT id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS diag_num_{n}_nodes" for n, k in K.COUNTS)} FROM rn GROUP BY 1),
dg AS (SELECT row_id AS id, (coalesce(mapped_cancer, 0) > 0)::INT AS kg_has_disease_mapping, (coalesce(mapped_site, 0) > 0)::INT AS kg_has_anatomy_mapping, coalesce(total_treatment, 0) AS kg_total_treatments, coalesce(mapped_treatment, 0) AS kg_mapped_treatments,
  CASE WHEN total_treatment > 0 THEN mapped_treatment / total_treatment END AS kg_treatment_mapping_rate, coalesce(total_gene, 0) AS kg_total_genes, coalesce(mapped_gene, 0) AS kg_mapped_genes, CASE WHEN total_gene > 0 THEN mapped_gene / total_gene END AS kg_gene_mapping_rate,
  {', '.join(f"coalesce(diag_num_{n}_nodes, 0) AS diag_num_{n}_nodes" for n, _ in K.COUNTS)} FROM pat LEFT JOIN tm ON tm.id = row_id LEFT JOIN dn ON dn.id = row_id)"""


def _band(c: str, lo: float, hi: float, width: int, most: int) -> str:
    return f"CASE WHEN NOT isnan({c}) AND {c} BETWEEN {lo} AND {hi} THEN CAST(floor(least({c}, {most}.0) / {width}) AS INT) END"


_UNK = f"CASE WHEN coalesce({_TRIM.format(c='cancer_type')}, '') IN ('', 'nan', 'NA') THEN 'Unknown' ELSE {_TRIM.format(c='cancer_type')} END"
_CODED = f"""{_FEATURES},
cd AS (SELECT p.row_id, os_time AS time, os_event AS event, {_UNK} AS cancer_type, CASE WHEN coalesce(stage, '') LIKE '%4%' OR upper(coalesce(stage, '')) LIKE '%IV%' THEN 'Stage IV' WHEN {_TRIM.format(c="coalesce(stage, '')")} IN ('', 'nan', 'NA', 'Unknown') THEN NULL ELSE 'Stage I-III' END AS stage_group,
  stage, prior_treatment_to_msk, sex, race, ethnicity, sample_type, primary_site, smoking_history, msi_type, gene_panel, {_band('age', 0, 150, 10, 150)} AS age_band, {_band('tmb', 0, 500, 5, 50)} AS tmb_band, {_band('tumor_purity', 1, 100, 20, 100)} AS purity_band,
  least(len(tx), 5) AS n_tx, least(len(genes) // 3, 5) AS genes_band, CAST(least(kg_num_gene_nodes, 10) AS INT) AS kg_genes, CAST(kg_cancer_treatment_min_dist AS INT) AS kg_treatment, CAST(kg_cancer_gene_min_dist AS INT) AS kg_gene, CAST(kg_disease_or_site_gene_min_dist AS INT) AS kg_near
  FROM pat p JOIN ft ON ft.id = p.row_id),
ds AS (SELECT *, 'all_cancers' AS dataset FROM cd UNION ALL SELECT *, cancer_type FROM cd UNION ALL SELECT *, cancer_type || ' - ' || stage_group FROM cd WHERE stage_group IS NOT NULL),
ok AS (SELECT dataset, greatest(2, least(5, sum(event), count(*) - sum(event))) AS k FROM ds GROUP BY 1 HAVING count(*) >= 20 AND least(sum(event), count(*) - sum(event)) >= 2),
fo AS (SELECT ds.*, CAST((row_number() OVER (PARTITION BY ds.dataset, event ORDER BY md5(row_id || ':42'), row_id) - 1) % k AS INT) AS fold FROM ds JOIN ok ON ok.dataset = ds.dataset)"""
_METRICS = f"""{_CODED},
lg AS ({' UNION ALL '.join(f"SELECT dataset, fold, row_id, time, event, '{g}' AS grp, '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '?') AS value FROM fo" for g, cs in GROUPS.items() for c in cs)}),
ra AS (SELECT dataset, fold, (sum(e) OVER (PARTITION BY dataset) - e) / (sum(t) OVER (PARTITION BY dataset) - t) AS rate FROM (SELECT dataset, fold, sum(event) AS e, sum(time) AS t FROM fo GROUP BY 1, 2)),
pv AS (SELECT dataset, grp, feature, value, fold, sum(e) OVER w - e AS e, sum(t) OVER w - t AS t FROM (SELECT dataset, grp, feature, value, fold, sum(event) AS e, sum(time) AS t FROM lg GROUP BY ALL) WINDOW w AS (PARTITION BY dataset, grp, feature, value)),
wt AS (SELECT pv.*, CASE WHEN rate > 0 THEN ln((e + 1) / (t + 1 / rate) / rate) ELSE 0.0 END AS w FROM pv JOIN ra USING (dataset, fold)),
sc AS (SELECT dataset, fold, row_id, any_value(time) AS time, any_value(event) AS event, {', '.join(f"round(sum(CASE WHEN grp IN ({', '.join(repr(g) for g in ('clinical', *more))}) THEN w ELSE 0.0 END), 6) AS {m}" for m, more in A.MODELS.items())} FROM lg JOIN wt USING (dataset, grp, feature, value, fold) GROUP BY 1, 2, 3),
rk AS ({' UNION ALL '.join(f"SELECT dataset, fold, row_id, time, event, '{m}' AS model, {m} AS risk FROM sc" for m in A.MODELS)}),
cx AS (SELECT i.dataset, i.fold, i.model, count(*) FILTER (WHERE j.risk < i.risk) AS concordant, count(*) FILTER (WHERE j.risk = i.risk) AS tied, count(*) AS comparable FROM rk i JOIN rk j ON i.dataset = j.dataset AND i.fold = j.fold AND i.model = j.model AND i.event = 1 AND (j.time > i.time OR (j.time = i.time AND j.event = 0)) GROUP BY 1, 2, 3),
fm AS (SELECT n.dataset, n.fold, n.model, n_test, coalesce(concordant, 0) AS concordant, coalesce(tied, 0) AS tied, coalesce(comparable, 0) AS comparable, (concordant + tied / 2) / comparable AS c_index FROM (SELECT dataset, fold, model, count(*) AS n_test FROM rk GROUP BY 1, 2, 3) n LEFT JOIN cx ON cx.dataset = n.dataset AND cx.fold = n.fold AND cx.model = n.model)"""

ORACLE = {
    "cohort_kg_features": _FEATURES + " SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUND else c for c in K.FEATURES) + " FROM ft",
    "cohort_kg_diagnostics": _DIAG + " SELECT * REPLACE (round(kg_treatment_mapping_rate, 6) AS kg_treatment_mapping_rate, round(kg_gene_mapping_rate, 6) AS kg_gene_mapping_rate) FROM dg",
    "kg_diagnostics_summary": _DIAG
    + """ SELECT count(*) AS n_patients, round(avg(kg_has_disease_mapping), 6) AS disease_mapping_patient_rate, round(avg(kg_has_anatomy_mapping), 6) AS anatomy_mapping_patient_rate, round(avg(kg_treatment_mapping_rate), 6) AS treatment_mapping_rate_nonempty, round(avg(kg_gene_mapping_rate), 6) AS gene_mapping_rate_nonempty,
count(*) FILTER (WHERE kg_total_treatments > 0) AS patients_with_any_treatment, count(*) FILTER (WHERE kg_total_genes > 0) AS patients_with_any_gene, count(*) FILTER (WHERE kg_total_treatments > kg_mapped_treatments) AS patients_with_unmapped_treatments, count(*) FILTER (WHERE kg_total_genes > kg_mapped_genes) AS patients_with_unmapped_genes FROM dg""",
    "ablation_folds": _CODED + " SELECT dataset, row_id, fold FROM fo",
    "ablation_fold_metrics": _METRICS + " SELECT dataset, fold, model, n_test, concordant, tied, comparable, round(c_index, 6) AS c_index FROM fm",
    "ablation_summary": _METRICS + " SELECT model, round(avg(c_index), 6) AS c_index_mean, round(stddev_samp(c_index), 6) AS c_index_std FROM fm WHERE dataset = 'all_cancers' GROUP BY 1",
    "ablation_by_dataset": _METRICS + " SELECT dataset, model, round(avg(c_index), 6) AS c_index_mean, round(stddev_samp(c_index), 6) AS c_index_std FROM fm GROUP BY 1, 2",
    "paired_t_test": _METRICS
    + """, pr AS (SELECT dataset, fold, max(c_index) FILTER (WHERE model = 'clinical_only') AS a, max(c_index) FILTER (WHERE model = 'clinical_treatment_molecular_kg') AS b FROM fm WHERE model IN ('clinical_only', 'clinical_treatment_molecular_kg') GROUP BY 1, 2),
ps AS (SELECT dataset, count(*) AS n, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS odd, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM pr GROUP BY 1),
tt AS (SELECT dataset, n, CASE WHEN odd = 0 AND n > 1 AND sd > 1e-12 THEN m / (sd / sqrt(n)) END AS t FROM ps), th AS (SELECT *, atan(abs(t) / sqrt(n - 1)) AS a FROM tt)
SELECT dataset, n, round(t, 6) AS t, round(1 - CASE n WHEN 2 THEN 2 / pi() * a WHEN 3 THEN sin(a) WHEN 4 THEN 2 / pi() * (a + sin(a) * cos(a)) WHEN 5 THEN sin(a) * (1 + cos(a) * cos(a) / 2) END, 6) AS p FROM th""",
    "oof_stage_slices": _CODED
    + """, top AS (SELECT cancer_type FROM fo WHERE dataset = 'all_cancers' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), st AS (SELECT * FROM (VALUES ('Stage I-III', 'stage_i_iii'), ('Stage IV', 'stage_iv')) v(stage_group, st)),
sl AS (SELECT *, regexp_replace(regexp_replace(lower(cancer_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM fo WHERE cancer_type IN (SELECT cancer_type FROM top))
SELECT slice, count(*) AS rows FROM (SELECT c || '_oof_predictions_all_models' AS slice FROM sl UNION ALL SELECT c || '_main_dataset_oof_predictions' FROM sl WHERE dataset = cancer_type
UNION ALL SELECT c || '_' || st || '_oof_predictions_all_models' FROM sl JOIN st USING (stage_group) UNION ALL SELECT c || '_' || st || '_main_dataset_oof_predictions' FROM sl JOIN st USING (stage_group) WHERE dataset = cancer_type || ' - ' || stage_group) GROUP BY 1""",
}
