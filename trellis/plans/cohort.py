"""Cohort, feature and survival queries over the clinical tables, and their SQL.

Out-of-fold predictions are derived from msk_chord_patient_level: a risk per row for two models, the fold from the row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import cohort as C
from trellis.operators import survival as V
from trellis.operators.ranking import hash_sample, stratified_folds
from trellis.session import cut, table


def level(s: SparkSession, d: str) -> DataFrame:
    return C.patient_level(table(s, d, "data_clinical_patient"), table(s, d, "data_clinical_sample"), table(s, d, "data_mutations"), table(s, d, "data_timeline_treatment"))


def strict(s: SparkSession, d: str) -> DataFrame:
    return C.strict_cohort(level(s, d), C.sample_ambiguity(table(s, d, "data_clinical_sample")))


def oof(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "msk_chord_patient_level").where("os_time IS NOT NULL AND os_event IS NOT NULL AND os_time > 0")
    age, four = F.coalesce("age", F.lit(60.0)), (F.col("stage") == "Stage 4").cast("double")
    risk = F.round(age / 100 + F.coalesce(four, F.lit(0.0)), 4)
    m = m.select("row_id", "patient_id", C.unknown(F.col("cancer_type")).alias("cancer_type"), C.unknown(F.col("stage")).alias("stage"), "os_time", "os_event", (F.col("row_id") % 5).cast("int").alias("fold"), risk.alias("risk"), F.coalesce((F.col("sample_type") == "Metastasis").cast("double"), F.lit(0.0)).alias("met"))
    models = F.explode(F.array(F.struct(F.lit("clinical_only").alias("model"), F.col("risk").alias("risk_score")), F.struct(F.lit("clinical_molecular").alias("model"), F.round(F.col("risk") * 0.5 + F.col("met"), 4).alias("risk_score"))))
    return m.select("row_id", "patient_id", "cancer_type", "stage", "os_time", "os_event", "fold", models.alias("m")).select("row_id", "patient_id", "cancer_type", "stage", "os_time", "os_event", "fold", "m.model", "m.risk_score")


NUMBERS = ("age", "tmb", "tumor_purity", "os_time")


def multi_hot_agents(s: SparkSession, d: str) -> DataFrame:
    m = cut(table(s, d, "msk_chord_patient_level").select("row_id", "treatments"))
    vocabulary = [r["item"] for r in C.top_items(m, "treatments", 5).collect()]  # five items
    return C.multi_hot(m, "row_id", "treatments", vocabulary, "tx")


def risk_groups(s: SparkSession, d: str) -> DataFrame:
    x = oof(s, d).where("model = 'clinical_only'")
    return V.quantile_groups(C.first_per(x, ["patient_id", "model"], ["fold", "row_id"]), ["model"], "risk_score")


def log_rank(s: SparkSession, d: str) -> DataFrame:
    chi2, k, p = V.log_rank(cut(risk_groups(s, d)), "quartile", "os_time", "os_event")
    return s.createDataFrame([(round(chi2, 6), k, round(p, 9))], "chi2 double, df int, p double")


def dynamic_auc(s: SparkSession, d: str) -> DataFrame:
    x = cut(oof(s, d).where("model = 'clinical_only'"))
    return V.dynamic_auc(x, "os_time", "os_event", "risk_score", V.eval_times(x, "os_time", "os_event")).select(F.round("time", 4).alias("time"), F.round("auc", 6).alias("auc"))


def eval_times(s: SparkSession, d: str) -> DataFrame:
    x = cut(oof(s, d).where("model = 'clinical_only'"))
    return s.createDataFrame([(float(round(t, 4)),) for t in V.eval_times(x, "os_time", "os_event")], "time double")


QUERIES = {
    "cohort_index_sample": lambda s, d: C.index_sample(table(s, d, "data_clinical_sample")).select("patient_id", "sample_id", "sample_type", "gene_panel"),
    "cohort_treatment_lists": lambda s, d: C.list_per(table(s, d, "data_timeline_treatment"), "patient_id", "agent", "treatments").select("patient_id", "num_treatments"),
    "cohort_gene_lists": lambda s, d: C.list_per(C.mutated_genes(table(s, d, "data_mutations"), table(s, d, "data_clinical_sample")), "patient_id", "hugo_symbol", "altered_genes").select("patient_id", "num_altered_genes", "altered_genes"),
    "cohort_ambiguity": lambda s, d: C.sample_ambiguity(table(s, d, "data_clinical_sample")),
    "cohort_patient_level": lambda s, d: level(s, d).select("patient_id", "os_time", "os_event", "age", "sample_id", "num_treatments", "num_altered_genes"),
    "cohort_strict": lambda s, d: strict(s, d).select("patient_id", "os_time", "os_event", "age", "cancer_type", "stage_is_4", "had_prior_treatment", "missing_tmb"),
    "cohort_qc": lambda s, d: C.cohort_qc(level(s, d), cut(strict(s, d).select("os_time", "os_event"))).select("patients", "kept", "dropped", F.round("event_rate", 6).alias("event_rate"), F.round("median_os", 6).alias("median_os")),
    "cohort_top_cancers": lambda s, d: strict(s, d).groupBy("cancer_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cancer_type").limit(10),
    "feat_distribution": lambda s, d: C.feature_distribution(table(s, d, "msk_chord_patient_level"), NUMBERS).select("feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max", "share_zero")], "n_unique"),
    "feat_top_items": lambda s, d: C.top_items(table(s, d, "msk_chord_patient_level"), "treatments", 20),
    "feat_topk_multihot": multi_hot_agents,
    "feat_one_hot": lambda s, d: C.one_hot(table(s, d, "msk_chord_patient_level"), "row_id", "stage", ["Stage 1-3", "Stage 4"]),
    "feat_median_impute": lambda s, d: C.impute_by_fold(table(s, d, "msk_chord_patient_level").select("row_id", (F.col("row_id") % 5).cast("int").alias("fold"), "tmb", "tumor_purity"), "fold", ["tmb", "tumor_purity"], range(5)).select("row_id", "test_fold", "part", "tmb", "tumor_purity"),
    "oof_first_fold": lambda s, d: C.first_per(oof(s, d), ["patient_id", "model"], ["fold", "row_id"]).select("patient_id", "model", "fold", "risk_score"),
    "oof_risk_quartiles": lambda s, d: risk_groups(s, d).select("patient_id", "risk_score", F.col("quartile").cast("int").alias("quartile")),
    "oof_high_risk_patients": lambda s, d: risk_groups(s, d).where("quartile = 4").orderBy(F.desc("risk_score"), "row_id").limit(20).select("patient_id", "risk_score"),
    "km_curve": lambda s, d: V.kaplan_meier(risk_groups(s, d), ["quartile"], "os_time", "os_event").select(F.col("quartile").cast("int").alias("quartile"), "time", "at_risk", "events", F.round("survival", 6).alias("survival")),
    "c_index": lambda s, d: V.concordance(oof(s, d).where("model = 'clinical_only'"), "os_time", "os_event", "risk_score").withColumn("c_index", F.round("c_index", 6)),
    "eval_times": eval_times,
    "dataset_specs": lambda s, d: V.dataset_specs(oof(s, d).where("model = 'clinical_only'"), "cancer_type", "stage", "os_event"),
    "stratified_folds": lambda s, d: stratified_folds(table(s, d, "msk_chord_patient_level").where("os_event IS NOT NULL").select("row_id", "os_event"), "os_event", "row_id", 5),
    "log_rank": log_rank,
    "dynamic_auc": dynamic_auc,
    "hash_sample": lambda s, d: hash_sample(table(s, d, "step_03").select("id", "s", "p", "o"), "id", 100),
}


def _f(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'), '')"


_UNK = "CASE WHEN {f} IS NULL OR {f} IN ('nan', 'NA') THEN 'Unknown' ELSE {f} END"
_IDX = f"idx AS (SELECT * FROM (SELECT {_f('patient_id')} AS pid, *, row_number() OVER (PARTITION BY {_f('patient_id')} ORDER BY CASE lower({_f('sample_type')}) WHEN 'primary' THEN 0 WHEN 'metastasis' THEN 1 ELSE 2 END, {_f('sample_id')} NULLS FIRST, row_id) AS i FROM data_clinical_sample) WHERE i = 1 AND pid IS NOT NULL)"
_TX = f"tx AS (SELECT pid, count(DISTINCT v) AS n FROM (SELECT {_f('patient_id')} AS pid, {_f('agent')} AS v FROM data_timeline_treatment) WHERE pid IS NOT NULL AND v IS NOT NULL GROUP BY 1)"
_GN = f"own AS (SELECT {_f('sample_id')} AS sample, min({_f('patient_id')}) AS pid FROM data_clinical_sample WHERE {_f('sample_id')} IS NOT NULL AND {_f('patient_id')} IS NOT NULL GROUP BY 1), gn AS (SELECT pid, count(DISTINCT v) AS n, string_agg(DISTINCT v, '\",\"' ORDER BY v) AS vs FROM (SELECT own.pid, {_f('hugo_symbol')} AS v FROM data_mutations m JOIN own ON {_f('tumor_sample_barcode')} = own.sample) WHERE v IS NOT NULL GROUP BY 1)"
_AMB = f"amb AS (SELECT {_f('patient_id')} AS patient_id, count(DISTINCT {_f('sample_id')}) AS n_samples, count(DISTINCT {_f('cancer_type')}) AS n_cancer_types, count(DISTINCT {_f('cancer_type_detailed')}) AS n_detailed, count(DISTINCT {_f('primary_site')}) AS n_sites FROM data_clinical_sample WHERE {_f('patient_id')} IS NOT NULL GROUP BY 1), ambiguity AS (SELECT *, n_cancer_types > 1 AS multi_cancer FROM amb WHERE n_samples + n_cancer_types + n_detailed + n_sites > 0)"
_LEVEL = f"""WITH {_IDX}, {_TX}, {_GN}, {_AMB},
p AS (SELECT * FROM (SELECT {_f('patient_id')} AS pid, *, row_number() OVER (PARTITION BY {_f('patient_id')} ORDER BY loaded_at, row_id) AS i FROM data_clinical_patient) WHERE i = 1 AND pid IS NOT NULL),
lvl AS (SELECT p.pid AS patient_id, TRY_CAST(os_months AS DOUBLE) AS os_time, CASE WHEN trim(coalesce(os_status, '')) LIKE '1%' THEN 1 WHEN trim(coalesce(os_status, '')) LIKE '0%' THEN 0 END AS os_event, TRY_CAST(current_age_deid AS DOUBLE) AS age, stage_highest_recorded AS stage, prior_med_to_msk AS prior,
  idx.sample_id, idx.cancer_type, idx.tmb_nonsynonymous, coalesce(tx.n, 0) AS num_treatments, coalesce(gn.n, 0) AS num_altered_genes FROM p LEFT JOIN idx ON idx.pid = p.pid LEFT JOIN tx ON tx.pid = p.pid LEFT JOIN gn ON gn.pid = p.pid),
strict AS (SELECT lvl.*, {_UNK.format(f=_f('cancer_type'))} AS ct FROM lvl JOIN ambiguity a ON a.patient_id = lvl.patient_id WHERE os_time > 0 AND age IS NOT NULL AND {_UNK.format(f=_f('cancer_type'))} <> 'Unknown' AND NOT multi_cancer)
"""
_OOF = f"""WITH o0 AS (SELECT row_id, patient_id, {_UNK.format(f=_f('cancer_type'))} AS cancer_type, {_UNK.format(f=_f('stage'))} AS stage, os_time, os_event, CAST(row_id % 5 AS INT) AS fold, round(coalesce(age, 60.0) / 100 + CASE WHEN stage = 'Stage 4' THEN 1.0 ELSE 0.0 END, 4) AS risk, CASE WHEN sample_type = 'Metastasis' THEN 1.0 ELSE 0.0 END AS met FROM msk_chord_patient_level WHERE os_time > 0 AND os_event IS NOT NULL),
oof AS (SELECT * EXCLUDE (risk, met), 'clinical_only' AS model, risk AS risk_score FROM o0 UNION ALL SELECT * EXCLUDE (risk, met), 'clinical_molecular', round(risk * 0.5 + met, 4) FROM o0),
one AS (SELECT * FROM oof WHERE model = 'clinical_only'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, model ORDER BY fold, row_id) AS i FROM oof) WHERE i = 1),
ed AS (SELECT quantile_cont(risk_score, 0.25) AS a, quantile_cont(risk_score, 0.5) AS b, quantile_cont(risk_score, 0.75) AS c FROM firsts WHERE model = 'clinical_only'),
grp AS (SELECT f.*, CAST(1 + (risk_score > a)::INT + (risk_score > b AND b > a)::INT + (risk_score > c AND c > b)::INT AS INT) AS quartile FROM firsts f, ed WHERE model = 'clinical_only')
"""
_LONG = "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM msk_chord_patient_level WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in NUMBERS) + ")"
_ITEMS = f"items AS (SELECT row_id, coalesce({_f('item0')}, '') AS item FROM (SELECT row_id, unnest(from_json(treatments, '[\"VARCHAR\"]')) AS item0 FROM msk_chord_patient_level))"

ORACLE = {
    "cohort_index_sample": f"WITH {_IDX} SELECT pid AS patient_id, sample_id, sample_type, gene_panel FROM idx",
    "cohort_treatment_lists": f"WITH {_TX} SELECT pid AS patient_id, n AS num_treatments FROM tx",
    "cohort_gene_lists": f"WITH {_GN} SELECT pid AS patient_id, n AS num_altered_genes, '[\"' || vs || '\"]' AS altered_genes FROM gn",
    "cohort_ambiguity": f"WITH {_AMB} SELECT * FROM ambiguity",
    "cohort_patient_level": _LEVEL + "SELECT patient_id, os_time, os_event, age, sample_id, num_treatments, num_altered_genes FROM lvl",
    "cohort_strict": _LEVEL + "SELECT patient_id, os_time, os_event, age, ct AS cancer_type, CAST(coalesce(stage, '') LIKE '%4%' AS INT) AS stage_is_4, CAST(coalesce(prior, '') ILIKE '%prior medications%' AS INT) AS had_prior_treatment, CAST(TRY_CAST(tmb_nonsynonymous AS DOUBLE) IS NULL AS INT) AS missing_tmb FROM strict",
    "cohort_qc": _LEVEL + "SELECT (SELECT count(*) FROM lvl) AS patients, count(*) AS kept, (SELECT count(*) FROM lvl) - count(*) AS dropped, round(avg(os_event), 6) AS event_rate, round(quantile_cont(os_time, 0.5), 6) AS median_os FROM strict",
    "cohort_top_cancers": _LEVEL + "SELECT ct AS cancer_type, count(*) AS n FROM strict GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "feat_distribution": _LONG
    + "SELECT feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_zero, count(DISTINCT v) AS n_unique FROM x GROUP BY 1",
    "feat_top_items": f"WITH {_ITEMS} SELECT item, count(*) AS n FROM items WHERE item <> '' GROUP BY 1 ORDER BY n DESC, item LIMIT 20",
    "feat_topk_multihot": f"WITH {_ITEMS}, top AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) - 1 AS i FROM items WHERE item <> '' GROUP BY item QUALIFY i < 5) SELECT m.row_id, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE i = {i}) > 0 AS INT) AS tx_{i}" for i in range(5))
    + " FROM msk_chord_patient_level m LEFT JOIN items ON items.row_id = m.row_id LEFT JOIN top USING (item) GROUP BY 1",
    "feat_one_hot": "SELECT row_id, CASE WHEN stage = 'Stage 1-3' THEN 1 ELSE 0 END AS stage_0, CASE WHEN stage = 'Stage 4' THEN 1 ELSE 0 END AS stage_1 FROM msk_chord_patient_level",
    "feat_median_impute": """WITH e AS (SELECT row_id, CASE WHEN isnan(tmb) THEN NULL ELSE tmb END AS tmb, CASE WHEN isnan(tumor_purity) THEN NULL ELSE tumor_purity END AS tumor_purity, f AS test_fold, CASE WHEN row_id % 5 = f THEN 'test' ELSE 'train' END AS part FROM msk_chord_patient_level, (SELECT unnest([0, 1, 2, 3, 4]) AS f)),
m AS (SELECT test_fold, quantile_cont(tmb, 0.5) AS a, quantile_cont(tumor_purity, 0.5) AS b FROM e WHERE part = 'train' GROUP BY 1)
SELECT row_id, test_fold, part, coalesce(tmb, a, 0.0) AS tmb, coalesce(tumor_purity, b, 0.0) AS tumor_purity FROM e LEFT JOIN m USING (test_fold)""",
    "oof_first_fold": _OOF + "SELECT patient_id, model, fold, risk_score FROM firsts",
    "oof_risk_quartiles": _OOF + "SELECT patient_id, risk_score, quartile FROM grp",
    "oof_high_risk_patients": _OOF + "SELECT patient_id, risk_score FROM grp WHERE quartile = 4 ORDER BY risk_score DESC, row_id LIMIT 20",
    "km_curve": _OOF
    + ", t AS (SELECT quartile, os_time AS time, count(*) AS n, sum(os_event) AS d FROM grp GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY quartile ORDER BY time DESC) AS at_risk FROM t) SELECT quartile, time, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN max(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY quartile ORDER BY time)",
    "c_index": _OOF
    + "SELECT *, round((concordant + tied / 2) / comparable, 6) AS c_index FROM (SELECT count(*) FILTER (WHERE j.risk_score < i.risk_score) AS concordant, count(*) FILTER (WHERE j.risk_score = i.risk_score) AS tied, count(*) AS comparable FROM one i JOIN one j ON i.os_event = 1 AND (j.os_time > i.os_time OR (j.os_time = i.os_time AND j.os_event = 0)))",
    "eval_times": _OOF
    + "SELECT DISTINCT round(t, 4) AS time FROM (SELECT unnest([quantile_cont(os_time, 0.25), quantile_cont(os_time, 0.5), quantile_cont(os_time, 0.75)]) AS t FROM one WHERE os_event = 1) WHERE t > (SELECT min(os_time) FROM one) AND t < (SELECT max(os_time) FROM one)",
    "stratified_folds": "SELECT row_id, os_event, CAST((row_number() OVER (PARTITION BY os_event ORDER BY md5(row_id || ':42'), row_id) - 1) % 5 AS INT) AS fold FROM msk_chord_patient_level WHERE os_event IS NOT NULL",
    "hash_sample": "SELECT id, s, p, o FROM step_03 ORDER BY md5(id || ':42'), id LIMIT 100",
    "dynamic_auc": _OOF
    + """, q AS (SELECT quantile_cont(os_time, [0.25, 0.5, 0.75]) AS q FROM one WHERE os_event = 1), ins AS (SELECT DISTINCT t FROM (SELECT unnest(q) AS t FROM q) WHERE t > (SELECT min(os_time) FROM one) AND t < (SELECT max(os_time) FROM one)),
tau AS (SELECT t FROM ins UNION SELECT q[2] FROM q WHERE NOT EXISTS (SELECT 1 FROM ins)),
ct AS (SELECT os_time AS t, count(*) AS n, count(*) FILTER (WHERE os_event = 0) AS c FROM one GROUP BY 1), cr AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS r FROM ct),
ck AS (SELECT t, CASE WHEN max(CASE WHEN c = r THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN c < r THEN ln(1 - c / r) ELSE 0 END) OVER w) END AS s FROM cr WINDOW w AS (ORDER BY t)), cg AS (SELECT t, coalesce(lag(s) OVER (ORDER BY t), 1.0) AS g FROM ck),
cs AS (SELECT tau.t AS tau, o.risk_score AS r, 1 / g AS w FROM one o JOIN cg ON cg.t = o.os_time JOIN tau ON o.os_time <= tau.t WHERE os_event = 1 AND g > 0), cn AS (SELECT tau.t AS tau, o.risk_score AS r FROM one o JOIN tau ON o.os_time > tau.t),
ab AS (SELECT c.tau, sum(w * CASE WHEN n.r < c.r THEN 1.0 WHEN n.r = c.r THEN 0.5 ELSE 0.0 END) AS a FROM cs c JOIN cn n ON n.tau = c.tau GROUP BY 1)
SELECT round(tau.t, 4) AS time, round(a / ((SELECT sum(w) FROM cs WHERE cs.tau = tau.t) * (SELECT count(*) FROM cn WHERE cn.tau = tau.t)), 6) AS auc FROM tau LEFT JOIN ab ON ab.tau = tau.t""",
    "dataset_specs": _OOF + "SELECT cancer_type, stage, count(*) AS n, CAST(sum(os_event) AS BIGINT) AS events FROM one GROUP BY GROUPING SETS ((), (cancer_type), (cancer_type, stage)) HAVING count(*) >= 20 AND least(sum(os_event), count(*) - sum(os_event)) >= 2",
}
