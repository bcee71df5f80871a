"""Text, retrieval and answer-scoring queries over documents, embeddings and step_03, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import jsonx as J
from trellis.functions.text import CLEANING_SHORT, clean_text, count_label, singularize, tokens
from trellis.operators import evidence as E
from trellis.operators import retrieval as R
from trellis.plans.views import fuzzy_sql
from trellis.session import cut, table

CONCEPTS = ("tumor", "weight loss", "overall survival", "side effects", "blood sample", "daily", "no difference between", "marker of")
KEYWORDS = ("cardiac", "heart", "artery", "vein")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def concepts(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(c,) for c in CONCEPTS], "concept string")


def table_concepts(s: SparkSession, d: str) -> DataFrame:
    """Every canonical term and every subject and object of step_03."""
    t = table(s, d, "step_03")
    names = t.select(F.col("s").alias("concept")).unionByName(t.select(F.col("o").alias("concept")))  # either column is read alone and made distinct where it lies
    return names.unionByName(table(s, d, "canonical_terms").select(F.col("term").alias("concept"))).where("concept IS NOT NULL").distinct()


def terms(s: SparkSession, d: str) -> DataFrame:
    return E.term_counts(docs(s, d), "doc_id", "source", "text")


def topic_terms(s: SparkSession, d: str) -> DataFrame:
    """1-3-grams of words of at least two characters, without stop words, that at least two documents hold."""
    return cut(E.term_counts(docs(s, d), "doc_id", "source", "text", 1, 3, E.STOP_WORDS, 2, 2))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def nearest(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all."""
    v = vectors(s, d)
    return R.top_cosine(v.where("id % 50 = 0"), v, 5).select("query_id", "vec_id", "score", "rank")


def label_hits(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    x = nearest(s, d).where("query_id <> vec_id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("want")), "query_id").join(v.select(F.col("id").alias("vec_id"), F.col("label").alias("got")), "vec_id")
    return R.hit_rate(x.withColumn("ok", F.col("want") == F.col("got")), "want", "ok").withColumn("rate", F.round("rate", 6))


def path_hits(s: SparkSession, d: str) -> DataFrame:
    """A triple's text as an answer, its three parts as the path."""
    t = table(s, d, "step_03").where("s IS NOT NULL AND o IS NOT NULL").select("id", F.array("s", "p", "o").alias("path"), F.concat_ws(" -> ", "s", "p", "o").alias("answer"))
    return t.select("id", R.middle_hits(F.col("answer"), F.col("path")).alias("h")).select("id", "h.hits", "h.needed", "h.success")


def answers(s: SparkSession, d: str) -> DataFrame:
    """Triples as a model would write them: in a fence, one list per document origin."""
    t = table(s, d, "step_03").where("s IS NOT NULL AND o IS NOT NULL").select("id", F.struct("s", "p", "o").alias("t"))
    return t.select("id", F.concat(F.lit("Here it is:\n```json\n["), F.to_json("t"), F.lit(", {\"s\": \"cut")).alias("answer"))


def aligned(s: SparkSession, d: str) -> DataFrame:
    ref = table(s, d, "canonical_terms").where("field_name = 'primary_site'").select(F.col("term").alias("entity"))
    return R.align(table(s, d, "msk_chord_patient_level").select(F.trim("primary_site").alias("mention")).where("mention <> ''"), ref)


QUERIES = {
    "docs_clean": lambda s, d: docs(s, d).select("doc_id", F.md5(clean_text(F.col("text"))).alias("digest")),
    "docs_clean_short": lambda s, d: docs(s, d).select("doc_id", F.md5(clean_text(F.col("text"), CLEANING_SHORT)).alias("digest")),
    "docs_singular_titles": lambda s, d: docs(s, d).select("doc_id", singularize(F.lower("title")).alias("title")),
    "docs_min_length": lambda s, d: docs(s, d).where(F.length("text") >= 10).select("doc_id"),
    "docs_min_words": lambda s, d: docs(s, d).where(F.size(tokens(F.col("text"))) >= 3).select("doc_id"),
    "docs_domain_filter": lambda s, d: docs(s, d).where(E.domain_filter(F.col("text"), KEYWORDS)).select("doc_id", "source"),
    "docs_source_stats": lambda s, d: docs(s, d).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest")),
    "docs_term_counts": lambda s, d: terms(s, d).where("n >= 20"),
    "docs_ctfidf_topk": lambda s, d: E.ctfidf(terms(s, d), 10).select("class", "term", F.round("weight", 6).alias("weight")),
    "docs_ctfidf_boosted": lambda s, d: E.boosted(E.class_weights(topic_terms(s, d)), table(s, d, "canonical_terms").select("term"), 0.5, 5).select("class", "term", F.round("weight", 6).alias("weight")),
    "concept_frequent": lambda s, d: E.frequent_concepts(docs(s, d), "text", 100, 1, 3),
    "concept_ids": lambda s, d: E.concept_ids(table(s, d, "step_03").where("s IS NOT NULL").select(F.col("s").alias("concept"))),
    "concept_evidence_top3": lambda s, d: E.evidence(table_concepts(s, d), docs(s, d), "doc_id", "text", 3),
    "concept_evidence_all": lambda s, d: E.evidence(table_concepts(s, d), docs(s, d), "doc_id", "text", None).groupBy("concept").agg(F.count(F.lit(1)).alias("docs")),
    "concept_gold_labels": lambda s, d: E.gold_labels(concepts(s, d), table(s, d, "canonical_terms").select(F.col("term").alias("concept"))),
    "vec_topk_cosine": nearest,
    "vec_label_hits": label_hits,
    "task_hit_rate": path_hits,
    "json_rescue": lambda s, d: J.triples_of(answers(s, d), "answer", "id"),
    "align_fuzzy_topk": aligned,
    "count_labels": lambda s, d: docs(s, d).groupBy("source").agg(F.sum("n_chars").alias("chars")).select("source", count_label(F.col("chars")).alias("label")),
}

_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+'), lambda w: w <> '')"
_W = _WORDS.format(c="text")
_TERMS = f"terms AS (SELECT source AS class, term, count(*) AS n FROM (SELECT source, unnest({_W}) AS term FROM documents) WHERE class IS NOT NULL GROUP BY 1, 2)"
_WEIGHTS = "c AS (SELECT class, sum(n) AS words FROM terms GROUP BY 1), m AS (SELECT floor(avg(words)) AS a FROM c), f AS (SELECT term, sum(n) AS f FROM terms GROUP BY 1), w AS (SELECT class, term, round(n / words * ln(1 + a / f), 9) AS weight FROM terms JOIN c USING (class) JOIN f USING (term), m)"
_IDF = f"WITH {_TERMS}, {_WEIGHTS}"
_STOPS = ", ".join(f"'{w}'" for w in sorted(E.STOP_WORDS))
_GRAMS = "SELECT {k}, unnest(w) AS term FROM d UNION ALL SELECT {k}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d UNION ALL SELECT {k}, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d"
_TOPIC = f"""WITH d AS (SELECT source AS class, doc_id, list_filter({_W}, lambda w: length(w) >= 2 AND w NOT IN ({_STOPS})) AS w FROM documents WHERE source IS NOT NULL),
g AS ({_GRAMS.format(k='class, doc_id')}), kept AS (SELECT term FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
terms AS (SELECT class, term, count(*) AS n FROM g WHERE term IN (SELECT term FROM kept) GROUP BY ALL), {_WEIGHTS}"""
_C = ", ".join(f"('{c}')" for c in CONCEPTS)
_FOUND = f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_W}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT concept, ' ' || array_to_string({_WORDS.format(c='concept')}, ' ') || ' ' AS phrase FROM (SELECT s AS concept FROM step_03 UNION SELECT o FROM step_03 UNION SELECT term FROM canonical_terms) WHERE concept IS NOT NULL),
met AS (SELECT concept, doc_id FROM c JOIN d ON contains(t, phrase) WHERE trim(phrase) <> '')"""

ORACLE = {
    "docs_min_length": "SELECT doc_id FROM documents WHERE length(text) >= 10",
    "docs_min_words": "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[\\t-\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> '')) >= 3",
    "docs_domain_filter": f"SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '{'|'.join(KEYWORDS)}')",
    "docs_source_stats": "SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY ALL",
    "docs_term_counts": f"WITH {_TERMS} SELECT * FROM terms WHERE n >= 20",
    "docs_ctfidf_topk": _IDF + " SELECT class, term, round(weight, 6) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY class ORDER BY w.weight DESC, term) <= 10",
    "docs_ctfidf_boosted": _TOPIC
    + ", b AS (SELECT class, term, round(weight + CASE WHEN term IN (SELECT lower(trim(term)) FROM canonical_terms) THEN 0.5 ELSE 0 END, 9) AS weight FROM w) SELECT class, term, round(weight, 6) AS weight FROM b QUALIFY row_number() OVER (PARTITION BY class ORDER BY b.weight DESC, term) <= 5",
    "concept_frequent": f"WITH d AS (SELECT 1 AS k, list_filter({_W}, lambda w: length(w) >= 4) AS w FROM documents), g AS ({_GRAMS.format(k='k')}) SELECT term AS concept, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, concept LIMIT 100",
    "concept_ids": "SELECT concept, row_number() OVER (ORDER BY concept) AS id FROM (SELECT DISTINCT s AS concept FROM step_03 WHERE s IS NOT NULL)",
    "concept_evidence_top3": _FOUND + " SELECT concept, doc_id AS doc, row_number() OVER (PARTITION BY concept ORDER BY doc_id) AS rank FROM met QUALIFY rank <= 3",
    "concept_evidence_all": _FOUND + " SELECT concept, count(*) AS docs FROM met GROUP BY 1",
    "concept_gold_labels": f"WITH g AS (SELECT DISTINCT lower(trim(term)) AS concept FROM canonical_terms) SELECT concept, CAST(concept IN (SELECT concept FROM g) AS INT) AS label FROM (SELECT concept FROM (VALUES {_C}) c(concept) UNION SELECT concept FROM g)",
    "vec_topk_cosine": "SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0) WHERE rank <= 5",
    "task_hit_rate": "SELECT id, CASE WHEN contains(lower(s || ' -> ' || p || ' -> ' || o), lower(p)) THEN 1 ELSE 0 END AS hits, 1 AS needed, true AS success FROM step_03 WHERE s IS NOT NULL AND o IS NOT NULL",
    "json_rescue": "SELECT id, s, p, o FROM step_03 WHERE s <> '' AND p <> '' AND o <> ''",
    "vec_label_hits": "WITH r AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, q.label AS want, v.label AS got, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0) WHERE rank <= 5 AND query_id <> vec_id) SELECT want, count(*) AS n, count(*) FILTER (WHERE want = got) AS hits, round(avg((want = got)::INT), 6) AS rate FROM r GROUP BY 1",
    "align_fuzzy_topk": f"""WITH ent AS (SELECT DISTINCT term AS entity FROM canonical_terms WHERE field_name = 'primary_site'), ment AS (SELECT DISTINCT trim(primary_site, ' ') AS mention FROM msk_chord_patient_level WHERE trim(primary_site, ' ') <> ''),
ex AS (SELECT mention, min(entity) AS entity FROM ment JOIN ent ON lower(trim(mention, ' ')) = lower(trim(entity, ' ')) GROUP BY 1), rest AS (SELECT mention FROM ment WHERE mention NOT IN (SELECT mention FROM ex)), {fuzzy_sql('rest', 'ent', 60)}
SELECT mention, entity, 'exact' AS how FROM ex UNION ALL SELECT r.mention, CASE WHEN score >= 80 THEN f.entity END, CASE WHEN score >= 80 THEN 'fuzzy' WHEN score IS NOT NULL THEN 'ask' ELSE 'new' END FROM rest r LEFT JOIN (SELECT * FROM fuzzy WHERE rank = 1) f ON f.mention = r.mention""",
    "count_labels": "SELECT source, CASE WHEN n >= 1000000 THEN format('{:,.2f}M', n / 1000000) WHEN n >= 1000 THEN format('{:,.1f}K', n / 1000) ELSE n::VARCHAR END AS label FROM (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1)",
}
