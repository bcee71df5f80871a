"""Queries of the pipelines from documents to fused triples and of answer evaluation, with a deterministic stand-in for models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import answers as A
from trellis.operators import kgstats as K
from trellis.operators import merge as M
from trellis.operators import pipeline as P
from trellis.operators import rules as R
from trellis.plans.text import _W, _WORDS
from trellis.plans.triples import _TYPED
from trellis.session import cut, table


def relations(s: SparkSession) -> DataFrame:
    names = [r[0].title().replace("Of", "of") for r in (*R.CONSTANT_RULES, *R.DEFAULT_RULES)]
    return s.createDataFrame([(n, n.replace("-", " ").lower()) for n in names], "relation string, description string")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def ontology(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "canonical_terms").select("term")


def evidence(s: SparkSession, d: str) -> DataFrame:
    """Evidence of the canonical terms; agents are gold."""
    terms = table(s, d, "canonical_terms")
    gold = terms.where("field_name = 'treatments'").select(F.col("term").alias("concept"))
    return P.concept_evidence(terms.select(F.lower("term").alias("concept")), docs(s, d), "doc_id", "text", "origin", gold)


def seeds(s: SparkSession, d: str, v: P.SeedVariant = P.VARIANTS[0]) -> DataFrame:
    return P.seed_concepts(docs(s, d), "doc_id", "source", "text", ontology(s, d), v)


def variants(s: SparkSession, d: str) -> DataFrame:
    """How many concepts each variant finds."""
    out = None
    for v in P.VARIANTS:
        x = seeds(s, d, v).agg(F.count(F.lit(1)).alias("concepts")).select(F.lit(v.name).alias("variant"), "concepts")
        out = x if out is None else out.unionByName(x)
    return out


def candidates(s: SparkSession, d: str) -> DataFrame:
    return P.extract_triples(evidence(s, d), relations(s), P.Stub())


def fused_by_model(s: SparkSession, d: str) -> DataFrame:
    """The documents' candidates and step_03's triples of the same concepts, fused concept by concept by the stand-in."""
    c = cut(candidates(s, d))
    raw = table(s, d, "step_03").select("s", "p", "o", "origins")
    return P.fuse(c.select("s", "p", "o", "origins").unionByName(raw), relations(s), P.Stub(), concepts=c.select("concept"), evidence_of=evidence(s, d))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def graph_evidence(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    facts = v.select("id", "vector", F.concat(F.lit("v"), (F.col("id") % 10).cast("string")).alias("s"), F.lit("has").alias("p"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("o"))
    return A.graph_evidence(v.where("id % 50 = 0").select("id", "vector"), facts, 10)


def neighbour_context(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a mention, three to a case, against the other vectors as nodes with an edge to their label and to the next vector."""
    v = vectors(s, d)
    name = lambda c: F.concat(F.lit("v"), F.lpad(c.cast("string"), 6, "0"))
    mentions = v.where("id % 50 = 0").select(F.floor(F.col("id") / 150).alias("case"), F.col("id").alias("at"), "id", "vector")
    nodes = v.where("id % 50 <> 0").select("id", "vector", name(F.col("id")).alias("node"))
    edges = v.select(name(F.col("id")).alias("src"), F.explode(F.array(F.struct(F.lit("has").alias("relation"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("dst")), F.struct(F.lit("before").alias("relation"), name(F.col("id") + 1).alias("dst")))).alias("e")).select("src", "e.*")
    return A.neighbour_context(mentions, nodes, edges, 0.2, 4)


def alias_answers(s: SparkSession, d: str) -> DataFrame:
    """A term's aliases as an answer, the term as the node that it should name."""
    t = table(s, d, "canonical_terms").select("ref_id", F.array("term").alias("mids"), F.concat_ws("; ", "aliases").alias("answer"), "term")
    return t.withColumn("equal", A.same_answer(F.col("answer"), F.col("term"))).withColumn("named", A.names_target(F.col("answer"), F.col("term"))).drop("term")


def semantic(s: SparkSession, d: str) -> DataFrame:
    x = A.semantic_hits(alias_answers(s, d).select("ref_id", "answer", "mids"), "answer", "mids", P.Stub(), 0.7)
    return x.select("ref_id", "hit.hit", "hit.mid", F.round("hit.score", 6).alias("score"), "hit.chunk")


QUERIES = {
    "pipeline_seeds": seeds,
    "pipeline_variants": variants,
    "pipeline_evidence": lambda s, d: evidence(s, d).select("concept", F.size("abstracts").cast("bigint").alias("docs"), F.array_join("origins", ",").alias("origins"), "label"),
    "pipeline_triples": lambda s, d: candidates(s, d).select("id", "s", "p", "o", "concept", F.array_join("origins", ",").alias("origins")),
    "pipeline_fused": lambda s, d: P.fuse(table(s, d, "step_03"), relations(s)).select("id", "s", "p", "o", F.array_join("origins", ",").alias("origins"), "support"),
    "pipeline_fused_model": lambda s, d: fused_by_model(s, d).select("id", "s", "p", "o", F.array_join("origins", ",").alias("origins"), "support"),
    "rag_graph_evidence": graph_evidence,
    "rag_neighbor_context": neighbour_context,
    "task_answer_match": lambda s, d: alias_answers(s, d).groupBy("equal", "named").agg(F.count(F.lit(1)).alias("n")),
    "task_semantic_hits": semantic,
    "kg_shown_relations": lambda s, d: K.shown_relations(M.typed_edges(table(s, d, "step_03"))),
    "kg_top_pairs": lambda s, d: K.top_pairs_per_relation(M.typed_edges(table(s, d, "step_03"))),
}

_EV = f"""WITH d AS (SELECT doc_id, origin, ' ' || array_to_string({_W}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT DISTINCT lower(term) AS concept, ' ' || array_to_string({_WORDS.format(c='term')}, ' ') || ' ' AS phrase FROM canonical_terms),
met AS (SELECT concept, doc_id, origin FROM c JOIN d ON contains(t, phrase) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY doc_id) <= 3),
ev AS (SELECT concept, count(*) AS docs, coalesce(string_agg(origin, ',' ORDER BY doc_id), '') AS origins FROM met GROUP BY 1),
gold AS (SELECT DISTINCT lower(trim(term, ' ')) AS concept FROM canonical_terms WHERE field_name = 'treatments')"""
_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
_SHOWN = ", ".join(f"'{r}'" for r in R.SHOWN_RELATIONS)
_PAIR = "replace(x_type, '_', ' ') || ' -> ' || replace(y_type, '_', ' ')"
ORACLE = {
    "pipeline_evidence": _EV + " SELECT concept, docs, origins, CAST(concept IN (SELECT concept FROM gold) AS INT) AS label FROM ev UNION ALL SELECT NULL, NULL, NULL, NULL WHERE false",
    "pipeline_triples": _EV + " SELECT row_number() OVER (ORDER BY concept) - 1 AS id, concept AS s, 'Associated-With' AS p, 'finding' AS o, concept, origins FROM ev",
    "pipeline_fused": "WITH t AS (SELECT * FROM step_03 WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL), n AS (SELECT s, p, o, count(*) AS support FROM t GROUP BY ALL), g AS (SELECT s, p, o, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM (SELECT s, p, o, unnest(origins) AS origin FROM t) WHERE origin IS NOT NULL GROUP BY ALL) SELECT row_number() OVER (ORDER BY s, p, o) - 1 AS id, n.s, n.p, n.o, coalesce(origins, '') AS origins, support FROM n LEFT JOIN g USING (s, p, o)",
    "pipeline_fused_model": _EV + ", uo AS (SELECT concept, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM met WHERE origin IS NOT NULL GROUP BY 1) SELECT row_number() OVER (ORDER BY ev.concept) - 1 AS id, ev.concept AS s, 'Associated-With' AS p, 'finding' AS o, coalesce(uo.origins, '') AS origins, 1 AS support FROM ev LEFT JOIN uo USING (concept)",
    "rag_graph_evidence": f"""WITH f AS (SELECT vec_id, embedding, 'v' || (vec_id % 10) AS s, 'L' || label AS o, 'v' || (vec_id % 10) || ' has L' || label AS fact FROM embeddings),
di AS (SELECT q.vec_id AS query_id, v.s, v.o, v.fact FROM embeddings q JOIN f v ON q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) <= 10),
en AS (SELECT query_id, anchor FROM (SELECT query_id, s AS anchor FROM di UNION SELECT query_id, o FROM di) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY anchor) <= 5),
ne AS (SELECT anchor, fact FROM (SELECT s AS anchor, fact FROM f UNION SELECT o, fact FROM f) QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY fact) <= 3)
SELECT DISTINCT query_id, 'direct' AS part, fact FROM di UNION ALL SELECT DISTINCT query_id, 'structural', fact FROM en JOIN ne USING (anchor)""",
    "rag_neighbor_context": f"""WITH b AS (SELECT q.vec_id AS id, v.vec_id AS nid, {_COS} AS sc FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) = 1),
e AS (SELECT vec_id AS nid, 'v' || lpad(vec_id::VARCHAR, 6, '0') AS src, 'has' AS relation, 'L' || label AS dst FROM embeddings UNION ALL SELECT vec_id, 'v' || lpad(vec_id::VARCHAR, 6, '0'), 'before', 'v' || lpad((vec_id + 1)::VARCHAR, 6, '0') FROM embeddings)
SELECT "case", rank, fact FROM (SELECT id // 150 AS "case", src || ' ' || relation || ' ' || dst AS fact, row_number() OVER (PARTITION BY id // 150 ORDER BY id, dst, relation) AS rank FROM b JOIN e USING (nid) WHERE sc >= 0.2) WHERE rank <= 4""",
    "task_answer_match": "SELECT lower(a) = lower(term) AS equal, contains(lower(a), lower(term)) AS named, count(*) AS n FROM (SELECT term, array_to_string(coalesce(aliases, []), '; ') AS a FROM canonical_terms) GROUP BY 1, 2",
    "kg_shown_relations": _TYPED
    + f""", e AS (SELECT CASE WHEN trim(display_relation, ' ') IN ({_SHOWN}) THEN trim(display_relation, ' ') ELSE 'Other' END AS r, {_PAIR} AS pair, count(*) AS n FROM typed GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, pair) AS i, sum(n) OVER (PARTITION BY r) AS total, count(*) OVER (PARTITION BY r) AS m FROM e)
SELECT r AS relation, CAST(any_value(total) AS BIGINT) AS relation_total, CASE WHEN i <= 6 OR n / total >= 0.05 OR (r = 'parent-child' AND m <= 10) THEN pair ELSE 'Other' END AS pair, CAST(sum(n) AS BIGINT) AS pair_count FROM k GROUP BY r, 3""",
    "kg_top_pairs": _TYPED + f", e AS (SELECT display_relation, {_PAIR} AS pair, count(*) AS edges FROM typed GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY display_relation ORDER BY edges DESC, pair) AS rank FROM e) WHERE rank <= 15",
}
