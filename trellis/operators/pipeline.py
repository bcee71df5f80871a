"""Documents to concepts, concepts with evidence to triples, triples to fused triples. Models are backends passed in; each stage is one plan."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.jsonx import answers, triples_of
from trellis.functions.text import clean_text, singularize, tokens, verbalise
from trellis.operators.evidence import STOP_WORDS, boosted, class_weights, evidence, fuzzy_evidence, gold_labels, term_counts
from trellis.operators.ranking import global_index, top_per_key
from trellis.operators.triples import fused_support
from trellis.session import broadcast_bounded, cut


class Backend(Protocol):
    """What a model must offer; both methods take whole batches."""

    def complete(self, prompts: list[str]) -> list[str]: ...

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Stub:
    """A deterministic backend for tests: a prompt is answered with one triple of its first concept and a relation of its list, beside one of an unknown relation; texts are encoded by counts of letter triples."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            lines = dict(x.split(": ", 1) for x in p.split("\n") if ": " in x)
            t = [{"s": lines.get("Concept", ""), "p": "Associated-With", "o": "finding"}, {"s": lines.get("Concept", ""), "p": "Unheard-Of", "o": "x"}]
            out.append("Here it is:\n```json\n" + json.dumps(t, ensure_ascii=False) + "\n```")
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            t = f"  {t.lower()} "
            for j in range(len(t) - 2):
                out[i, sum(ord(c) * 31**k for k, c in enumerate(t[j : j + 3])) % self.dim] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class SeedVariant:
    """How seed concepts are found: n-grams, how many documents must hold one, topics, the rule for candidates (weighted, members, heavy or all), how many
    are kept (None: all), the factor for ontology members, and how documents give evidence (words or fuzzy) with its cap."""

    name: str
    lo: int
    hi: int
    min_docs: int
    topics: int
    rule: str
    keep: int | None
    factor: float
    match: str
    cap: int | None


#: The published variants; the encoder is the backend's affair. Fixed values.
VARIANTS = (
    SeedVariant("default", 1, 3, 2, 1500, "weighted", 5000, 1.5, "words", 3),
    SeedVariant("sapbert-onto", 1, 3, 2, 1500, "weighted", 5000, 1.5, "words", 3),
    SeedVariant("biolord-onto", 2, 4, 2, 50, "weighted", 200, 1.5, "words", None),
    SeedVariant("clinicalbert-onto", 2, 4, 2, 50, "weighted", 200, 1.5, "words", None),
    SeedVariant("mpnet-onto", 2, 4, 1, 50, "members", None, 1.0, "fuzzy", None),
    SeedVariant("sapbert", 1, 4, 1, 50, "heavy", None, 1.0, "fuzzy", None),
    SeedVariant("biolord", 1, 4, 1, 50, "heavy", None, 1.0, "fuzzy", None),
    SeedVariant("mpnet", 1, 4, 1, 50, "all", None, 1.0, "fuzzy", None),
    SeedVariant("clinicalbert", 1, 4, 1, 50, "all", None, 1.0, "fuzzy", None),
)


def topics(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """id, topic: vectors (id, vector) in k clusters by k-means; any other clustering may give the same two columns."""
    x = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select("id", F.col("prediction").alias("topic"))


def seed_concepts(docs: DataFrame, id_col: str, class_col: str, text_col: str, ontology: DataFrame, v: SeedVariant = VARIANTS[0], top_n: int = 10, boost: float = 0.5) -> DataFrame:
    """concept, score: each topic's top_n n-grams by class-based weights, lifted by boost if the ontology (term) has them, then by the variant's rule; singular, in cleaned form, of at least 3 characters.

    Documents of fewer than 10 characters do not count. weighted: the score is the weight times the variant's factor for members; members: only those, or, if none is, the most frequent
    n-grams; heavy: weights above 0.05 and at least two words; all: every one. A concept keeps its best score; ties in the final cut by concept.
    """
    x = docs.where(F.length(text_col) >= 10)
    counts = cut(term_counts(x, id_col, class_col, text_col, v.lo, v.hi, STOP_WORDS, v.min_docs, 2))
    terms = ontology.select(F.lower(F.trim("term")).alias("term")).distinct()
    best = boosted(class_weights(counts, reduce_frequent=True), terms, boost, top_n)
    c = best.select(singularize(clean_text(F.col("term"))).alias("concept"), "weight").where(F.length("concept") >= 3)
    c = c.join(terms.select(F.col("term").alias("concept"), F.lit(True).alias("member")), "concept", "left").withColumn("member", F.coalesce("member", F.lit(False)))
    if v.rule == "members":
        held = c.where("member")
        c = held if not held.isEmpty() else counts.groupBy(F.col("term").alias("concept")).agg(F.sum("n").cast("double").alias("weight")).withColumn("member", F.lit(False))
    elif v.rule == "heavy":
        c = confident(c)
    score = F.col("weight") * F.when(F.col("member"), v.factor).otherwise(1.0)
    out = c.groupBy("concept").agg(F.round(F.max(score), 9).alias("score"))
    return out if v.keep is None else out.orderBy(F.desc("score"), "concept").limit(v.keep)


def confident(c: DataFrame, least: float = 0.05, words: int = 2) -> DataFrame:
    """Candidates (concept, weight) above a weight and of at least so many words."""
    return c.where((F.col("weight") > least) & (F.size(tokens(F.col("concept"))) >= words))


def concept_evidence(concepts: DataFrame, docs: DataFrame, id_col: str, text_col: str, origin_col: str, gold: DataFrame | None = None, match: str = "words", cap: int | None = 3) -> DataFrame:
    """concept, abstracts, origins (of its documents, in order of id), label: concepts without evidence are left out."""
    met = evidence(concepts, docs, id_col, text_col, cap) if match == "words" else fuzzy_evidence(concepts, docs, id_col, text_col).select("concept", "doc", F.lit(1).alias("rank"))
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("abstract"), F.col(origin_col).cast("string").alias("origin"))
    got = met.join(text, "doc").groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("doc", "abstract", "origin"))).alias("d"))
    got = got.select("concept", F.col("d.abstract").alias("abstracts"), F.col("d.origin").alias("origins"))
    if gold is None:
        return got.withColumn("label", F.lit(0))
    return got.join(gold_labels(got.select("concept"), gold), "concept")


def definitions(relations: DataFrame) -> str:
    """The relation schema (relation, description; a short list) as lines relation: description."""
    return "\n".join(f"{r['relation']}: {r['description']}" for r in relations.select("relation", "description").orderBy("relation").collect())


def triple_prompt(concept: Column, abstracts: Column, relations: str, most: int | None = 10_000) -> Column:
    """The prompt of triple extraction; abstracts beyond most characters are cut off, as far as a model can read (None: whole)."""
    text = F.array_join(abstracts, " ")
    text = text if most is None else F.substring(text, 1, most)
    return F.concat(F.lit("Concept: "), concept, F.lit("\nList the relations that the text states about the concept as a JSON array of objects with s, p and o.\n"), F.lit(relations), F.lit("\nText: "), text)


def extract_triples(evidence_of: DataFrame, relations: DataFrame, backend: Backend, most: int | None = 10_000, retries: int = 3, delay: float = 0.0) -> DataFrame:
    """Candidate triples: s, p, o, id (dense, in order of concept), concept, origins. Evidence (concept, abstracts, origins) is put to the backend; what it says is read as far as it is complete, and only relations of the schema are kept."""
    numbered = global_index(evidence_of, ["concept"], "id", 0)
    asked = numbered.select("id", "concept", "origins", triple_prompt(F.col("concept"), F.col("abstracts"), definitions(relations), most).alias("prompt"))
    said = answers(asked, "prompt", backend, retries=retries, delay=delay)
    known = broadcast_bounded(relations.select(F.col("relation").alias("p")).distinct())
    return triples_of(said.where("answer IS NOT NULL"), "answer", "id", "concept", "origins").join(known, "p", "left_semi").select("s", "p", "o", "id", "concept", "origins")


def candidate_facts(triples: DataFrame) -> DataFrame:
    """Per concept (a subject or object) its distinct facts in order: concept, facts."""
    x = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select(F.explode(F.array_distinct(F.array("s", "o"))).alias("concept"), verbalise(F.col("s"), F.col("p"), F.col("o")).alias("fact"))
    return x.distinct().groupBy("concept").agg(F.array_sort(F.collect_list("fact")).alias("facts"))


def outgoing_facts(graph: DataFrame, relation: str = "unified_relation") -> DataFrame:
    """Facts of a graph (head, tail) by head: concept, facts."""
    x = graph.where("head IS NOT NULL AND tail IS NOT NULL").select(F.col("head").alias("concept"), verbalise(F.col("head"), F.lit(relation), F.col("tail")).alias("fact"))
    return x.distinct().groupBy("concept").agg(F.array_sort(F.collect_list("fact")).alias("facts"))


def fusion_prompt(concept: Column, facts: Column, known: Column, background: Column, relations: str, most: int | None = 10_000) -> Column:
    text = F.coalesce(F.array_join(background, " "), F.lit(""))
    text = text if most is None else F.substring(text, 1, most)
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, "\n"), F.lit("")), F.lit("None"))
    return F.concat(F.lit("Concept: "), concept, F.lit("\nMerge the candidate facts about the concept and settle contradictions; answer with a JSON array of objects with s, p and o.\n"), F.lit(relations), F.lit("\nCandidates: "), listed(facts), F.lit("\nKnown: "), listed(known), F.lit("\nText: "), text)


def fuse(triples: DataFrame, relations: DataFrame, backend: Backend | None = None, concepts: DataFrame | None = None, evidence_of: DataFrame | None = None, known: DataFrame | None = None, retries: int = 3, delay: float = 0.0) -> DataFrame:
    """Fused triples: id (dense from 0 in order of s, p, o), s, p, o, origins, support.

    Without a backend the fused triples are the distinct candidates, support counts their statements. With one, each concept's candidate facts, what is known of it (head, tail) and
    its evidence are put to it; support counts how many answers state a triple, origins are those of equal candidates. A bad item is left out by itself.
    """
    if backend is None:
        fused = fused_support(triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"))
    else:
        facts = candidate_facts(triples)
        c = facts.select("concept") if concepts is None else concepts.select("concept").distinct()
        x = c.join(facts, "concept", "left")
        x = x.join((outgoing_facts(known) if known is not None else facts.where("false")).withColumnRenamed("facts", "known"), "concept", "left")
        x = x.join(evidence_of.select("concept", "abstracts"), "concept", "left") if evidence_of is not None else x.withColumn("abstracts", F.lit(None).cast("array<string>"))
        asked = x.select("concept", fusion_prompt(F.col("concept"), F.col("facts"), F.col("known"), F.col("abstracts"), definitions(relations)).alias("prompt"))
        said = triples_of(answers(asked, "prompt", backend, retries=retries, delay=delay).where("answer IS NOT NULL"), "answer", "concept")
        said = said.join(broadcast_bounded(relations.select(F.col("relation").alias("p")).distinct()), "p", "left_semi")
        n = said.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("support"))
        origin = triples.select("s", "p", "o", F.explode("origins").alias("origin")).where("origin IS NOT NULL").distinct().groupBy("s", "p", "o").agg(F.array_join(F.array_sort(F.collect_list("origin")), ",").alias("origins"))
        fused = n.join(origin, ["s", "p", "o"], "left").withColumn("origins", F.coalesce("origins", F.lit("")))
    return global_index(fused, ["s", "p", "o"], "id", 0).select("id", "s", "p", "o", F.filter(F.split("origins", ","), lambda x: x != "").alias("origins"), "support")


def evidence_of_concept(evidence_of: DataFrame, wanted: DataFrame) -> DataFrame:
    """Evidence looked up for wanted (concept): null where there is none."""
    return wanted.select("concept").join(evidence_of, "concept", "left")


def prune_context(facts: DataFrame, by: str, order: Sequence[str], most: int) -> DataFrame:
    """The first most facts of each case, as far as a prompt takes them."""
    return top_per_key(facts, [by], order, most)
