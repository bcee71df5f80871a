"""Answers of models judged: equality, containment, nodes named or meant, context from the graph, rubric scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.jsonx import SCORES, answers, judge_scores
from trellis.operators.ranking import top_per_key
from trellis.operators.retrieval import chunks, top_cosine


def same_answer(answer: Column, target: Column) -> Column:
    """Equal but for case."""
    return F.lower(answer) == F.lower(target)


def names_target(answer: Column, target: Column) -> Column:
    """target occurs in answer, whatever the case."""
    return F.contains(F.lower(answer), F.lower(target))


def relation_label(answer: Column) -> Column:
    """A predicted relation without its Relationship: and all but its first line."""
    return F.trim(F.split_part(F.trim(F.regexp_replace(answer, "Relationship:", "")), F.lit("\n"), F.lit(1)))


def semantic_hits(df: DataFrame, answer: str, mids: str, encoder, least: float = 0.7, into: str = "hit") -> DataFrame:
    """df with struct(hit, mid, score, chunk) for an answer and the nodes in the middle of its path (array<string>).

    A node that occurs in the answer has score 1; else its score is the best cosine with a part of the answer, and it is hit from least. The first node that is hit counts, in their order; if none is,
    the one of the highest score. Without nodes in the middle the answer is a hit of score 1. encoder.encode takes all texts of a batch at once.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{into}` struct<hit:boolean,mid:string,score:double,chunk:string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = sorted({t for ms in b[mids] if ms is not None for t in ms} | {t for ps in b["__parts"] if ps is not None for t in ps})
            at = {t: i for i, t in enumerate(texts)}
            v = np.asarray(encoder.encode(texts), float) if texts else np.zeros((0, 1))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if len(texts) else v
            out = []
            for text, ms, parts in zip(b[answer], b[mids], b["__parts"]):
                if ms is None or not len(ms):
                    out.append((True, None, 1.0, ""))
                    continue
                best = (False, None, 0.0, "")
                for m in ms:
                    if text and m.lower() in text.lower():
                        best = (True, m, 1.0, m)
                        break
                    if text and parts is not None and len(parts):
                        s = v[[at[p] for p in parts]] @ v[at[m]]
                        i = int(np.argmax(s))
                        if s[i] >= least:
                            best = (True, m, float(s[i]), parts[i])
                            break
                        if s[i] > best[2]:
                            best = (False, m, float(s[i]), parts[i])
                out.append(best)
            yield b.drop(columns="__parts").assign(**{into: [dict(zip(("hit", "mid", "score", "chunk"), x)) for x in out]})

    return df.withColumn("__parts", chunks(F.col(answer))).mapInPandas(run, schema)


def neighbour_context(mentions: DataFrame, nodes: DataFrame, edges: DataFrame, least: float = 0.7, most: int = 20) -> DataFrame:
    """Context of cases: case, rank, fact. mentions: case, at (their order), id and vector; nodes: id, vector, node; edges: src, relation, dst.

    Each mention stands for its most similar node, if that is at least least; the node's outgoing edges are facts, the first most of a case in the order of its mentions, then of the neighbours' names.
    """
    best = top_cosine(mentions.select("id", "vector").distinct(), nodes.select("id", "vector"), 1).where(F.col("score") >= least).select(F.col("query_id").alias("id"), F.col("vec_id").alias("nid"))
    x = mentions.select("case", "at", "id").join(best, "id").join(nodes.select(F.col("id").alias("nid"), "node"), "nid").join(edges, F.col("node") == F.col("src"))
    x = x.select("case", "at", "dst", "relation", F.concat_ws(" ", "src", "relation", "dst").alias("fact")).distinct()
    return top_per_key(x, ["case"], ["at", "dst", "relation"], most).select("case", "rank", "fact")


def graph_evidence(queries: DataFrame, facts: DataFrame, k: int = 10, anchors: int = 5, per_anchor: int = 3) -> DataFrame:
    """query_id, part (direct or structural), fact: the k facts most similar to a query, and facts next to them.

    queries: id, vector; facts: id, vector, s, p, o. The first anchors subjects and objects of the direct facts, by name, bring in up to per_anchor of the facts they are in, by text.
    """
    text = facts.select(F.col("id").alias("vec_id"), "s", "o", F.concat_ws(" ", "s", "p", "o").alias("fact"))
    direct = top_cosine(queries, facts.select("id", "vector"), k).join(text, "vec_id").select("query_id", "s", "o", "fact")
    ends = direct.select("query_id", F.explode(F.array("s", "o")).alias("anchor")).where("anchor IS NOT NULL").distinct()
    ends = top_per_key(ends, ["query_id"], ["anchor"], anchors).select("query_id", "anchor")
    near = text.select(F.explode(F.array_distinct(F.array("s", "o"))).alias("anchor"), "fact").where("anchor IS NOT NULL").distinct()
    near = top_per_key(near.join(ends.select("anchor").distinct(), "anchor", "left_semi"), ["anchor"], ["fact"], per_anchor).select("anchor", "fact")
    more = ends.join(near, "anchor").select("query_id", "fact").distinct()
    return direct.select("query_id", F.lit("direct").alias("part"), "fact").distinct().unionByName(more.select("query_id", F.lit("structural").alias("part"), "fact"))


def evidence_text(parts: DataFrame) -> DataFrame:
    """query_id, text: the two parts of graph_evidence under their headings, facts in order."""
    x = parts.groupBy("query_id").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("fact")))), "\n").alias(p) for p in ("direct", "structural")])
    return x.select("query_id", F.concat(F.lit("--- Direct Semantic Matches ---\n"), "direct", F.lit("\n\n--- Structural Context (Reasoning) ---\n"), "structural").alias("text"))


def relation_prompt(head: Column, tail: Column, relations: Sequence[str], context: Column | None = None) -> Column:
    """The prompt that asks for the relation of a pair, with retrieved context or without."""
    p = F.concat(F.lit("Relations: " + ", ".join(relations) + "\nHead: "), head, F.lit("\nTail: "), tail)
    p = p if context is None else F.concat(F.lit("Context: "), context, F.lit("\n"), p)
    return F.concat(p, F.lit("\nName the relation from head to tail.\nRelationship:"))


def predict_relations(pairs: DataFrame, relations: Sequence[str], backend, context: str | None = None) -> DataFrame:
    """pairs (s, o) with the relation a backend names, cleaned, and whether it is one of relations."""
    x = answers(pairs.withColumn("__prompt", relation_prompt(F.col("s"), F.col("o"), relations, F.col(context) if context else None)), "__prompt", backend)
    x = x.withColumn("relation", relation_label(F.col("answer")))
    return x.withColumn("valid", F.coalesce(F.col("relation").isin(*relations), F.lit(False))).drop("__prompt", "answer")


def judge(df: DataFrame, meta: DataFrame, backend) -> DataFrame:
    """Answers (case_id, model, answer) with the rubric's scores: each is put to the judge with its case's description, expected diagnosis and evidence hints (meta: case_id, description, expected_diagnosis, graph_evidence_hint array<string>)."""
    x = df.join(meta, "case_id", "left")
    hints = F.coalesce(F.array_join("graph_evidence_hint", "; "), F.lit(""))
    prompt = F.concat(F.lit("Score from 1 to 5: " + ", ".join(SCORES) + "\nCase: "), F.coalesce("description", F.lit("")), F.lit("\nExpected: "), F.coalesce("expected_diagnosis", F.lit("")), F.lit("\nEvidence: "), hints, F.lit("\nAnswer: "), F.coalesce(F.col("answer"), F.lit("")))
    said = answers(x.select("case_id", "model", prompt.alias("prompt")), "prompt", backend, into="said")
    return said.select("case_id", "model", judge_scores(F.col("said")).alias("s")).select("case_id", "model", "s.*")


def judge_means(scores: DataFrame, by: str = "model") -> DataFrame:
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(s) for s in SCORES])


def valid_rubric(scores: DataFrame) -> DataFrame:
    """Manual scores (entity, relation): both from 1 to 3, the relation's not above the entity's."""
    return scores.where(F.col("entity").between(1, 3) & F.col("relation").between(1, 3) & (F.col("relation") <= F.col("entity")))
