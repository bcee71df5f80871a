"""Scored explanation paths anchor - gene - drug over a merged graph, and a diverse choice of them.

A node is struct(type, name) of normalised text. Path features are column arithmetic over arrays; facts about
edges come from one exploded join each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from trellis.functions.text import pretty_name
from trellis.operators.ranking import top_per_key
from trellis.operators.survival import quantile_groups

# Hints of pathway-like types and names, entity types allowed between the ends, names of disease in general and of cancers.
PATHWAY_TYPES = ("pathway", "biological_process", "go_term", "molecular_function", "cellular_component", "process", "function", "signaling", "signalling", "hallmark")
PATHWAY_NAMES = ("pathway", "signaling", "signalling", "process")
ALLOWED_TYPES = ("biological_process", "gene/protein", "disease", "effect/phenotype", "anatomy", "molecular_function", "drug", "cellular_component", "exposure", "pathway", "procedure")
GENERIC_NAMES = ("cancer", "neoplasm", "tumor", "tumour", "malignancy")
CANCER_NAMES = ("cancer", "adenocarcinoma", "carcinoma", "tumor", "tumour")


@dataclass(frozen=True)
class Mode:
    """A search mode: how many pathway-like nodes a path needs, how many diseases and odd types may lie between, whether cancers may, and its bonus."""

    name: str
    min_pathway: int
    max_disease: int
    max_odd: int
    max_cross: int
    bonus: float


#: From strict to relaxed. Fixed values.
MODES = (Mode("strict_pathway", 1, 0, 0, 0, 14.0), Mode("strict_no_disease", 0, 0, 0, 1, 8.0), Mode("relaxed_one_disease", 0, 1, 0, 1, 0.0), Mode("relaxed_one_disease_one_bad", 0, 1, 1, 1, -6.0))


def is_pathway_like(n: Column) -> Column:
    return n["type"].rlike("|".join(PATHWAY_TYPES)) | n["name"].rlike("|".join(PATHWAY_NAMES))


def is_generic_disease(n: Column) -> Column:
    return (n["type"] == "disease") & n["name"].isin(*GENERIC_NAMES)


def is_cross_cancer(n: Column, focus: str) -> Column:
    """A cancer other than the one in focus (a part of its name)."""
    return (n["type"] == "disease") & ~F.contains(n["name"], F.lit(focus)) & n["name"].rlike("|".join(CANCER_NAMES))


def is_odd(n: Column) -> Column:
    return ~n["type"].isin(*ALLOWED_TYPES) & ~is_pathway_like(n)


def _count(nodes: Column, test) -> Column:
    return F.size(F.filter(nodes, test))


def features(paths: DataFrame, edges: DataFrame, focus: str = "pancrea") -> DataFrame:
    """paths (path_id, gene, nodes) with length, counts of node kinds, new and base edges, origin tags and the hub penalty.

    edges: u, v (node names, u < v), in_base, in_new, origins array<string>, and u_degree, v_degree of the merged graph.
    """
    mids = F.slice("nodes", 2, F.greatest(F.size("nodes") - 2, F.lit(0)))
    x = paths.withColumns({
        "n_hops": F.size("nodes") - 1, "n_pathway": _count(F.col("nodes"), is_pathway_like), "n_focus": _count(F.col("nodes"), lambda n: F.contains(n["name"], F.lit(focus))),
        "n_cross": _count(mids, lambda n: is_cross_cancer(n, focus)), "n_generic": _count(F.col("nodes"), is_generic_disease),
        "n_disease_mid": _count(mids, lambda n: n["type"] == "disease"), "n_odd_mid": _count(mids, is_odd),
    })
    step = paths.select("path_id", "gene", F.posexplode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1].name AS a, nodes[i].name AS b))")).alias("i", "e"), (F.size("nodes") - 1).alias("hops"))
    step = step.select("path_id", "gene", "i", "hops", "e.a", "e.b", F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v")).join(edges, ["u", "v"], "left")
    penalty = lambda d: F.log1p(F.greatest(F.lit(1), F.coalesce(d, F.lit(1))))
    deg_a = F.when(F.col("a") == F.col("u"), F.col("u_degree")).otherwise(F.col("v_degree"))
    inner = F.when((F.col("i") > 0) & (F.col("a") != F.col("gene")), penalty(deg_a)).otherwise(0.0)
    of_gene = F.max(F.when(F.col("a") == F.col("gene"), penalty(deg_a)).when(F.col("b") == F.col("gene"), penalty(F.when(F.col("b") == F.col("u"), F.col("u_degree")).otherwise(F.col("v_degree")))))
    got = step.groupBy("path_id").agg(
        F.count_if(F.col("in_new")).alias("n_new"), F.bool_and(F.coalesce("in_base", F.lit(False))).alias("all_base"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("in_new"), F.col("origins")))))).alias("n_origins"), (F.sum(inner) + 1.2 * F.coalesce(of_gene, F.lit(0.0))).alias("hub"),
    )
    x = x.join(got, "path_id")
    direct = (F.col("n_hops") <= 2) & (F.col("n_pathway") == 0) & F.col("nodes")[0]["type"].isin("disease", "anatomy")
    return x.withColumns({"novel": (~F.col("all_base") & (F.col("n_new") > 0)).cast("int"), "direct": direct.cast("int")})


def score(bonus: Column) -> Column:
    """The weighted sum of a path's features."""
    c = F.col
    s = 30 * c("novel") + 10 * c("n_new") + 14 * c("n_pathway") + 10 * c("n_focus") + 4 * c("n_origins") - 20 * c("n_cross") - 16 * c("n_generic") - 14 * c("n_disease_mid") - 8 * c("n_odd_mid") - 10 * c("direct") - 3.2 * c("hub") - 2.0 * c("n_hops") + bonus
    s = s + F.when(c("n_pathway") == 0, -10.0).otherwise(6.0) + F.when((c("novel") == 1) & (c("n_pathway") > 0), 8.0).otherwise(0.0)
    return F.round(s - F.when(c("n_focus") == 0, 4.0).otherwise(0.0), 6)


def tier() -> Column:
    c = F.col
    return F.when((c("novel") == 1) & (c("n_pathway") > 0), "mechanistic_novel").when(c("n_pathway") > 0, "mechanistic_supported").when(c("novel") == 1, "novel_association").otherwise("association_like")


def allowed(m: Mode) -> Column:
    c = F.col
    return (F.size("nodes") >= 3) & ~is_generic_disease(c("nodes")[0]) & (c("n_pathway") >= m.min_pathway) & (c("n_disease_mid") <= m.max_disease) & (c("n_odd_mid") <= m.max_odd) & (c("n_cross") <= m.max_cross)


def join_segments(ag: DataFrame, gd: DataFrame) -> DataFrame:
    """Anchor-gene and gene-drug segments (a, b, mid, score) put together at the gene: anchor, gene, drug, names, seg_score; only simple paths."""
    x = ag.select(F.col("a").alias("anchor"), F.col("b").alias("gene"), F.col("mid").alias("m1"), F.col("score").alias("s1")).join(gd.select(F.col("a").alias("gene"), F.col("b").alias("drug"), F.col("mid").alias("m2"), F.col("score").alias("s2")), "gene")
    names = F.filter(F.array("anchor", "m1", "gene", "m2", "drug"), lambda n: n.isNotNull())
    x = x.select("anchor", "gene", "drug", names.alias("names"), (0.5 * F.col("s1") + 0.5 * F.col("s2")).alias("seg_score"))
    return x.where(F.size(F.array_distinct("names")) == F.size("names")).withColumn("path_id", F.array_join("names", " > "))


def rank_paths(features_of: DataFrame, per_triple: int = 8, enough: int = 50) -> DataFrame:
    """Each path in the strictest mode that allows it, scored; modes are relaxed until enough paths are found; the best per_triple of every (anchor, gene, drug)."""
    out = None
    for m in MODES:
        got = features_of.where(allowed(m)).withColumns({"mode": F.lit(m.name), "score": score(F.lit(m.bonus))})
        out = got if out is None else out.unionByName(got.join(out.select("path_id"), "path_id", "left_anti"))
        if out.limit(enough).count() >= enough:
            break
    out = out.withColumns({"combo": F.round(F.col("score") + F.col("seg_score"), 6), "tier": tier()})
    return top_per_key(out, ["anchor", "gene", "drug"], [F.desc("combo"), "n_hops", "path_id"], per_triple)


def diverse(paths: DataFrame, top_k: int = 10, per_gene: int = 2) -> DataFrame:
    """Greedy choice per patient: each pick is the best score less 18 per earlier pick of its gene and 12 times its largest overlap (Jaccard of nodes) with a pick; at most per_gene a gene.

    paths: patient, path_id, gene, names, score; already cut to a bounded number a patient by rank_paths.
    """
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["score", "path_id"], ascending=[False, True]).to_dict("records")
        chosen, genes = [], {}
        while left and len(chosen) < top_k:
            best = None
            for r in left:
                if genes.get(r["gene"], 0) >= per_gene:
                    continue
                mine = set(r["names"])
                overlap = max((len(mine & set(c["names"])) / len(mine | set(c["names"])) for c in chosen), default=0.0)
                value = r["score"] - 18.0 * genes.get(r["gene"], 0) - 12.0 * overlap
                if best is None or value > best[0]:
                    best = value, r
            if best is None:
                break
            chosen.append(best[1])
            genes[best[1]["gene"]] = genes.get(best[1]["gene"], 0) + 1
            left.remove(best[1])
        return pd.DataFrame([(r["patient"], r["path_id"], r["gene"], r["score"], i + 1) for i, r in enumerate(chosen)], columns=["patient", "path_id", "gene", "score", "diverse_rank"])

    cols = paths.select("patient", "path_id", "gene", "names", F.col("score").cast("double").alias("score"))
    return cols.withColumn("names", F.col("names").cast("array<string>")).groupBy("patient").applyInPandas(lambda p: pick(p.assign(names=[list(n) for n in p["names"]])), "patient string, path_id string, gene string, score double, diverse_rank int")


def anchors(mapped: DataFrame, focus: str = "pancrea") -> DataFrame:
    """Anchors of each patient: patient, node, rank. mapped: patient, kind (disease or anatomy), node (struct of type and name), in the order of rank.

    The first of these that is not empty: diseases in focus that are not generic, anatomy in focus, diseases that are not generic, any anatomy.
    """
    n, disease = F.col("node"), F.col("kind") == "disease"
    near, generic = F.contains(n["name"], F.lit(focus)), is_generic_disease(n)
    level = F.when(disease & near & ~generic, 0).when(~disease & near, 1).when(disease & ~generic, 2).when(~disease, 3)
    x = mapped.withColumn("__level", level).where("__level IS NOT NULL")
    best = x.groupBy("patient").agg(F.min("__level").alias("__best"))
    return x.join(best, "patient").where((F.col("__level") == F.col("__best")) | ((F.col("__best") == 3) & (F.col("__level") == 3))).select("patient", "node", "rank")


def choose_patients(predictions: DataFrame, cohort: DataFrame, mapped: DataFrame, by: list[str]) -> DataFrame:
    """The representative patient of each group of by (such as model, cancer_type and stage_group): by, patient_id, risk_score, n_tx, n_gene, resolvable.

    predictions: by, patient_id, fold, risk_score; cohort: patient_id, n_tx, n_gene (left join: a patient without a row has none); mapped: patient_id of those whose disease, agents and genes
    are all found in the graph. Of each patient's first fold, those of the top quarter of risk (all, if that is empty) in order of risk, agents and genes; the first that is resolvable, else the first.
    """
    first = top_per_key(predictions, [*by, "patient_id"], ["fold"], 1, "__f").drop("__f")
    q = quantile_groups(first, by, "risk_score", "__q")
    top = q.groupBy(*by).agg(F.max("__q").alias("__top"))
    high = q.join(top, by).where((F.col("__q") == 4) | (F.col("__top") < 4))
    x = high.join(cohort.select("patient_id", "n_tx", "n_gene"), "patient_id", "left").join(mapped.select("patient_id").distinct().withColumn("resolvable", F.lit(True)), "patient_id", "left")
    x = x.select(*by, "patient_id", "risk_score", F.coalesce("n_tx", F.lit(0)).alias("n_tx"), F.coalesce("n_gene", F.lit(0)).alias("n_gene"), F.coalesce("resolvable", F.lit(False)).alias("resolvable"))
    return top_per_key(x, by, [F.desc("resolvable"), F.desc("risk_score"), F.desc("n_tx"), F.desc("n_gene"), "patient_id"], 1).drop("rank")


def in_order(paths: DataFrame, name: str = "rank") -> DataFrame:
    """paths of features and score with a rank: novel first, then more pathway-like nodes, more nodes in focus, more origins, the higher score, the shorter path; ties by path_id. Ranked per anchor, gene and drug's patient where there is a column patient."""
    keys = ["patient"] if "patient" in paths.columns else []
    order = [F.desc("novel"), F.desc("n_pathway"), F.desc("n_focus"), F.desc("n_origins"), F.desc("score"), F.col("n_hops"), F.col("path_id")]
    return paths.withColumn(name, F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*order)))


def _pretty(n: Column) -> Column:
    return pretty_name(n["type"], n["name"])


def node_id(n: Column) -> Column:
    return F.concat(n["type"], F.lit("|"), n["name"])


def steps(paths: DataFrame) -> DataFrame:
    """path_id, i, a, b: the edges of each path in order, ends as struct(type, name)."""
    return paths.select("path_id", F.posexplode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] AS a, nodes[i] AS b))")).alias("i", "e")).select("path_id", "i", "e.a", "e.b")


def path_text(paths: DataFrame, relations: DataFrame) -> DataFrame:
    """path_id, text: type:Name --relation--> type:Name and so on. relations: u, v (names, u < v) and relation; an edge without one is related_to."""
    x = steps(paths).withColumns({"u": F.least("a.name", "b.name"), "v": F.greatest("a.name", "b.name")})
    x = x.join(relations.groupBy("u", "v").agg(F.min("relation").alias("relation")), ["u", "v"], "left")
    label = lambda n: F.concat(n["type"], F.lit(":"), _pretty(n))
    step = F.struct("i", F.concat(F.lit("--"), F.coalesce(F.nullif("relation", F.lit("")), F.lit("related_to")), F.lit("--> "), label(F.col("b"))).alias("t"))
    got = x.groupBy("path_id").agg(F.array_sort(F.collect_list(step)).alias("s"), F.min(F.when(F.col("i") == 0, label(F.col("a")))).alias("head"))
    return got.select("path_id", F.concat_ws(" ", "head", F.array_join(F.col("s.t"), " ")).alias("text"))


def subgraph_nodes(paths: DataFrame, genes: Sequence[str] = (), drugs: Sequence[str] = (), places: Sequence[str] = (), focus: str = "pancrea") -> DataFrame:
    """Distinct nodes of chosen paths: node_id, node_type, node_name, pretty_name, flags (is_patient_gene, is_patient_drug, is_patient_anchor, is_pathway_like, is_in_focus) and on how many paths."""
    n = F.col("n")
    x = paths.select("path_id", F.explode(F.array_distinct("nodes")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("paths"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    near = F.contains(n["name"], F.lit(focus))
    return x.select(
        node_id(n).alias("node_id"), n["type"].alias("node_type"), n["name"].alias("node_name"), _pretty(n).alias("pretty_name"), flag((n["type"] == "gene/protein") & n["name"].isin(*genes)).alias("is_patient_gene"),
        flag((n["type"] == "drug") & n["name"].isin(*drugs)).alias("is_patient_drug"), flag(n["name"].isin(*places) | near).alias("is_patient_anchor"), flag(is_pathway_like(n)).alias("is_pathway_like"), flag(near).alias("is_in_focus"), "paths",
    )


def subgraph_edges(paths: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct edges of chosen paths, whatever their direction: the ends' ids, names and types, relation, in_base, in_new, novel (new and not in the base) and the sorted origins. edges and relations as in features and path_text."""
    x = steps(paths)
    a, b = F.col("a"), F.col("b")
    turned = node_id(a) > node_id(b)
    x = x.select(F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b")).distinct()
    x = x.withColumns({"u": F.least("a.name", "b.name"), "v": F.greatest("a.name", "b.name")}).join(relations.groupBy("u", "v").agg(F.min("relation").alias("relation")), ["u", "v"], "left")
    x = x.join(edges.select("u", "v", "in_base", "in_new", "origins"), ["u", "v"], "left")
    base, new = F.coalesce("in_base", F.lit(False)), F.coalesce("in_new", F.lit(False))
    return x.select(
        node_id(a).alias("source_id"), node_id(b).alias("target_id"), _pretty(a).alias("source_name"), _pretty(b).alias("target_name"), a["type"].alias("source_type"), b["type"].alias("target_type"), F.coalesce("relation", F.lit("")).alias("relation"),
        base.cast("int").alias("in_base"), new.cast("int").alias("in_new"), (new & ~base).cast("int").alias("novel"), F.array_join(F.array_sort(F.coalesce("origins", F.array().cast("array<string>"))), "|").alias("origin_tags"),
    )
