"""Explanation paths over step_03's typed edges, incremental merge and event windows, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import explain as X
from trellis.operators import graph as G
from trellis.plans.triples import MERGE_FROM, base_and_new
from trellis.operators.ranking import top_per_key
from trellis.session import broadcast_bounded, cut, ensure_checkpoint_dir, table
from trellis.streaming import merge as S

#: How many of the most connected nodes of each kind the query set takes.
QUERY_NODES = {"disease": 3, "gene/protein": 3, "drug": 3}


def whole(s: SparkSession, d: str) -> DataFrame:
    base, new = base_and_new(s, d)
    return cut(base.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))).select("x_name", "x_type", "y_name", "y_type", "display_relation", "fresh").distinct())


def paths_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, edge facts, relations) between the most connected diseases, genes and drugs of the merged graph."""
    e = whole(s, d)
    both = e.select(F.explode(F.array(F.struct(F.col("x_name").alias("src"), F.col("y_name").alias("dst"), F.col("y_type").alias("dst_type")), F.struct(F.col("y_name").alias("src"), F.col("x_name").alias("dst"), F.col("x_type").alias("dst_type")))).alias("e")).select("e.*").distinct()
    both = cut(both)
    kinds = cut(both.groupBy(F.col("dst").alias("name")).agg(F.min("dst_type").alias("type")))
    ranks = G.degrees(both).join(kinds.withColumnRenamed("name", "node"), "node").where(F.col("type").isin(*QUERY_NODES))
    ranks = cut(top_per_key(ranks, ["type"], [F.desc("degree"), "node"], max(QUERY_NODES.values())))
    added = e.where("fresh").select(F.col("x_name").alias("u"), F.col("y_name").alias("v"))

    def pairs(a: str, b: str) -> DataFrame:
        x = ranks.where((F.col("type") == a) & (F.col("rank") <= QUERY_NODES[a])).select(F.col("node").alias("a"))
        return x.join(F.broadcast(ranks.where((F.col("type") == b) & (F.col("rank") <= QUERY_NODES[b])).select(F.col("node").alias("b"))))  # a few by a few

    node = lambda kind, name: F.struct(kind.alias("type"), name.alias("name"))
    ways = {"pathway": lambda kind, name: X.is_pathway_like(node(kind, name)), "odd": lambda kind, name: X.is_odd(node(kind, name)), "focus": "pancrea", "allow_disease": True}
    ag = G.two_hop_segments(both, pairs("disease", "gene/protein"), added, k=6, **ways)
    gd = G.two_hop_segments(both, pairs("gene/protein", "drug"), added, k=6, **ways)
    p = X.join_segments(cut(ag), cut(gd))
    typed = p.select("path_id", F.posexplode("names").alias("i", "name")).join(kinds, "name", "left").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("type", F.lit("none")).alias("type"), "name"))).alias("n"))
    p = cut(p.join(typed.select("path_id", F.transform("n", lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"))).alias("nodes")), "path_id"))
    names = broadcast_bounded(cut(p.select(F.explode("names").alias("node")).distinct()))
    deg = cut(G.degrees(both).join(names, "node", "left_semi"))
    near = e.join(names.select(F.col("node").alias("x_name")), "x_name", "left_semi").join(names.select(F.col("node").alias("y_name")), "y_name", "left_semi")
    by = (F.least("x_name", "y_name").alias("u"), F.greatest("x_name", "y_name").alias("v"))
    facts = near.groupBy(*by).agg(F.bool_or(~F.col("fresh")).alias("in_base"), F.bool_or("fresh").alias("in_new"), F.array(F.lit("step_03")).alias("origins"))
    facts = cut(facts.join(deg.select(F.col("node").alias("u"), F.col("degree").alias("u_degree")), "u", "left").join(deg.select(F.col("node").alias("v"), F.col("degree").alias("v_degree")), "v", "left"))
    relations = cut(near.groupBy(*by).agg(F.min("display_relation").alias("relation")))
    return X.rank_paths(cut(X.features(p, facts, "pancrea"))), facts, relations


def ranked(s: SparkSession, d: str) -> DataFrame:
    return paths_of(s, d)[0]


def chosen(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The diverse choice of each anchor, with nodes, and the edge facts and relations."""
    p, facts, relations = paths_of(s, d)
    p = cut(p)
    pick = X.diverse(p.withColumn("patient", F.col("anchor")), 5, 3).select("path_id", "diverse_rank")
    return cut(p.select("path_id", "anchor", "nodes").join(pick, "path_id")), facts, relations


def diverse(s: SparkSession, d: str) -> DataFrame:
    return X.diverse(ranked(s, d).withColumn("patient", F.col("anchor")), 5, 3)


def stream_merge(s: SparkSession, d: str) -> DataFrame:
    """The base months as one batch, the rest as another, read as a file stream and merged in turn."""
    t = table(s, d, "step_03").select("id", "s", "p", "o", "origins", "support", "loaded_at")
    ensure_checkpoint_dir(s)
    root = f"{s.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex}"
    day = F.lit(MERGE_FROM).cast("timestamp")
    t.where(F.col("loaded_at") < day).write.parquet(f"{root}/in")
    S.merge_stream(S.read_triples(s, f"{root}/in"), f"{root}/state", f"{root}/checkpoint").awaitTermination()
    t.where(F.col("loaded_at") >= day).write.mode("append").parquet(f"{root}/in")
    S.merge_stream(S.read_triples(s, f"{root}/in"), f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return S.state(s, f"{root}/state").select("x_name", "y_name", "relation", "first_id", "statements", "status", "batch")


def event_windows(s: SparkSession, d: str) -> DataFrame:
    return S.event_counts(table(s, d, "events")).withColumn("total", F.round("total", 4))


QUERIES = {
    "explain_paths": lambda s, d: ranked(s, d).select("anchor", "gene", "drug", "path_id", "mode", "score", "combo", "tier", "rank"),
    "explain_diverse": diverse,
    "explain_ordered": lambda s, d: X.in_order(ranked(s, d).withColumn("patient", F.col("anchor")), "place").select("patient", "path_id", "place"),
    "explain_path_text": lambda s, d: (lambda c: X.path_text(c[0], c[2]))(chosen(s, d)),
    "explain_nodes": lambda s, d: X.subgraph_nodes(chosen(s, d)[0]),
    "explain_edges": lambda s, d: (lambda c: X.subgraph_edges(*c))(chosen(s, d)),
    "stream_merge": stream_merge,
    "event_windows": event_windows,
}
ORACLE = {"event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"}
