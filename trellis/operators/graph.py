"""Graph operators over edge tables (src, dst, relation): neighbourhoods, distances, paths, resolution of mentions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import compact_text, norm_text
from trellis.operators.ranking import top_per_key
from trellis.session import BROADCAST_ROWS, broadcast_bounded, cut


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, self loops dropped: src, dst."""
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").where("src <> dst").distinct()


def last_edge(edges: DataFrame, ordinal: str) -> DataFrame:
    """One edge per (src, dst): the last by ordinal."""
    return edges.groupBy("src", "dst").agg(F.max_by("relation", ordinal).alias("relation"))


def to_ids(edges: DataFrame, nodes: DataFrame, relations: DataFrame, strict: bool = True) -> DataFrame:
    """Edges over ids: src_id, relation_id, dst_id. An unknown name or relation is an error when the rows are read; not strict: such edges are left out."""
    n = nodes.select("name", F.col("id").alias("nid"))
    how = "left" if strict else "inner"
    x = edges.join(n.withColumnsRenamed({"name": "src", "nid": "src_id"}), "src", how).join(n.withColumnsRenamed({"name": "dst", "nid": "dst_id"}), "dst", how)
    x = x.join(broadcast_bounded(relations.select(F.col("name").alias("relation"), F.col("id").alias("relation_id"))), "relation", how)
    def known(c: str, of: str) -> Column:
        return F.coalesce(c, F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(of, F.lit("null"))))).alias(c) if strict else F.col(c)
    return x.select(known("src_id", "src"), known("relation_id", "relation"), known("dst_id", "dst"))


def neighbours(edges: DataFrame, seeds: DataFrame, mode: str = "bidirectional") -> DataFrame:
    """Of each seed (node) its distinct neighbours; mode outgoing, ingoing or bidirectional."""
    out = seeds.join(edges, seeds["node"] == edges["src"]).select("node", F.col("dst").alias("neighbour"))
    into = seeds.join(edges, seeds["node"] == edges["dst"]).select("node", F.col("src").alias("neighbour"))
    if mode not in ("outgoing", "ingoing", "bidirectional"):
        raise ValueError(f"mode {mode}: outgoing, ingoing or bidirectional")
    return (out if mode == "outgoing" else into if mode == "ingoing" else out.unionByName(into)).distinct()


def two_hop(edges: DataFrame, seeds: DataFrame, mode: str = "outgoing") -> DataFrame:
    """Neighbours of neighbours that are neither the seed nor its neighbours."""
    one = neighbours(edges, seeds, mode)
    mid = one.select(F.col("neighbour").alias("node")).distinct()
    two = neighbours(edges, mid, mode).withColumnsRenamed({"node": "mid", "neighbour": "far"})
    far = one.join(two, F.col("neighbour") == F.col("mid")).select("node", F.col("far").alias("neighbour")).where("node <> neighbour").distinct()
    return far.join(one, ["node", "neighbour"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Number of different neighbours of each node, directions aside."""
    return undirected(edges).groupBy("src").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("src", "node")


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each pair (a, b) the nodes that both touch.

    The neighbours of the different a and those of the different b meet once on the node in the middle, so the pairs, which may be all of one set with all of another, multiply nothing.
    """
    return _common(undirected(edges), pairs)


def _common(u: DataFrame, pairs: DataFrame) -> DataFrame:
    of_a = u.join(broadcast_bounded(pairs.select(F.col("a").alias("src")).distinct()), "src").select(F.col("src").alias("a"), F.col("dst").alias("mid"))
    of_b = u.join(broadcast_bounded(pairs.select(F.col("b").alias("src")).distinct()), "src").select(F.col("src").alias("b"), F.col("dst").alias("mid"))
    return of_a.join(of_b, "mid").select("a", "b", "mid").join(broadcast_bounded(pairs.select("a", "b").distinct()), ["a", "b"], "left_semi")


def distances(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, max_hops: int = 6, directed: bool = False) -> DataFrame:
    """Hops from each source to every node reached (or to targets) in at most max_hops: source, node, hops.

    One frontier join a hop. What has been reached is kept in the checkpoint folder, a source whose targets are all
    found leaves the frontier, and the search ends when nothing new is met.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct() if directed else undirected(edges)
    e = cut(e)
    seen = cut(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("hops", F.lit(0)))
    frontier, all_found = seen, seen
    wanted = None if targets is None else targets.select("node").distinct()
    n_targets = None if wanted is None else wanted.count()
    for hop in range(1, max_hops + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).select("source", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(all_found.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        all_found = cut(all_found.unionByName(frontier))
        if wanted is not None:
            small = F.broadcast(wanted) if n_targets <= BROADCAST_ROWS else wanted
            done = all_found.join(small, "node", "left_semi").groupBy("source").count().where(F.col("count") >= n_targets).select("source")
            frontier = frontier.join(done, "source", "left_anti")
    return all_found if wanted is None else all_found.join(wanted, "node", "left_semi").select("source", "node", "hops")


def distance_stats(dist: DataFrame, groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Per group (group, node) the pairs reached with targets (node), their least and mean distance; none: 0, 99, 99."""
    met = groups.join(dist, groups["node"] == dist["source"]).select("group", dist["node"].alias("to"), "hops").join(targets.select(F.col("node").alias("to")), "to", "left_semi")
    got = met.groupBy("group").agg(F.count(F.lit(1)).alias("n_finite"), F.min("hops").cast("double").alias("least"), F.avg("hops").alias("mean"))
    return groups.select("group").distinct().join(got, "group", "left").select("group", F.coalesce("n_finite", F.lit(0)).alias("n_finite"), F.coalesce("least", F.lit(99.0)).alias("least"), F.coalesce("mean", F.lit(99.0)).alias("mean"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 5) -> DataFrame:
    """A directed shortest path of each pair (start, end): start, end, path (nodes) and hops; the smallest path of the shortest.

    Each node keeps its smallest path from a start only, so a hop never multiplies paths; pairs without a path give no row.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    starts = pairs.select(F.col("start")).distinct()
    at = cut(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    reached = at
    for _ in range(max_hops):
        step = at.join(e, at["node"] == e["src"]).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        at = cut(step.groupBy("start", "node").agg(F.min("path").alias("path")).join(reached.select("start", "node"), ["start", "node"], "left_anti"))
        if at.isEmpty():
            break
        reached = cut(reached.unionByName(at))
    return pairs.join(reached.withColumnRenamed("node", "end"), ["start", "end"]).select("start", "end", "path", (F.size("path") - 1).alias("hops"))


def path_text(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """start, end and the path as u --[relation]--> v ..., with the smallest relation of each step."""
    rel = edges.groupBy("src", "dst").agg(F.min("relation").alias("relation"))
    step = paths.select("start", "end", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS src, path[i] AS dst))")).alias("i", "s")).select("start", "end", "i", "s.*")
    got = step.join(rel, ["src", "dst"]).groupBy("start", "end").agg(F.array_sort(F.collect_list(F.struct("i", "src", "relation", "dst"))).alias("s"))
    steps = F.array_join(F.transform("s", lambda x: F.concat(x["src"], F.lit(" --["), x["relation"], F.lit("]--> "), x["dst"])), "; ")
    return got.select("start", "end", steps.alias("text"))


def resolve(queries: DataFrame, nodes: DataFrame, per_query: int = 5) -> DataFrame:
    """Nodes meant by each query: query, node, how (exact, compact or substring), rank.

    In turn: the same normalised name, the same letters and digits, and a name that contains the query or is
    contained in it (queries of at least 4 characters), at most per_query of the last kind in order of name. Blank names never match.
    queries is a stated set; the substring step puts it, in blocks of bounded size, against all names.
    """
    q = queries.select("query", norm_text(F.col("query")).alias("qn"), compact_text(F.col("query")).alias("qc")).where("qn <> ''").distinct()
    n = nodes.select("node", norm_text(F.col("node")).alias("nn"), compact_text(F.col("node")).alias("nc")).where("nn <> ''").distinct()
    exact = q.join(n, F.col("qn") == F.col("nn")).select("query", "node", F.lit("exact").alias("how"))
    left = q.join(exact.select("query").distinct(), "query", "left_anti")
    compact = left.where("qc <> ''").join(n, F.col("qc") == F.col("nc")).select("query", "node", F.lit("compact").alias("how"))
    rest = cut(left.join(compact.select("query").distinct(), "query", "left_anti").where(F.length("qn") >= 4))
    size, block = rest.count(), 10_000
    parts = []
    for b in range(-(-size // block)):
        some = rest if size <= block else rest.where(F.pmod(F.xxhash64("query"), F.lit(-(-size // block))) == b)
        parts.append(n.join(F.broadcast(some), F.contains(F.col("nn"), F.col("qn")) | F.contains(F.col("qn"), F.col("nn"))).select("query", "node", F.lit("substring").alias("how")))
    found = exact.unionByName(compact)
    if parts:
        found = found.unionByName(top_per_key(reduce(DataFrame.unionByName, parts), ["query"], ["node"], per_query).drop("rank"))
    return top_per_key(found, ["query"], ["node"], 1 << 30)


def mapping_rates(wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per group of wanted (group, query): queries, mapped and the rate, null for an empty group."""
    hit = resolved.select("query").distinct().withColumn("hit", F.lit(1))
    x = wanted.join(hit, "query", "left").groupBy("group").agg(F.count("query").alias("queries"), F.count("hit").alias("mapped"))
    return x.withColumn("rate", F.when(F.col("queries") > 0, F.col("mapped") / F.col("queries")))


def two_hop_segments(
    edges: DataFrame, pairs: DataFrame, is_new: DataFrame, pathway: Sequence[str] | Callable[[Column, Column], Column], k: int = 6, focus: str | None = None,
    allow_direct: bool = True, allow_disease: bool = True, allow_odd: bool = True, odd: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Scored ways from a to b, direct or over one node in the middle; the k best of each pair.

    edges: src, dst, dst_type, every edge in both directions (a node's type is the smallest it is given); is_new: u, v of new unordered pairs. pathway (or a list of types) and odd say of a type and a
    name whether a node is pathway-like, or odd in the middle; nodes whose name contains focus are in focus.
    Score: 8 per new edge, 7 per pathway-like node and 6 per node in focus (ends included), -16 for a disease in the middle, -2.5 times ln(1 + the degree of the middle), -1.2 per edge, and -4
    for a direct way without a pathway-like node. Middles that are diseases or odd are left out unless allowed. Ties: fewer edges, then the middle's name.
    """
    like = pathway if callable(pathway) else (lambda kind, _: kind.isin(*pathway))
    u = cut(undirected(edges))
    seg = _common(u, pairs).where("mid <> a AND mid <> b")
    if allow_direct:
        direct = u.join(broadcast_bounded(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()), ["src", "dst"], "left_semi")
        seg = seg.unionByName(direct.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("string").alias("mid")))
    seg = cut(seg)
    touched = cut(seg.select(F.explode(F.array("a", "b", "mid")).alias("node")).where("node IS NOT NULL").distinct())
    few = broadcast_bounded(touched)
    kinds = edges.select(F.col("dst").alias("node"), "dst_type").join(few, "node", "left_semi").groupBy("node").agg(F.min("dst_type").alias("type"))
    facts = kinds.join(u.join(few.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "node", "left")
    facts = cut(facts)
    facts = F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts
    for n in ("a", "b", "mid"):
        seg = seg.join(facts.select(F.col("node").alias(n), F.col("type").alias(f"{n}_type"), F.col("degree").alias(f"{n}_degree")), n, "left")
    new = is_new.select(F.least("u", "v").alias("__u"), F.greatest("u", "v").alias("__v"), F.lit(1).alias("__n")).join(few.select(F.col("node").alias("__u")), "__u", "left_semi").join(few.select(F.col("node").alias("__v")), "__v", "left_semi")
    new = broadcast_bounded(cut(new.distinct()))
    for i, (p, q) in enumerate(((F.col("a"), F.coalesce("mid", "b")), (F.coalesce("mid", "b"), F.col("b")))):
        seg = seg.join(new.withColumnRenamed("__n", f"n{i}"), (F.least(p, q) == F.col("__u")) & (F.greatest(p, q) == F.col("__v")), "left").drop("__u", "__v")
    there = F.col("mid").isNotNull()
    no = F.lit(False)
    is_disease = F.coalesce(F.col("mid_type") == "disease", no)
    if not allow_disease:
        seg = seg.where(~is_disease)
    if not allow_odd and odd is not None:
        seg = seg.where(~(there & F.coalesce(odd(F.col("mid_type"), F.col("mid")), no)))
    hops = F.when(there, 2).otherwise(1)
    n_new = F.coalesce("n0", F.lit(0)) + F.when(there, F.coalesce("n1", F.lit(0))).otherwise(0)
    way = sum((F.coalesce(like(F.col(f"{n}_type"), F.col(n)), no).cast("int") for n in ("a", "b", "mid")), F.lit(0))
    near = sum((F.coalesce(F.contains(n, F.lit(focus)), no).cast("int") for n in (F.col("a"), F.col("b"), F.col("mid"))), F.lit(0)) if focus else F.lit(0)
    hub = F.when(there, F.log1p(F.greatest(F.lit(1), F.coalesce("mid_degree", F.lit(1))))).otherwise(0.0)
    score = 8 * n_new + 7 * way + 6 * near - 16 * is_disease.cast("int") - 2.5 * hub - 1.2 * hops - F.when(~there & (way == 0), 4.0).otherwise(0.0)
    seg = seg.select("a", "b", "mid", hops.alias("hops"), n_new.alias("n_new"), F.round(score, 6).alias("score"))
    return top_per_key(seg, ["a", "b"], [F.desc("score"), "hops", F.asc_nulls_first("mid")], k)
