"""Statistics over knowledge-graph edge tables.

An edge table has relation, display_relation, x_id, x_type, x_name, x_source and the same for y. Everything is one or
two hash aggregations; path counts come from degree products, never from enumerated paths.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.functions.text import lookup
from trellis.operators import rules as R
from trellis.session import cut, stored


EDGE_COLUMNS = ("relation", "display_relation", "x_id", "x_type", "x_name", "x_source", "y_id", "y_type", "y_name", "y_source")
#: Entity types of the type-pair heat map, in its order. Fixed values.
CORE_ENTITY_TYPES = ("biological_process", "gene/protein", "disease", "effect/phenotype", "anatomy", "molecular_function", "drug", "cellular_component", "exposure", "pathway", "procedure")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def or_none(c: Column) -> Column:
    """Null and blank become the word none."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("none"))


def normalise_edges(df: DataFrame) -> DataFrame:
    """The eight compared columns trimmed, null and blank as none; provenance columns added where absent."""
    require_columns(df, [c for c in EDGE_COLUMNS if not c.endswith("_source")])
    out = df.withColumns({c: or_none(F.col(c)) for c in EDGE_COLUMNS if not c.endswith("_source")})
    return out.withColumns({c: F.lit("") for c in ("_origins", "_input_predicate") if c not in df.columns})


def ends(edges: DataFrame, *extra: str) -> DataFrame:
    """Both ends of every edge as rows: node_id, node_type and the asked x_/y_ columns without their prefix."""
    sides = [F.struct(F.col(f"{s}_id").alias("node_id"), F.col(f"{s}_type").alias("node_type"), *[F.col(f"{s}_{e}").alias(e) for e in extra]) for s in "xy"]
    return edges.select(F.explode(F.array(*sides)).alias("n")).select("n.*")


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct (node_id, node_type) with the smallest name."""
    return ends(edges, "name").groupBy("node_id", "node_type").agg(F.min("name").alias("node_name"))


def node_type_counts(edges: DataFrame) -> DataFrame:
    return ends(edges).distinct().groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"))


def relation_counts(edges: DataFrame, column: str = "relation", drop_none: bool = False) -> DataFrame:
    x = edges.where((F.trim(column) != "") & (F.lower(F.trim(column)) != "none")) if drop_none else edges
    return x.groupBy(column).agg(F.count(F.lit(1)).alias("edges"))


def entropy(counts: DataFrame, n: str) -> DataFrame:
    """Shannon entropy in nats, 0 for no rows; counts are few, so one row of sums suffices: ln(N) - sum(n ln n)/N."""
    return counts.agg(F.coalesce(F.ln(F.sum(n)) - F.sum(F.col(n) * F.ln(n)) / F.sum(n), F.lit(0.0)).alias("entropy"))


def two_hop_paths(edges: DataFrame) -> DataFrame:
    """Number of directed two-edge walks: the sum over nodes of in-degree times out-degree."""
    half = edges.select(F.explode(F.array(F.struct(F.col("x_id").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("y_id").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("h")).select("h.*")
    degree = half.groupBy("v").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return degree.agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0)).alias("paths"))


def low_frequency_types(edges: DataFrame, min_nodes: int = 10, min_ratio: float = 0.0) -> DataFrame:
    """Types with fewer than min_nodes distinct nodes or a smaller share than min_ratio: node_type, nodes, ratio."""
    x = node_type_counts(edges).withColumn("ratio", F.col("nodes") / F.sum("nodes").over(Window.partitionBy(F.lit(1))))
    return x.where((F.col("nodes") < min_nodes) | (F.col("ratio") < min_ratio))


def excluded_types(low: DataFrame, forced: Sequence[str]) -> DataFrame:
    extra = low.sparkSession.createDataFrame([(t.strip(),) for t in forced if t.strip()], "node_type string")
    return low.select(F.trim("node_type").alias("node_type")).union(extra).distinct()


def drop_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with neither end of a type in types (one row per type, so a broadcast of bounded size)."""
    t = F.broadcast(types.select(F.col("node_type").alias("gone")).distinct())
    return edges.join(t, F.col("x_type") == F.col("gone"), "left_anti").join(t, F.col("y_type") == F.col("gone"), "left_anti")


_COMPARED = ("relation", "display_relation", "x_id", "x_type", "y_id", "y_type")
KEYS = {
    "nodes": None,
    "triples": ("x_id", "display_relation", "y_id"),
    "entity_pairs": ("x_id", "y_id"),
    "type_pairs": ("x_type", "y_type"),
    "relations": ("relation",),
    "display_relations": ("display_relation",),
}


def distinct_of(edges: DataFrame, what: str) -> DataFrame:
    return ends(edges).distinct() if what == "nodes" else edges.select(*KEYS[what]).distinct()


def new_of(base: DataFrame, merged: DataFrame, what: str) -> DataFrame:
    """What merged has and base has not: nodes, triples, entity_pairs, type_pairs, relations or display_relations.

    One shuffle of both sides together and one aggregation instead of a set difference of two distincts.
    """
    both = distinct_side(base, what, 1).unionByName(distinct_side(merged, what, 0))
    keys = [c for c in both.columns if c != "old"]
    return both.groupBy(*keys).agg(F.max("old").alias("old")).where("old = 0").drop("old")


def distinct_side(edges: DataFrame, what: str, old: int) -> DataFrame:
    return (ends(edges) if what == "nodes" else edges.select(*KEYS[what])).withColumn("old", F.lit(old))


def _counted(base: DataFrame, merged: DataFrame, what: str) -> DataFrame:
    """One row: base, merged and new distinct counts of what."""
    both = distinct_side(base, what, 1).unionByName(distinct_side(merged, what, 0))
    keys = [c for c in both.columns if c != "old"]
    x = both.groupBy(*keys).agg(F.max("old").alias("in_base"), F.min("old").alias("only_base"))
    return x.agg(F.count_if(F.col("in_base") == 1).alias(f"base_{what}"), F.count_if(F.col("only_base") == 0).alias(f"merged_{what}"), F.count_if(F.col("in_base") == 0).alias(f"new_{what}"))


def _pct(a: Column, b: Column) -> Column:
    return F.round(F.when(b != 0, a / b * 100).otherwise(0.0), 4)


def _kinds(both: DataFrame) -> DataFrame:
    """One row of what depends on relations and types alone: rows, relations, type pairs, types and entropies of either side, out of one table of counts."""
    kinds = cut(both.groupBy("old", "relation", "display_relation", "x_type", "y_type").agg(F.count(F.lit(1)).alias("n")))  # one row a kind of edge
    has = lambda old: F.col("old") == old

    def of(keys: tuple[str, ...], what: str) -> DataFrame:
        x = kinds.groupBy(*keys).agg(F.max("old").alias("in_base"), F.min("old").alias("only_base"))
        return x.agg(F.count_if(F.col("in_base") == 1).alias(f"base_{what}"), F.count_if(F.col("only_base") == 0).alias(f"merged_{what}"), F.count_if(F.col("in_base") == 0).alias(f"new_{what}"))

    parts = [of(KEYS[w], w) for w in ("type_pairs", "relations", "display_relations")]
    one = kinds.agg(F.coalesce(F.sum(F.when(has(1), F.col("n"))), F.lit(0)).alias("base_rows"), F.coalesce(F.sum(F.when(has(0), F.col("n"))), F.lit(0)).alias("merged_rows"))
    types = kinds.select("old", F.explode(F.array("x_type", "y_type")).alias("t"))
    parts.append(types.agg(*[F.collect_set(F.when(has(o), F.col("t"))).alias(f"{side}_types") for o, side in ((1, "base"), (0, "merged"))]))
    for o, side in ((1, "base"), (0, "merged")):
        for col in ("relation", "display_relation"):
            counts = kinds.where(has(o)).groupBy(col).agg(F.sum("n").alias("edges"))
            parts.append(entropy(counts, "edges").select(F.round("entropy", 6).alias(f"{side}_{col}_entropy")))
    for p in parts:
        one = one.crossJoin(F.broadcast(p))  # single rows
    return one.withColumns({f"{side}_entity_types": F.size(f"{side}_types").cast("bigint") for side in ("base", "merged")})


def _node_figures(both: DataFrame) -> DataFrame:
    """One row: nodes of either side and new ones, and both sides' two-hop paths, from one aggregation of edge ends by node."""
    b = F.col("old") == 1
    end = lambda s, i, o: F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_type").alias("type"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    x = both.select("old", F.explode(F.array(end("x", 0, 1), end("y", 1, 0))).alias("n")).select("old", "n.*")
    sums = [F.sum(F.when(b if side == "b" else ~b, F.col(c)).otherwise(0)).alias(f"{side}{c}") for side in "bm" for c in "io"]
    per = x.groupBy("id", "type").agg(F.max("old").alias("in_base"), F.min("old").alias("only_base"), *sums)
    per = per.groupBy("id").agg(F.count_if(F.col("in_base") == 1).alias("nb"), F.count_if(F.col("only_base") == 0).alias("nm"), F.count_if(F.col("in_base") == 0).alias("nn"), *[F.sum(f"{side}{c}").alias(f"{side}{c}") for side in "bm" for c in "io"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(total("nb").alias("base_nodes"), total("nm").alias("merged_nodes"), total("nn").alias("new_nodes"), total(F.col("bi") * F.col("bo")).alias("base_2hop_paths"), total(F.col("mi") * F.col("mo")).alias("merged_2hop_paths"))


def _pair_figures(both: DataFrame) -> DataFrame:
    """One row: triples and entity pairs of either side and new ones; pairs are counted from the triples' aggregation."""
    t = both.groupBy("x_id", "y_id", "display_relation").agg(F.max("old").alias("in_base"), F.min("old").alias("only_base"))
    t = t.groupBy("x_id", "y_id").agg(F.count_if(F.col("in_base") == 1).alias("b"), F.count_if(F.col("only_base") == 0).alias("m"), F.count_if(F.col("in_base") == 0).alias("n"), F.max("in_base").alias("in_base"), F.min("only_base").alias("only_base"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    pairs = [F.count_if(F.col("in_base") == 1).alias("base_entity_pairs"), F.count_if(F.col("only_base") == 0).alias("merged_entity_pairs"), F.count_if(F.col("in_base") == 0).alias("new_entity_pairs")]
    return t.agg(total("b").alias("base_triples"), total("m").alias("merged_triples"), total("n").alias("new_triples"), *pairs)


def quant_report(base: DataFrame, merged: DataFrame, base_name: str = "base") -> DataFrame:
    """One row that sets a merged graph against its base: counts, growth, diversity, entropy, two-hop paths and novelty.

    Triple growth compares row counts, new triples are a set difference; the two rates that are 100 by definition whenever anything is new are kept.
    """
    both = stored(base.select(*_COMPARED, F.lit(1).alias("old")).unionByName(merged.select(*_COMPARED, F.lit(0).alias("old"))))
    one = _kinds(both)
    for p in (_node_figures(both), _pair_figures(both)):
        one = one.crossJoin(F.broadcast(p))  # single rows
    c = F.col
    return one.select(
        F.lit(base_name).alias("base_name"),
        c("base_nodes").alias("base_node_count"), c("merged_nodes").alias("merged_node_count"), c("new_nodes").alias("new_node_count"), _pct(c("new_nodes"), c("base_nodes")).alias("node_coverage_lift_pct"),
        c("base_rows").alias("base_triple_count"), c("merged_rows").alias("merged_triple_count"), c("new_triples").alias("new_triple_count"), _pct(c("merged_rows") - c("base_rows"), c("base_rows")).alias("triple_growth_pct"),
        c("base_entity_types").alias("base_entity_type_count"), c("merged_entity_types").alias("merged_entity_type_count"), F.size(F.array_except("merged_types", "base_types")).cast("bigint").alias("new_entity_type_count"),
        c("base_relations").alias("base_relation_count"), c("merged_relations").alias("merged_relation_count"), c("new_relations").alias("new_relation_count"), _pct(c("merged_relations") - c("base_relations"), c("base_relations")).alias("relation_diversity_lift_pct"),
        c("base_display_relations").alias("base_display_relation_count"), c("merged_display_relations").alias("merged_display_relation_count"), c("new_display_relations").alias("new_display_relation_count"),
        "base_relation_entropy", "merged_relation_entropy", "base_display_relation_entropy", "merged_display_relation_entropy",
        "base_2hop_paths", "merged_2hop_paths", (c("merged_2hop_paths") - c("base_2hop_paths")).alias("estimated_new_2hop_paths"),
        c("new_entity_pairs").alias("new_entity_pair_count"), c("new_type_pairs").alias("new_type_pair_count"),
        F.when(c("new_triples") > 0, 100.0).otherwise(0.0).alias("novel_triple_rate_pct"), F.when(c("new_entity_pairs") > 0, 100.0).otherwise(0.0).alias("novel_entity_pair_rate_pct"),
        _pct(c("new_relations"), c("merged_relations")).alias("novel_relation_usage_rate_pct"), _pct(c("new_type_pairs"), c("merged_type_pairs")).alias("novel_type_pair_rate_pct"),
    )


def summary_table(report: DataFrame) -> DataFrame:
    """The report's figures as rows: metric, value."""
    names = [c for c in report.columns if c != "base_name"]
    return report.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")


def filtering_summary(edges: DataFrame, low: DataFrame, forced: Sequence[str]) -> DataFrame:
    """item, value (string) of what a type filter removes."""
    edges, gone = cut(edges.select(*_COMPARED)), cut(excluded_types(low, forced))
    kept = drop_types(edges, gone)
    lists = low.agg(F.array_sort(F.collect_set(F.trim("node_type"))).alias("low")).withColumn("k", F.lit(1))
    counts = _counted(kept, edges, "nodes").select(F.col("merged_nodes").alias("n0"), F.col("base_nodes").alias("n1"), F.col("new_nodes").alias("n2"), F.lit(1).alias("k"))
    rows = edges.agg(F.count(F.lit(1)).alias("t0")).withColumn("k", F.lit(1))
    rows_kept = kept.agg(F.count(F.lit(1)).alias("t1")).withColumn("k", F.lit(1))
    force = F.array(*[F.lit(t) for t in sorted({t.strip() for t in forced if t.strip()})]).cast("array<string>")
    one = counts.join(F.broadcast(rows), "k").join(F.broadcast(rows_kept), "k").join(F.broadcast(lists), "k").withColumn("f", force)
    final = F.array_sort(F.array_union("low", "f"))
    items = [
        ("original_merged_triples", F.col("t0")), ("filtered_merged_triples", F.col("t1")), ("removed_triples", F.col("t0") - F.col("t1")),
        ("original_merged_nodes", F.col("n0")), ("filtered_merged_nodes", F.col("n1")), ("removed_nodes", F.col("n2")),
        ("low_frequency_entity_type_count", F.size("low")), ("low_frequency_entity_types", F.array_join("low", "; ")),
        ("forced_excluded_entity_type_count", F.size("f")), ("forced_excluded_entity_types", F.array_join("f", "; ")),
        ("final_removed_entity_type_count", F.size(final)), ("final_removed_entity_types", F.array_join(final, "; ")),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), v.cast("string").alias("value")) for n, v in items])).alias("r")).select("r.*")


def pair_label(x: str = "x_type", y: str = "y_type") -> Column:
    """Type pair as shown: underscores as blanks, an arrow between."""
    return F.concat(F.replace(F.col(x), F.lit("_"), F.lit(" ")), F.lit(" -> "), F.replace(F.col(y), F.lit("_"), F.lit(" ")))


def relation_pair_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("display_relation", pair_label().alias("pair")).agg(F.count(F.lit(1)).alias("edges"))


def relation_pair_rollup(edges: DataFrame) -> DataFrame:
    """Counts per relation and pair with each relation's total (pair null) and the grand total (both null)."""
    return edges.withColumn("pair", pair_label()).rollup("display_relation", "pair").agg(F.count(F.lit(1)).alias("edges"))


def top_pairs_other(edges: DataFrame, top_k: int = 6, min_pct: float = 0.05, keep_all: str = "parent-child", keep_all_to: int = 10) -> DataFrame:
    """Per relation its top_k pairs and any with at least min_pct of its edges, the rest as Other; keep_all keeps up to keep_all_to pairs whole."""
    w = Window.partitionBy("display_relation")
    x = relation_pair_counts(edges).withColumns({"i": F.row_number().over(w.orderBy(F.desc("edges"), "pair")), "all": F.sum("edges").over(w), "pairs": F.count(F.lit(1)).over(w)})
    keep = (F.col("i") <= top_k) | (F.col("edges") / F.col("all") >= min_pct) | ((F.col("display_relation") == keep_all) & (F.col("pairs") <= keep_all_to))
    return x.groupBy("display_relation", F.when(keep, F.col("pair")).otherwise("Other").alias("pair")).agg(F.sum("edges").alias("edges"))


def shown_labels(edges: DataFrame, min_share: float = 0.025) -> DataFrame:
    """relation_pair_counts with shown: the first pair of its relation or at least min_share of all edges."""
    x = relation_pair_counts(edges)
    first = F.row_number().over(Window.partitionBy("display_relation").orderBy(F.desc("edges"), "pair")) == 1
    return x.withColumn("shown", first | (F.col("edges") / F.sum("edges").over(Window.partitionBy(F.lit(1))) >= min_share))


def top_plus_other(counts: DataFrame, key: str, n: str, top_n: int = 8) -> DataFrame:
    """The top_n keys by count (ties by key) and the rest as Other. counts has one row per key; only the first top_n rows are ranked globally."""
    top = counts.orderBy(F.desc(n), F.asc(key)).limit(top_n).select(F.col(key).alias("kept"), F.lit(True).alias("is_top"))
    x = counts.join(F.broadcast(top), F.col(key) == F.col("kept"), "left")
    return x.groupBy(F.coalesce("kept", F.lit("Other")).alias(key)).agg(F.sum(n).alias(n))


def parsed_sources(c: Column) -> Column:
    """Brackets and quotes dropped, split at ; , or |, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]'\"]", ""), r"[;,|]"), lambda s: F.trim(s)), lambda s: s != "")


def resource_counts(edges: DataFrame) -> DataFrame:
    """node_type, source, nodes: distinct nodes per type and parsed source (upper case; CUSTOM as text-based)."""
    src = F.explode(parsed_sources(F.col("source")))
    x = ends(edges, "source").select("node_id", "node_type", src.alias("source")).withColumn("source", F.upper("source"))
    x = x.withColumn("source", F.when(F.col("source") == "CUSTOM", "text-based").otherwise(F.col("source"))).distinct()
    return x.groupBy("node_type", "source").agg(F.count(F.lit(1)).alias("nodes"))


def entity_novelty(base: DataFrame, merged: DataFrame) -> DataFrame:
    """Per type: merged and new nodes, the base's part clamped to 0..merged, and the new fraction."""
    new = new_of(base, merged, "nodes").groupBy("node_type").agg(F.count(F.lit(1)).alias("added"))
    x = node_type_counts(merged).join(F.broadcast(new), "node_type", "left").withColumn("added", F.coalesce("added", F.lit(0)))
    x = x.withColumn("base_existing", F.greatest(F.lit(0), F.least(F.col("nodes"), F.col("nodes") - F.col("added"))))
    return x.select("node_type", F.col("nodes").alias("merged_nodes"), "base_existing", F.col("added").alias("text_added"), (F.col("added") / F.col("nodes")).alias("new_fraction"))


def type_pair_counts(edges: DataFrame, undirected: bool = False) -> DataFrame:
    x = edges.select(F.least("x_type", "y_type").alias("x_type"), F.greatest("x_type", "y_type").alias("y_type")) if undirected else edges
    return x.groupBy("x_type", "y_type").agg(F.count(F.lit(1)).alias("edges"))


def type_pair_matrix(edges: DataFrame, types: Sequence[str] = CORE_ENTITY_TYPES) -> DataFrame:
    """Rows and columns are types; cells are edge counts, 0 where there is none."""
    x = edges.where(F.col("x_type").isin(*types) & F.col("y_type").isin(*types))
    got = x.groupBy("x_type").pivot("y_type", list(types)).count()
    rows = edges.sparkSession.createDataFrame([(t,) for t in types], "x_type string")
    return F.broadcast(rows).join(got, "x_type", "left").na.fill(0)


def new_type_pair_links(base: DataFrame, text: DataFrame) -> DataFrame:
    """Type pairs of text with the base's count, those new to the base first by count: rank, log10(count + 1)."""
    b = type_pair_counts(base).withColumnRenamed("edges", "base_edges")
    x = type_pair_counts(text).join(F.broadcast(b), ["x_type", "y_type"], "left").withColumn("base_edges", F.coalesce("base_edges", F.lit(0)))
    x = x.where("base_edges = 0")
    return x.select("x_type", "y_type", "edges", F.row_number().over(Window.orderBy(F.desc("edges"), "x_type", "y_type")).alias("rank"), F.log10(F.col("edges") + 1).alias("log_edges"))


def edge_provenance(edges: DataFrame) -> DataFrame:
    """Per unordered pair of nodes: sorted distinct relations, display relations and origins as text."""
    a, b = F.col("x_id"), F.col("y_id")
    def listed(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), "|")
    return edges.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(listed("relation").alias("relations"), listed("display_relation").alias("display_relations"), listed("x_source").alias("sources"))


def edge_source(origins: Column) -> Column:
    """literature if origins says something, else base."""
    t = F.lower(F.trim(F.coalesce(origins, F.lit(""))))
    return F.when(t.isin("", "[]", "nan", "none"), "base").otherwise("literature")




def type_name(c: Column, names: Mapping[str, str] = R.TYPE_NAMES) -> Column:
    """A type in lower case with underscores for blanks, by names where listed; null is empty under TYPE_NAMES and stays null under TYPE_NAMES_WIDE."""
    t = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")) if names is R.TYPE_NAMES else c)), F.lit(" "), F.lit("_"))
    return F.coalesce(lookup(t, names), t)


def shown_relations(edges: DataFrame, shown: Sequence[str] = R.SHOWN_RELATIONS, top_k: int = 6, min_pct: float = 0.05) -> DataFrame:
    """relation, relation_total, pair, pair_count: edges between ends of a type, by display relation (those not shown as Other) and type pair; of each relation the pairs as in top_pairs_other, the rest as Other."""
    x = edges.select(F.trim("display_relation").alias("r"), type_name(F.col("x_type")).alias("x_type"), type_name(F.col("y_type")).alias("y_type"))
    x = x.where(~F.col("x_type").isin("", "none") & ~F.col("y_type").isin("", "none"))
    x = x.select(F.when(F.col("r").isin(*shown), F.col("r")).otherwise("Other").alias("display_relation"), "x_type", "y_type")
    y = top_pairs_other(x, top_k, min_pct)
    return y.select(F.col("display_relation").alias("relation"), F.sum("edges").over(Window.partitionBy("display_relation")).alias("relation_total"), "pair", F.col("edges").alias("pair_count"))


def unique_columns(df: DataFrame, name: str = "table") -> DataFrame:
    """df, or an error if a column name occurs twice, whatever its case."""
    seen: set[str] = set()
    if twice := [c for c in df.columns if c.lower() in seen or seen.add(c.lower())]:
        raise ValueError(f"{name}: columns more than once: {', '.join(sorted(set(twice)))}")
    return df


def top_pairs_per_relation(edges: DataFrame, k: int = 15) -> DataFrame:
    """relation, pair, edges, rank: the k pairs of each display relation with most edges."""
    w = Window.partitionBy("display_relation").orderBy(F.desc("edges"), "pair")
    return relation_pair_counts(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
