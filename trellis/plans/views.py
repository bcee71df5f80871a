"""The driver's tables seen as a knowledge graph, as DataFrames and as the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import cut, table

#: Orders before this day make up the base graph.
BASE_UNTIL = "1998-04-25"


EDGE = ("relation", "display_relation", "x_id", "x_type", "x_name", "x_source", "y_id", "y_type", "y_name", "y_source")


def _node(df: DataFrame, side: str, key: str, prefix: str, name: str, source: str) -> DataFrame:
    return df.select(F.col(key).alias(f"{side}_key"), F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias(f"{side}_id"), F.col(name).alias(f"{side}_name"), F.col(source).cast("string").alias(f"{side}_source"))


def _sold(spark: SparkSession, d: str) -> DataFrame:
    """code (cp: customer and part, ps: part and supplier, pc: returned part and customer), x_key, y_key and when the pair first occurred, of one join of orders and lines."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")

    def pair(code: str, x: str, y: str):
        return F.struct(F.lit(code).alias("code"), F.col(x).alias("x_key"), F.col(y).alias("y_key"))

    rows = F.array(pair("cp", "o_custkey", "l_partkey"), pair("ps", "l_partkey", "l_suppkey"), F.when(F.col("l_returnflag") == "R", pair("pc", "l_partkey", "o_custkey")))
    x = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderdate", F.explode(rows).alias("r")).where("r IS NOT NULL")
    return x.groupBy("r.code", "r.x_key", "r.y_key").agg(F.min("o_orderdate").alias("first"))


def kg_both(spark: SparkSession, d: str) -> DataFrame:
    """All edges with in_base: customers order parts, parts are supplied by suppliers, both are in nations, nations are part of regions; parts are returned by customers (never in the base).

    Key pairs are made distinct and stored before names are joined, so orders and lines are read and shuffled once and the shuffles carry keys only.
    """
    sold = cut(_sold(spark, d))
    t = {n: table(spark, d, n) for n in ("customer", "part", "supplier", "nation", "region")}
    nodes = {
        "c": ("customer", "c_custkey", "c_name", "c_mktsegment"), "p": ("part", "p_partkey", "p_name", "p_brand"), "s": ("supplier", "s_suppkey", "s_name", "s_name"),
        "n": ("nation", "n_nationkey", "n_name", "n_name"), "r": ("region", "r_regionkey", "r_name", "r_name"),
    }

    def edge(pairs: DataFrame, relation: str, display: str, x: str, y: str) -> DataFrame:
        a, b = nodes[x], nodes[y]
        e = pairs.join(_node(t[a[0]], "x", a[1], x, a[2], a[3]), "x_key").join(_node(t[b[0]], "y", b[1], y, b[2], b[3]), "y_key")
        return e.select("*", F.lit(relation).alias("relation"), F.lit(display).alias("display_relation"), F.lit(a[0]).alias("x_type"), F.lit(b[0]).alias("y_type")).select(*EDGE, "in_base")

    def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.col(x).alias("x_key"), F.col(y).alias("y_key")).distinct().withColumn("in_base", F.lit(True))

    early = F.col("first") < F.lit(BASE_UNTIL).cast("timestamp")
    out = edge(sold.where("code = 'cp'").withColumn("in_base", early), "customer_part", "ordered", "c", "p")
    out = out.unionByName(edge(sold.where("code = 'ps'").withColumn("in_base", early), "part_supplier", "supplied by", "p", "s"))
    out = out.unionByName(edge(sold.where("code = 'pc'").withColumn("in_base", F.lit(False)), "part_customer", "returned by", "p", "c"))
    known = sold.where((F.col("code") == "cp") & early).select(F.col("x_key").alias("k")).distinct()  # customers enter the base with their first order
    homes = pairs(t["customer"], "c_custkey", "c_nationkey").drop("in_base").join(known, F.col("x_key") == F.col("k"), "left").withColumn("in_base", F.col("k").isNotNull()).drop("k")
    out = out.unionByName(edge(homes, "customer_nation", "located in", "c", "n"))
    out = out.unionByName(edge(pairs(t["supplier"], "s_suppkey", "s_nationkey"), "supplier_nation", "located in", "s", "n"))
    return out.unionByName(edge(pairs(t["nation"], "n_nationkey", "n_regionkey"), "nation_region", "part of", "n", "r"))


def kg(spark: SparkSession, d: str, base: bool = False) -> DataFrame:
    """The merged graph's edges, or the base's."""
    e = kg_both(spark, d)
    return (e.where("in_base") if base else e).drop("in_base")


def base_and_merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both graphs out of one table of keys."""
    e = kg_both(spark, d)
    return e.where("in_base").drop("in_base"), e.drop("in_base")


def _kg_sql(name: str, base: bool) -> str:
    when = f" WHERE o_orderdate < TIMESTAMP '{BASE_UNTIL}'" if base else ""
    sold = f"(SELECT o_custkey, l_partkey, l_suppkey, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey{when})"
    cust, part, supp = "'c:' || c_custkey, 'customer', c_name, c_mktsegment", "'p:' || p_partkey, 'part', p_name, p_brand", "'s:' || s_suppkey, 'supplier', s_name, s_name"
    nat, reg = "'n:' || n_nationkey, 'nation', n_name, n_name", "'r:' || r_regionkey, 'region', r_name, r_name"
    returned = f"\n  UNION ALL SELECT 'part_customer', 'returned by', {part}, {cust} FROM (SELECT DISTINCT l_partkey, o_custkey FROM {sold} z WHERE l_returnflag = 'R') JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey"
    return f"""{name}(relation, display_relation, x_id, x_type, x_name, x_source, y_id, y_type, y_name, y_source) AS (
  SELECT 'customer_part', 'ordered', {cust}, {part} FROM (SELECT DISTINCT o_custkey, l_partkey FROM {sold} z) JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT 'part_supplier', 'supplied by', {part}, {supp} FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {sold} z) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT 'customer_nation', 'located in', {cust}, {nat} FROM customer JOIN nation ON n_nationkey = c_nationkey{f" WHERE c_custkey IN (SELECT o_custkey FROM {sold} z)" if base else ""}
  UNION ALL SELECT 'supplier_nation', 'located in', {supp}, {nat} FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'nation_region', 'part of', {nat}, {reg} FROM nation JOIN region ON r_regionkey = n_regionkey{"" if base else returned})"""


KG_SQL = "WITH " + _kg_sql("kg", False) + ",\n" + _kg_sql("base", True) + ",\nends AS (SELECT x_id AS node_id, x_type AS node_type, x_name AS name, x_source AS source FROM kg UNION ALL SELECT y_id, y_type, y_name, y_source FROM kg),\nbase_ends AS (SELECT x_id AS node_id, x_type AS node_type FROM base UNION ALL SELECT y_id, y_type FROM base)\n"


_SORTED = "array_to_string(list_sort(list_filter(regexp_split_to_array({c}, '[\\t-\\r\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda w: w <> '')), ' ')"


def fuzzy_sql(mentions: str, entities: str, least: float) -> str:
    """CTE fuzzy (mention, entity, score, rank) over tables mentions (mention) and entities (entity), for SQL to check with: the longest common subsequence of the sorted texts,
    up to 120 characters, in bit-parallel form; the edit distance (of bytes, up to four a character), which the indel distance cannot fall below, leaves out hopeless pairs."""
    return f"""fz AS (SELECT mention, entity, a, b, length(a) AS n, length(b) AS m FROM (SELECT mention, {_SORTED.format(c='mention')} AS a FROM {mentions}), (SELECT entity, {_SORTED.format(c='entity')} AS b FROM {entities})),
fy AS (SELECT mention, entity, a, b, n + m AS size, m, (1::HUGEINT << m::INT) - 1 AS whole FROM fz WHERE 200.0 * least(n, m) >= {least} * (n + m) AND levenshtein(a, b) <= (1 - {least} / 100.0) * (n + m) * CASE WHEN strlen(a) = n AND strlen(b) = m THEN 1 ELSE 4 END + 1e-6),
fs AS (SELECT mention, entity, CASE WHEN size = 0 THEN 100.0 ELSE round(200.0 * (m - bit_count(list_reduce(list_transform(string_split(a, ''), lambda c: list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN b[i] = c THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END))::HUGEINT), lambda v, k: ((v + (v & k)) | (v - (v & k))) & whole, whole))) / size, 6) END AS score FROM fy),
fuzzy AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity) AS rank FROM fs WHERE score >= {least})"""
