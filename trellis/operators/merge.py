"""New triples merged into a typed edge table: type and relation mapping, duplicates, conflicts, new ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import lookup, norm_predicate, slug, trimmed
from trellis.operators.ranking import global_index
from trellis.operators import rules as R
from trellis.operators.retrieval import align
from trellis.session import broadcast_bounded, cut, stored


def keyword_type(text: Column) -> Column:
    """The first group of TYPE_KEYWORDS of which a word occurs in text, null if none does."""
    t = F.lower(text)
    return reduce(lambda otherwise, g: F.when(t.rlike("|".join(g[1])), g[0]).otherwise(otherwise), reversed(R.TYPE_KEYWORDS), F.lit(None).cast("string"))


def map_type(raw: Column, name: Column) -> Column:
    """A native type as it is; else the table of direct names; else keywords of raw type and name; else the raw type (or the name) as an extended type."""
    raw0 = F.coalesce(raw, F.lit(""))
    extended = F.regexp_replace(F.lower(trimmed(F.coalesce(F.nullif(raw0, F.lit("")), name))), "[ /]", "_")
    return F.when(raw0.isin(*R.NATIVE_TYPES), raw0).otherwise(F.coalesce(lookup(F.lower(trimmed(raw0)), R.DIRECT_TYPES), keyword_type(F.concat_ws(" ", raw0, name)), extended))


def infer_type(name: Column) -> Column:
    """Keywords of the name, else gene/protein; the deterministic stand-in for a language model's answer."""
    return F.coalesce(keyword_type(name), F.lit("gene/protein"))


def map_relation(p: Column, x_type: Column, y_type: Column) -> Column:
    """struct(relation, display): constant rule, type pair, reversed pair of symmetric predicates, default, and ext_<slug> for unknown predicates."""
    pred = norm_predicate(p)
    pairs = {"|".join(r[:3]): f"{r[3]}|{r[4]}" for r in R.PAIR_RULES}
    fixed = {r[0]: f"{r[1]}|{r[2]}" for r in R.CONSTANT_RULES}
    default = {r[0]: f"{r[1]}|{r[2]}" for r in R.DEFAULT_RULES}
    reverse = F.when(pred.isin(*R.SYMMETRIC_PREDICATES), lookup(F.concat_ws("|", pred, y_type, x_type), pairs))
    unknown = F.concat(F.lit("ext_"), slug(pred, "custom_relation"), F.lit("|"), F.replace(pred, F.lit("-"), F.lit(" ")))
    got = F.coalesce(lookup(pred, fixed), lookup(F.concat_ws("|", pred, x_type, y_type), pairs), reverse, lookup(pred, default), unknown)
    return F.struct(F.substring_index(got, "|", 1).alias("relation"), F.substring_index(got, "|", -1).alias("display_relation"))


def name_types(names: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """name, type of each distinct name: what answers (name, raw; a model's classes, optional) says, mapped to a native or extended type, else by the keywords of the name, else gene/protein."""
    n = names.select("name").where("name IS NOT NULL").distinct()
    if answers is None:
        return n.select("name", map_type(infer_type(F.col("name")), F.col("name")).alias("type"))
    raw = answers.where("name IS NOT NULL AND raw IS NOT NULL").groupBy("name").agg(F.min("raw").alias("raw"))
    return n.join(raw, "name", "left").select("name", map_type(F.coalesce("raw", infer_type(F.col("name"))), F.col("name")).alias("type"))


def typed_edges(triples: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """id, at, support, names, types and relation of triples (id, s, p, o, support, loaded_at).

    The keywords are matched once per distinct name; types join back by a broadcast if there are few names, else by a shuffle, in which AQE splits hot names.
    """
    x = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select("id", F.col("loaded_at").alias("at"), F.coalesce("support", F.lit(1)).alias("support"), "p", F.lower(trimmed(F.col("s"))).alias("x_name"), F.lower(trimmed(F.col("o"))).alias("y_name"))
    types = cut(name_types(x.select(F.explode(F.array("x_name", "y_name")).alias("name")), answers))
    few = broadcast_bounded(types)
    for side in "xy":
        x = x.join(few.select(F.col("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type")), f"{side}_name")
    return x.withColumn("r", map_relation(F.col("p"), F.col("x_type"), F.col("y_type"))).select("id", "at", "support", "x_name", "x_type", "y_name", "y_type", "r.*")


def extended_types(types: DataFrame) -> DataFrame:
    """The registry of types that are not native: type and the name that first (by name) had it."""
    return types.where(~F.col("type").isin(*R.NATIVE_TYPES)).groupBy("type").agg(F.min("name").alias("first_name"), F.count(F.lit(1)).alias("names"))


def valid_types(types: DataFrame) -> DataFrame:
    """Native and extended types: type, native."""
    native = types.sparkSession.createDataFrame([(t, True) for t in R.NATIVE_TYPES], "type string, native boolean")
    return native.unionByName(extended_types(types).select("type", F.lit(False).alias("native")))


def all_relations(edges: DataFrame) -> DataFrame:
    """Native relations and those that edges add: relation, native."""
    native = edges.sparkSession.createDataFrame([(r, True) for r in R.NATIVE_RELATIONS], "relation string, native boolean")
    return native.unionByName(edges.select("relation").where(~F.col("relation").isin(*R.NATIVE_RELATIONS)).distinct().select("relation", F.lit(False).alias("native")))


def opposite(relation: Column) -> Column:
    both = {a: b for a, b in R.OPPOSITES} | {b: a for a, b in R.OPPOSITES}
    return lookup(relation, both)


def merge_status(base: DataFrame, new: DataFrame, min_support: int = 1) -> DataFrame:
    """One row per distinct (x_name, y_name, relation) stated by new: first id, statements, status added, duplicate or conflict.

    duplicate: the base has it; conflict: the base, or new at an earlier arrival, has the opposite relation of the same directed pair
    (kept all the same). Repeats within new are counted by statements - 1 as duplicates of their own. All
    states of arrival order collapse into minima per pair and relation, so nothing is processed in sequence and a pair
    stated by a third of all rows is one row a task before the shuffle.
    """
    keys = ["x_name", "y_name", "relation"]
    now = new.where(F.col("support") >= min_support).groupBy(*keys).agg(F.min(F.struct("at", "id")).alias("first"), F.count(F.lit(1)).alias("statements"))
    old = base.select(*keys).distinct().withColumn("in_base", F.lit(True))
    x = now.join(old, keys, "left")
    before = old.select(*keys, F.lit(None).cast("struct<at:timestamp,id:bigint>").alias("first")).unionByName(now.select(*keys, "first")).where(opposite(F.col("relation")).isNotNull())
    against = before.groupBy("x_name", "y_name", opposite(F.col("relation")).alias("relation")).agg(F.max(F.col("first").isNull()).alias("always"), F.min("first").alias("since"))
    x = x.join(against, keys, "left")
    clash = F.coalesce(F.col("always") | (F.col("since") < F.col("first")), F.lit(False))
    return x.select(*keys, F.col("first.id").alias("first_id"), "statements", F.when(F.col("in_base"), "duplicate").when(clash, "conflict").otherwise("added").alias("status"))


def merge_stats(base: DataFrame, new: DataFrame, min_support: int = 1) -> DataFrame:
    """One row: total, added (conflicts included), duplicate, conflict and skipped statements of new."""
    s = merge_status(base, new, min_support).agg(
        F.coalesce(F.sum("statements"), F.lit(0)).alias("read"),
        F.count_if(F.col("status") != "duplicate").alias("added"),
        F.count_if(F.col("status") == "conflict").alias("conflict"),
    )
    t = new.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("support") < min_support).alias("skipped"))
    return t.withColumn("k", F.lit(1)).join(F.broadcast(s.withColumn("k", F.lit(1))), "k").select("total", "added", (F.col("read") - F.col("added")).alias("duplicate"), "conflict", "skipped")


def new_entities(base: DataFrame, new: DataFrame, min_support: int = 1, first_index: int | None = None) -> DataFrame:
    """Entities of new that the base has not, with dense ids in order of first arrival after the base's: name, type, index, entity_id.

    Arrival is (at, id, side); entities of triples that turn out duplicate take an id too.
    """
    def ends(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(*[F.struct(F.col(f"{s}_name").alias("name"), F.col(f"{s}_type").alias("type"), F.struct("at", "id", F.lit(i).alias("side")).alias("came")) for i, s in enumerate("xy")])).alias("n")).select("n.*")
    known = ends(base).select("name", "type").distinct()
    first = ends(new.where(F.col("support") >= min_support)).groupBy("name", "type").agg(F.min("came").alias("came")).join(known, ["name", "type"], "left_anti")
    start = known.count() if first_index is None else first_index
    return global_index(first, ["came", "name"], "index", start).select("name", "type", "index", slug(F.col("name"), "custom_entity").alias("entity_id"))


def merged_edges(base: DataFrame, new: DataFrame, min_support: int = 1) -> DataFrame:
    """Base edges and the added ones: x_name, y_name, relation, source (BASE, CUSTOM or CUSTOM|CONFLICT)."""
    keys = ["x_name", "y_name", "relation"]
    add = merge_status(base, new, min_support).where("status <> 'duplicate'")
    return base.select(*keys).distinct().withColumn("source", F.lit("BASE")).unionByName(add.select(*keys, F.when(F.col("status") == "conflict", "CUSTOM|CONFLICT").otherwise("CUSTOM").alias("source")))


#: The columns of a merged edge table; the last three are kept on demand.
MERGED_COLUMNS = ("relation", "display_relation", "x_index", "x_id", "x_type", "x_name", "x_source", "y_index", "y_id", "y_type", "y_name", "y_source", "_origins", "_support", "_input_predicate")


def entity_table(edges: DataFrame) -> DataFrame:
    """Entities of a base edge table (x_/y_ index, id, type, name, source): name, type, index, id, source; for a name and type that occurs several times the row of the greatest index."""
    sides = [F.struct(F.lower(trimmed(F.col(f"{s}_name"))).alias("name"), F.col(f"{s}_type").alias("type"), F.struct(F.col(f"{s}_index").alias("index"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_source").alias("source")).alias("e")) for s in "xy"]
    return edges.select(F.explode(F.array(*sides)).alias("n")).select("n.*").groupBy("name", "type").agg(F.max("e").alias("e")).select("name", "type", "e.*")


def next_index(edges: DataFrame) -> int:
    """The greatest x_index or y_index of a base edge table plus 1; 0 for an empty table, indexes that are no numbers count as -1."""
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(-1))
    return int(edges.agg(F.coalesce(F.max(F.greatest(number("x_index"), number("y_index"))), F.lit(-1)).alias("m")).first()["m"]) + 1


def stated(triples: DataFrame, min_support: int = 1) -> DataFrame:
    """Whole triples of at least min_support: id, at, support, p, origins and the names x and y."""
    x = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").where(F.coalesce("support", F.lit(1)) >= min_support)
    return x.select("id", F.col("loaded_at").alias("at"), F.coalesce("support", F.lit(1)).alias("support"), "p", "origins", F.lower(trimmed(F.col("s"))).alias("x"), F.lower(trimmed(F.col("o"))).alias("y"))


def align_entities(known: DataFrame, start: int, x: DataFrame, accept: float = 80.0, answers: DataFrame | None = None, rerank=None, confirm=None) -> DataFrame:
    """The alignment of merge_full: the names of x (see stated) against known (see entity_table), new ones numbered from start."""
    came = x.select(F.explode(F.array(*[F.struct(F.col(c).alias("name"), F.struct("at", "id", F.lit(i).alias("side")).alias("came")) for i, c in enumerate("xy")])).alias("n")).select("n.*").groupBy("name").agg(F.min("came").alias("came"))
    mentions = cut(came.join(name_types(came, answers), "name"))
    met = cut(align(mentions.select(F.col("name").alias("mention")), known.select(F.col("name").alias("entity")), accept, accept if rerank is None and confirm is None else 60.0, rerank, confirm))
    pick = F.min(F.struct((F.col("type") != F.col("entity_type")).alias("other"), "entity_type", "index", "id", "source")).alias("e")
    chosen = met.join(mentions.select(F.col("name").alias("mention"), "type"), "mention").join(known.select(F.col("name").alias("entity"), F.col("type").alias("entity_type"), "index", "id", "source"), "entity")
    chosen = cut(chosen.groupBy("mention", "type", "how", F.col("entity").alias("name")).agg(pick).select("mention", "type", "how", "name", "e.entity_type", "e.index", "e.id", "e.source"))
    fresh = mentions.join(chosen.select(F.col("mention").alias("name")), "name", "left_anti")
    fresh = global_index(fresh, ["came", "name"], "index", start)
    fresh = fresh.select(F.col("name").alias("mention"), "type", F.lit("new").alias("how"), "name", F.col("type").alias("entity_type"), "index", slug(F.col("name"), "custom_entity").alias("id"), F.lit("CUSTOM").alias("source"))
    return cut(chosen.select(*fresh.columns).unionByName(fresh))


def merge_full(base: DataFrame, triples: DataFrame, min_support: int = 1, accept: float = 80.0, answers: DataFrame | None = None, rerank=None, confirm=None) -> tuple[DataFrame, DataFrame]:
    """(rows, alignment): triples (id, s, p, o, origins, support, loaded_at) merged into base, an edge table of MERGED_COLUMNS[:12].

    rows has MERGED_COLUMNS and status: base rows as they are (status base), and one row per new (x, y, relation) with the index, id, type and source of both ends,
    CONFLICT added to the source of x where it contradicts an earlier statement, and the origins (a JSON list), support and predicate of its first statement.
    Each distinct name is typed and aligned once: a name that the base has, but for case, is that entity (of several types the inferred one, else the smallest);
    else the most similar name of at least accept (see retrieval.align; rerank and confirm are passed on); else it is a new entity of source CUSTOM, with the next index in order of
    first arrival and its slug as id. alignment: mention, type, how, name, entity_type, index, id, source.
    """
    x = stated(triples, min_support)
    alignment = align_entities(cut(entity_table(base)), next_index(base), x, accept, answers, rerank, confirm)
    few = broadcast_bounded(alignment)
    for s in "xy":
        x = x.join(few.select(F.col("mention").alias(s), F.col("name").alias(f"{s}_name"), F.col("entity_type").alias(f"{s}_type"), F.col("index").alias(f"{s}_index"), F.col("id").alias(f"{s}_id"), F.col("source").alias(f"{s}_source")), s)
    x = stored(x.withColumn("r", map_relation(F.col("p"), F.col("x_type"), F.col("y_type"))).select("*", "r.*").drop("r", "x", "y"))
    old = base.select(F.lower(trimmed(F.col("x_name"))).alias("x_name"), F.lower(trimmed(F.col("y_name"))).alias("y_name"), "relation")
    status = merge_status(old, x, min_support).where("status <> 'duplicate'").select(F.col("first_id").alias("id"), "status")
    row = x.join(status, "id")
    row = row.withColumns({"x_source": F.when(F.col("status") == "conflict", F.concat("x_source", F.lit("|CONFLICT"))).otherwise(F.col("x_source")), "_origins": F.coalesce(F.to_json("origins"), F.lit("[]")), "_support": F.col("support").cast("int"), "_input_predicate": trimmed(F.col("p"))})
    whole = base.select(*MERGED_COLUMNS[:12], F.lit("").alias("_origins"), F.lit(None).cast("int").alias("_support"), F.lit("").alias("_input_predicate"), F.lit("base").alias("status"))
    return whole.unionByName(row.select(*MERGED_COLUMNS, "status")), alignment
