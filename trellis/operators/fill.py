"""Missing values filled from similar records, each filled value marked with where it came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.quantiles import exact_quantiles
from trellis.session import BROADCAST_ROWS, cut, stored

#: What a text says when it only says that nothing is known or recorded, compared in lower case by letters and digits alone.
NOTHING_KNOWN = (
    "", "na", "nan", "nil", "none", "null", "unk", "unkn", "unknown", "unspecified", "unavailable", "undefined", "undetermined", "missing", "blank", "empty", "nd", "nr", "nos", "tbd", "nodata", "noinformation", "noinfo", "novalue",
    "notapplicable", "notavailable", "notknown", "notrecorded", "notreported", "notspecified", "notstated", "notgiven", "notprovided", "notdocumented", "notdetermined", "notentered", "notcollected", "notdone", "norecord", "unrecorded", "unreported", "datamissing", "valuemissing", "withheld",
)


#: White space at the ends of a value.
WHITE = " \t\n\r\f\v"


def _plain(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, r"[^\p{L}\p{Nd}]+", " "))


@dataclass(frozen=True)
class Number:
    """A numeric field: missing if null, NaN, unreadable or outside [low, high]."""

    low: float
    high: float

    def value(self, c: Column) -> Column:
        v = c.try_cast("double")
        return F.when(~F.isnan(v) & (v >= self.low) & (v <= self.high), v)


@dataclass(frozen=True)
class Category:
    """A text field: missing if null, blank or only saying that nothing is known; values in keep are never missing."""

    keep: tuple[str, ...] = ()

    def value(self, c: Column) -> Column:
        v = F.btrim(c.cast("string"), F.lit(WHITE))
        return F.when(self.known(v, _plain(v)), v)

    def known(self, v: Column, plain: Column) -> Column:
        """Whether a trimmed value says something; plain is its form for comparison: lower case, letters and digits, single blanks between."""
        says = ~F.replace(plain, F.lit(" "), F.lit("")).isin(*NOTHING_KNOWN)
        return (v.isin(*self.keep) | says) if self.keep else says


@dataclass(frozen=True)
class FillSpec:
    """fields: name to Number or Category. determinants: columns, or tuples of them, that may determine a field.
    groups: per field the group keys tried in order when no dependency answers; () is the whole table. A group
    key may be a column or one of derived (name to expression over the table's own columns). canonical: per text column a table
    (form, name) whose forms are read as one name in keys, however they are punctuated; the column itself stays."""

    id_col: str
    fields: Mapping[str, Number | Category]
    determinants: Sequence[tuple[str, ...]]
    groups: Mapping[str, Sequence[tuple[str, ...]]]
    derived: Mapping[str, Column] = field(default_factory=dict)
    canonical: Mapping[str, DataFrame] = field(default_factory=dict)
    min_confidence: float = 0.95
    min_keys: int = 20
    min_group: int = 5

    def key_sets(self) -> list[tuple[str, ...]]:
        """All determinants and groups once; a key set's place names its two hash columns."""
        return list(dict.fromkeys([*self.determinants, *[g for gs in self.groups.values() for g in gs]]))

    def levels(self) -> list[tuple[int, str, tuple[str, ...]]]:
        return [(i, name, cols) for i, (name, cols) in enumerate((f, g) for f, gs in self.groups.items() for g in gs)]


def _small(df: DataFrame) -> DataFrame:
    """df for a join that broadcasts it only if it was counted and is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prepared(df: DataFrame, spec: FillSpec) -> DataFrame:
    """row_id, f_<field> (the cleaned value, null if missing) and per key set a<i>, b<i>: 96 bits of hash of its parts, null if a part is missing."""
    # One select a step: the steps read each other's columns more than once, so they stay apart and each becomes a method of its own, small
    # enough for the compiler of the JVM, which leaves a single large one interpreted.
    parts = sorted({c for k in spec.key_sets() for c in k})
    kinds = {c: spec.fields.get(c, Category()) for c in [*spec.fields, *parts] if c not in spec.derived}
    words = [c for c, k in kinds.items() if isinstance(k, Category)]
    derived = {f"g_{c}": spec.derived[c].cast("string") for c in parts if c in spec.derived}
    x = df.select(F.col(f"`{spec.id_col}`").alias("row_id"), *[F.col(f"`{c}`").alias(f"r_{c}") for c in kinds], *[v.alias(n) for n, v in derived.items()])
    x = x.select("*", *[F.btrim(F.col(f"r_{c}").cast("string"), F.lit(WHITE)).alias(f"v_{c}") for c in words])
    x = x.select("*", *[_plain(F.col(f"v_{c}")).alias(f"p_{c}") for c in words])
    x = x.select("*", *[kinds[c].known(F.col(f"v_{c}"), F.col(f"p_{c}")).alias(f"k_{c}") for c in words])
    number = lambda c: kinds[c].value(F.col(f"r_{c}"))
    f = [(F.when(F.col(f"k_{c}"), F.col(f"v_{c}")) if c in words else number(c)).alias(f"f_{c}") for c in spec.fields]
    g = [(F.when(F.col(f"k_{c}"), F.col(f"p_{c}")) if c in words else number(c).cast("string")).alias(f"g_{c}") for c in parts if c not in spec.derived]
    x = x.select("row_id", *f, *g, *derived)
    for c, forms in spec.canonical.items():
        f = forms.select(_plain(F.col("form")).alias("__form"), _plain(F.col("name")).alias("__name")).where("__form IS NOT NULL AND __name IS NOT NULL").groupBy("__form").agg(F.min("__name").alias("__name"))
        x = x.join(_small(f), F.col(f"g_{c}") == F.col("__form"), "left").withColumn(f"g_{c}", F.coalesce("__name", f"g_{c}")).drop("__form", "__name")
    x = x.select(*[f"f_{n}" for n in spec.fields], "row_id", *[h for c in parts for h in (F.when(F.col(f"g_{c}").isNotNull(), F.xxhash64(f"g_{c}")).alias(f"x_{c}"), F.hash(f"g_{c}").alias(f"y_{c}"))])
    keys = []
    for i, cols in enumerate(spec.key_sets()):
        if len(cols) == 1:
            keys += [F.col(f"x_{cols[0]}").alias(f"a{i}"), F.col(f"y_{cols[0]}").alias(f"b{i}")]
        else:
            whole = reduce(lambda a, b: a & b, [F.col(f"x_{c}").isNotNull() for c in cols], F.lit(True))
            keys += [F.when(whole, F.xxhash64(*[F.col(f"x_{c}") for c in cols] or [F.lit(0)])).alias(f"a{i}"), F.hash(*[F.col(f"y_{c}") for c in cols] or [F.lit(0)]).alias(f"b{i}")]
    return x.select("row_id", *[f"f_{n}" for n in spec.fields], *keys)


def _keyed(x: DataFrame, spec: FillSpec, sets: Sequence[tuple[int, tuple[str, ...]]], *keep: Column) -> DataFrame:
    """One row per row and (rank, key set): keep and rank, a, b; rows without the key give none."""
    at = {cols: i for i, cols in enumerate(spec.key_sets())}
    rows = [F.when(F.col(f"a{at[c]}").isNotNull(), F.struct(F.lit(r).alias("rank"), F.col(f"a{at[c]}").alias("a"), F.col(f"b{at[c]}").alias("b"))) for r, c in sets]
    return x.select(*keep, F.explode(F.array(*rows)).alias("k")).where("k IS NOT NULL").select(*[c for c in x.select(*keep).columns], "k.rank", "k.a", "k.b")


_KEY = ["rank", "a", "b"]


def mine_dependencies(x: DataFrame, spec: FillSpec) -> tuple[DataFrame, DataFrame]:
    """Functional dependencies determinant -> field, verified over all complete records of x = prepared(df, spec).

    Returns the report (field, determinant, repeated_keys, repeated_rows, confidence, verified) and the dictionary
    (rank, a, b, field, value, seen; rank is the determinant's place). Confidence is the share of rows under keys that occur at least twice
    which agree with their key's most frequent value (of a refuted candidate: a bound that it does not exceed); a dependency is verified at min_confidence over at
    least min_keys such keys. The dictionary holds only keys with a single value, or whose most frequent value
    holds min_confidence of the key's rows (ties break to the smaller value). Keys of a single row answer nothing and are dropped at once.

    One aggregation of all determinants and fields together keeps per key the count, the least and greatest value and how many values have
    each of two hash bits set. All combine map-side, so a determinant value that holds a third of all rows is one row a task. A value that fills a share of a
    key pushes both bits' shares that far from the middle, which refutes most candidates without a look at single values; only keys
    with several values of candidates still open are counted value by value.
    """
    names = list(spec.fields)
    number = {f: isinstance(k, Number) for f, k in spec.fields.items()}
    held, sets = {f: F.col(f"f_{f}").isNotNull() for f in names}, list(enumerate(spec.determinants))
    hashed = [F.when(held[f], F.xxhash64(f"f_{f}")).alias(f"h{j}") for j, f in enumerate(names)]
    v = _keyed(x, spec, sets, *hashed, *[F.col(f"f_{f}").alias(f"v{j}") for j, f in enumerate(names) if number[f]])
    low = lambda j: f"v{j}" if number[names[j]] else f"h{j}"
    aggs = [
        g.alias(f"{n}{j}")
        for j in range(len(names))
        for n, g in (("n", F.count(f"h{j}")), ("lo", F.min(low(j))), ("hi", F.max(low(j))), ("p", F.sum(F.col(f"h{j}").bitwiseAND(1))), ("q", F.sum(F.shiftright(f"h{j}", 1).bitwiseAND(1))))
    ]
    per = cut(v.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"), *aggs).where("rows > 1"))
    one = []
    for i, j, f in [(i, j, f) for i, cols in sets for j, f in enumerate(names) if f not in cols]:
        n, pure, num, word = F.col(f"n{j}"), F.col(f"lo{j}") == F.col(f"hi{j}"), F.col(f"lo{j}") if number[f] else F.lit(None).cast("double"), F.lit(None).cast("bigint") if number[f] else F.col(f"lo{j}")
        bound = F.when(pure, n).otherwise(F.least(*[F.greatest(F.col(f"{c}{j}"), n - F.col(f"{c}{j}")) for c in "pq"]))
        one.append(F.when((F.col("rank") == i) & (n > 0), F.struct(F.lit(f).alias("field"), n.alias("n"), pure.alias("pure"), bound.alias("most"), num.alias("num"), word.alias("word"))))
    flat = per.select(*_KEY, F.explode(F.array(*one)).alias("y")).where("y IS NOT NULL").select(*_KEY, "y.*")
    bounds = flat.where("n > 1").groupBy("rank", "field").agg((F.sum("most") / F.sum("n")).alias("c"), F.count(F.lit(1)).alias("k"))
    open_ = [(r["rank"], r["field"]) for r in bounds.where((F.col("c") >= spec.min_confidence) & (F.col("k") >= spec.min_keys)).collect()]  # at most determinants times fields
    mixed = flat.where(~F.col("pure")).join(F.broadcast(x.sparkSession.createDataFrame(open_, "rank int, field string")), ["rank", "field"], "left_semi").select(*_KEY, "field")
    if open_ and not (mixed := cut(mixed)).isEmpty():
        each = [F.when(F.col(f"h{j}").isNotNull(), F.struct(F.lit(f).alias("field"), (F.col(f"v{j}") if number[f] else F.lit(None).cast("double")).alias("num"), F.col(f"h{j}").alias("word"))) for j, f in enumerate(names)]
        counts = v.join(_small(mixed.select(*_KEY).distinct()), _KEY).select(*_KEY, F.explode(F.array(*each)).alias("y")).where("y IS NOT NULL").groupBy(*_KEY, "y.field", "y.num", "y.word").agg(F.count(F.lit(1)).alias("c"))
        top = counts.groupBy(*_KEY, "field").agg(F.min(F.struct((-F.col("c")).alias("c"), "num", "word")).alias("m")).join(_small(mixed), [*_KEY, "field"], "left_semi")
        flat = flat.join(top, [*_KEY, "field"], "left")
        flat = flat.select(*_KEY, "field", "n", F.coalesce(-F.col("m.c"), "most").alias("most"), F.coalesce("m.num", "num").alias("num"), F.coalesce("m.word", "word").alias("word"))
    flat = cut(flat.select(*_KEY, "field", "n", "most", "num", "word"))
    label = F.create_map(*[y for i, cols in sets for y in (F.lit(i), F.lit("+".join(cols)))])
    report = flat.where("n > 1").groupBy("rank", "field").agg(F.count(F.lit(1)).alias("repeated_keys"), F.sum("n").alias("repeated_rows"), (F.sum("most") / F.sum("n")).alias("confidence"))
    report = cut(report.withColumn("determinant", label[F.col("rank")]).withColumn("verified", F.coalesce((F.col("confidence") >= spec.min_confidence) & (F.col("repeated_keys") >= spec.min_keys), F.lit(False))))
    ok = report.where("verified").select("rank", "field")
    kept = flat.join(F.broadcast(ok), ["rank", "field"], "left_semi").where(F.col("most") >= F.col("n") * spec.min_confidence)
    value, words = F.col("num").cast("string"), [f for f in names if not number[f]]
    if words:
        spelt = x.select(F.explode(F.array(*[F.when(held[f], F.struct(F.lit(f).alias("field"), F.xxhash64(f"f_{f}").alias("word"), F.col(f"f_{f}").alias("text"))) for f in words])).alias("y")).where("y IS NOT NULL").select("y.*").distinct()
        kept = kept.join(_small(spelt), ["field", "word"], "left")
        value = F.coalesce("text", value)
    return report, kept.select(*_KEY, "field", value.alias("value"), F.col("n").alias("seen"))


def _gaps(x: DataFrame, spec: FillSpec, pairs: Sequence[tuple[int, str, tuple[str, ...]]], always: bool) -> DataFrame:
    """row_id, field, rank, a, b for each missing value and rank; always: also one of rank -1 without a key for each missing value."""
    at = {cols: i for i, cols in enumerate(spec.key_sets())}
    none = [F.when(F.col(f"f_{f}").isNull(), F.struct(F.lit(f).alias("field"), F.lit(-1).alias("rank"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("int").alias("b"))) for f in spec.fields] if always else []
    rows = [F.when(F.col(f"f_{f}").isNull() & F.col(f"a{at[c]}").isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(r).alias("rank"), F.col(f"a{at[c]}").alias("a"), F.col(f"b{at[c]}").alias("b"))) for r, f, c in pairs]
    return x.select("row_id", F.explode(F.array(*none, *rows)).alias("k")).where("k IS NOT NULL").select("row_id", "k.*")


def _group_values(x: DataFrame, spec: FillSpec) -> DataFrame | None:
    """The value of each gap's first group with min_group records: row_id, field, rank, value, n.

    Groups are counted first, each key set once for all fields; values are looked at only in groups that some gap needs."""
    levels = spec.levels()
    if not levels:
        return None
    names, used = list(spec.fields), sorted({c for _, _, c in levels})
    place = {c: i for i, c in enumerate(used)}
    rows = _keyed(x, spec, list(enumerate(used)), *[F.col(f"f_{f}").isNotNull().alias(f"h{j}") for j, f in enumerate(names)])
    counts = rows.groupBy(*_KEY).agg(*[F.count_if(f"h{j}").alias(f"n{j}") for j in range(len(names))])
    counts = counts.where(reduce(lambda a, b: a | b, [F.col(f"n{j}") >= spec.min_group for j in range(len(names))]))
    n = reduce(lambda a, j: F.when(F.col("field") == names[j], F.col(f"n{j}")).otherwise(a), range(len(names)), F.lit(None).cast("bigint"))
    asked = _gaps(x, spec, levels, False).withColumnsRenamed({"rank": "level"})
    asked = asked.withColumn("rank", F.element_at(F.array(*[F.lit(place[c]) for _, _, c in levels]), F.col("level") + 1))
    asked = asked.join(_small(cut(counts)), _KEY).select("row_id", "field", "level", "rank", "a", "b", n.alias("n")).where(F.col("n") >= spec.min_group)
    first = F.min(F.struct("level", "rank", "a", "b", "n")).alias("m")
    chosen = cut(asked.groupBy("row_id", "field").agg(first).select("row_id", "field", "m.*"))
    needed = chosen.select("field", *_KEY).distinct()
    sets = [r[0] for r in needed.select("rank").distinct().collect()]  # key sets that answer some gap
    few = _small(needed)
    stats = None
    for which, kind in ((Number, "double"), (Category, "string")):
        mine = [f for f, k in spec.fields.items() if isinstance(k, which) and f in spec.groups]
        if not mine or not sets:
            continue
        each = F.filter(F.array(*[F.when(F.col(f"f_{f}").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"f_{f}").cast(kind).alias("v"))) for f in mine]), lambda y: y.isNotNull()).alias("each")
        v = _keyed(x, spec, [(place[c], c) for c in used if place[c] in sets], each).select(*_KEY, F.explode("each").alias("y")).select("y.field", *_KEY, "y.v").join(few, ["field", *_KEY], "left_semi")
        by = ["field", *_KEY]
        if which is Number:
            s = exact_quantiles(v, by, "v", [0.5]).select(*by, F.col("q").cast("string").alias("value"))
        else:
            s = v.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.min(F.struct((-F.col("c")).alias("c"), "v")).alias("m")).select(*by, F.col("m.v").alias("value"))
        stats = s if stats is None else stats.unionByName(s)
    return None if stats is None else chosen.join(stats, ["field", *_KEY]).select("row_id", "field", F.col("level").alias("rank"), "value", "n")


def fill_missing(df: DataFrame, spec: FillSpec) -> DataFrame:
    """One row for each missing value of the spec's fields: row_id, field_name, value (string), source, basis.

    Each missing value is left-joined to the dictionaries of the verified dependencies; of several answers the one of the
    highest confidence counts (ties: the smaller value). What they do not answer comes from the first of spec.groups that has min_group records: for
    a number the lower median, for a category the most frequent value (ties to the smaller). source is dependency (basis: the
    determinant), group (basis: the group key and the number of records), or none where nothing answers (an empty or wholly
    missing field). Values that are there are never changed and never listed. Row ids should
    be unique; rows that repeat one are filled each on their own keys and give one row together. Empty tables
    give no rows; very long texts are keys like any other, by 96 bits of hash; columns besides the named ones do not matter.
    """
    x = stored(prepared(df, spec))  # every step reads a few of its columns; cleaning is the costly part
    report, dictionary = mine_dependencies(x, spec)
    best = [(r["rank"], r["field"], r["determinant"], r["confidence"]) for r in report.where("verified").collect()]  # at most determinants times fields
    gaps = x.where(reduce(lambda a, b: a | b, [F.col(f"f_{f}").isNull() for f in spec.fields]))
    asked = _gaps(gaps, spec, [(r, f, spec.determinants[r]) for r, f, _, _ in best], True)
    got = asked.join(_small(dictionary), [*_KEY, "field"], "left") if best else asked.withColumns({"value": F.lit(None).cast("string"), "seen": F.lit(None).cast("bigint")})
    met = F.col("value").isNotNull()
    sure = F.create_map(*[y for r, f, _, c in best for y in (F.lit(f"{r} {f}"), F.lit(-c))]) if best else F.create_map(F.lit(""), F.lit(0.0))
    name = F.create_map(*[y for i, cols in enumerate(spec.determinants) for y in (F.lit(i), F.lit("+".join(cols)))]) if spec.determinants else F.create_map(F.lit(-1), F.lit(""))
    cols = ["row_id", "field", "level", "o", "basis", "value", "source"]
    found = got.select(
        "row_id", "field", F.when(met, 0).otherwise(2).alias("level"), F.when(met, F.try_element_at(sure, F.concat_ws(" ", "rank", "field"))).otherwise(0.0).alias("o"),
        F.when(met, F.concat(F.try_element_at(name, F.col("rank")), F.lit(" n="), F.col("seen"))).alias("basis"), "value", F.when(met, "dependency").otherwise("none").alias("source"),
    )
    by_group = _group_values(x, spec)
    if by_group is not None:
        label = F.create_map(*[y for i, _, c in spec.levels() for y in (F.lit(i), F.lit("+".join(c) or "all"))])
        found = found.unionByName(by_group.select("row_id", "field", F.lit(1).alias("level"), F.col("rank").cast("double").alias("o"), F.concat(label[F.col("rank")], F.lit(" n="), F.col("n")).alias("basis"), "value", F.lit("group").alias("source")))
    first = F.min(F.struct(*cols[2:])).alias("m")
    return found.groupBy("row_id", F.col("field").alias("field_name")).agg(first).select("row_id", "field_name", "m.value", "m.source", "m.basis")


def fill_table(df: DataFrame, spec: FillSpec) -> DataFrame:
    """The table itself with missing values filled: for each field also <field>_source (observed, dependency, group or none) and <field>_basis.

    Input columns of those two names are replaced. Row ids must be unique here.
    """
    wide = fill_missing(df, spec).groupBy("row_id").agg(*[F.max(F.when(F.col("field_name") == f, F.struct("value", "source", "basis"))).alias(f"__fill_{f}") for f in spec.fields])
    wide = wide.withColumnRenamed("row_id", "__fill_id")
    out = df.drop(*[c for f in spec.fields for c in (f"{f}_source", f"{f}_basis")]).join(wide, F.col(f"`{spec.id_col}`") == F.col("__fill_id"), "left")
    for f, kind in spec.fields.items():
        got = F.col(f"__fill_{f}")
        v = got["value"].cast("double" if isinstance(kind, Number) else "string")
        out = out.withColumns({f: F.when(got.isNotNull(), v).otherwise(kind.value(F.col(f"`{f}`"))), f"{f}_source": F.when(got.isNotNull(), got["source"]).otherwise("observed"), f"{f}_basis": got["basis"]})
    return out.drop("__fill_id", *[f"__fill_{f}" for f in spec.fields])


def hidden_accuracy(df: DataFrame, spec: FillSpec, share: float = 0.1, seed: int = 7) -> DataFrame:
    """How well known values come back: of a share of them, chosen by a seeded hash of row id and field, hidden at a time.

    field_name, source, n, right (share filled with the very value, of texts in lower case), near (numbers: share within a tenth of the value), error (numbers: mean distance) and base_error
    (numbers: mean distance of the median of all that was left). Everything is worked out over the whole table; row ids must be unique.
    """
    known = {f: kind.value(F.col(f"`{f}`")) for f, kind in spec.fields.items()}
    hide = lambda f: F.pmod(F.xxhash64(F.col(f"`{spec.id_col}`"), F.lit(f), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    truth = df.select(F.col(f"`{spec.id_col}`").alias("row_id"), F.explode(F.array(*[F.when(hide(f) & known[f].isNotNull(), F.struct(F.lit(f).alias("field_name"), known[f].cast("string").alias("truth"))) for f in spec.fields])).alias("t")).where("t IS NOT NULL").select("row_id", "t.*")
    masked = cut(df.withColumns({f: F.when(~hide(f), F.col(f"`{f}`")) for f in spec.fields}))
    number = [f for f, k in spec.fields.items() if isinstance(k, Number)]
    x = truth.join(fill_missing(masked, spec), ["row_id", "field_name"])
    middle = None
    if number:
        left = masked.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), spec.fields[f].value(F.col(f"`{f}`")).alias("v")) for f in number])).alias("t")).select("t.*").where("v IS NOT NULL")
        middle = exact_quantiles(left, ["field_name"], "v", [0.5]).select("field_name", F.col("q").alias("middle"))
        x = x.join(F.broadcast(middle), "field_name", "left")
    else:
        x = x.withColumn("middle", F.lit(None).cast("double"))
    is_number = F.col("field_name").isin(*number) if number else F.lit(False)
    a, b = F.col("value").try_cast("double"), F.col("truth").try_cast("double")
    right = F.when(is_number, a == b).otherwise(F.lower("value") == F.lower("truth"))
    return x.groupBy("field_name", "source").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(right, F.lit(False)).cast("int")).alias("right"), F.avg(F.when(is_number, (F.abs(a - b) <= 0.1 * F.abs(b)).cast("int"))).alias("near"),
        F.avg(F.when(is_number, F.abs(a - b))).alias("error"), F.avg(F.when(is_number, F.abs(F.col("middle") - b))).alias("base_error"),
    )


__all__ = ["NOTHING_KNOWN", "Category", "FillSpec", "Number", "fill_missing", "hidden_accuracy", "fill_table", "mine_dependencies"]
