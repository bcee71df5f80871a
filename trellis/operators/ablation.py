"""Survival models over feature sets, compared fold by fold.

The model at hand is a sum of hazards: in the training folds each value of each feature has a rate of events per time, and a record's risk is the
sum of the logarithms of its values' rates against the overall rate. All folds come out of one aggregation: what a fold
trains on is the total less the fold itself. Another model can be put in its place by a function over the same tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.operators.ranking import stratified_folds
from trellis.operators.survival import concordance
from trellis.session import BROADCAST_ROWS, broadcast_bounded, cut

#: Models and the groups of features each uses beside the clinical ones. Fixed values.
MODELS = {
    "clinical_only": (),
    "clinical_kg": ("kg",),
    "clinical_molecular": ("molecular",),
    "clinical_molecular_kg": ("molecular", "kg"),
    "clinical_treatment_molecular": ("treatment", "molecular"),
    "clinical_treatment_molecular_kg": ("treatment", "molecular", "kg"),
}


def infer_splits(classes: Sequence[int], wanted: int) -> int:
    """Folds that every class can fill: at most its smallest class, at least 2; fewer than 2 records of a class are an error."""
    if len(classes) < 2 or min(classes) < 2:
        raise ValueError(f"classes of {list(classes)} records cannot be split")
    return max(2, min(wanted, min(classes)))


def datasets(df: DataFrame, cancer: str = "cancer_type", stage: str = "stage_group", event: str = "event", min_rows: int = 20, min_class: int = 2) -> DataFrame:
    """df once for each dataset it is in, as dataset: all_cancers, its cancer, and its cancer - stage group; subsets of fewer than min_rows rows or min_class rows of an outcome are left out."""
    names = F.array(F.lit("all_cancers"), F.col(cancer), F.when(F.col(stage).isNotNull(), F.concat(F.col(cancer), F.lit(" - "), F.col(stage))))
    x = df.select("*", F.explode(F.array_compact(F.array_distinct(names))).alias("dataset"))
    fit = x.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("e")).where((F.col("n") >= min_rows) & (F.least(F.col("e"), F.col("n") - F.col("e")) >= min_class)).select("dataset")
    return x.join(broadcast_bounded(cut(fit)), "dataset", "left_semi")


def with_folds(x: DataFrame, key: str, event: str = "event", wanted: int = 5, seed: int = 42) -> DataFrame:
    """x with fold: per dataset stratified by event; a dataset whose smaller class has fewer than wanted records has as many folds as that, at least 2."""
    k = x.groupBy("dataset").agg(F.greatest(F.lit(2), F.least(F.lit(wanted), F.least(F.sum(event), F.count(F.lit(1)) - F.sum(event)))).cast("int").alias("__k"))
    y = x.join(broadcast_bounded(cut(k)), "dataset").withColumn("__class", F.concat_ws("|", "dataset", event))
    return stratified_folds(y, "__class", key, F.col("__k"), seed).drop("__class", "__k")


def _with_weights(long: DataFrame, per: DataFrame, by: Sequence[str], most: int | None = None) -> DataFrame:
    """long joined to per (by, ws, and n, how many rows of long have it): the commonest of per, as many as may be broadcast, by broadcast; only rows of the others are shuffled, and those are alike rare."""
    most = BROADCAST_ROWS if most is None else most
    if per.count() <= most:
        return long.join(F.broadcast(per.drop("n")), list(by))
    power, room, least = F.floor(F.log2("n")).cast("int"), most, 64
    for p, count in sorted(map(tuple, per.groupBy(power.alias("p")).count().collect()), reverse=True):  # a row for each power of two
        if (room := room - count) < 0:
            break
        least = p
    x = long.join(F.broadcast(per.where(power >= least).drop("n")), list(by), "left")
    rare = x.where("ws IS NULL").drop("ws").join(per.where(power < least).drop("n"), list(by))
    return x.where("ws IS NOT NULL").unionByName(rare)


def hazard_risks(x: DataFrame, features: Mapping[str, Sequence[str]], key: str, time: str = "time", event: str = "event") -> DataFrame:
    """dataset, fold, model, key, time, event, risk: each record's risk under each of MODELS, trained on the other folds of its dataset.

    features: group (clinical, treatment, molecular, kg) to its columns, all read as text; null is a value. A value's rate is (events + 1) over
    (time + 1 / the overall rate) of the training folds, so one that they do not have counts as average. Counts combine map-side; a value that a third of all records share is one row a task,
    and its weights reach them by broadcast (_with_weights).
    """
    cols = [(g, c) for g, cs in features.items() for c in cs]
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("?")).alias("value")) for i, (_, c) in enumerate(cols)])).alias("v")
    base = cut(x.select("dataset", "fold", F.col(key).alias("key"), F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"), *dict.fromkeys(c for _, c in cols)))
    long = base.select("dataset", "fold", "key", "time", "event", value).select("dataset", "fold", "key", "time", "event", "v.*")
    of = lambda *by: (F.sum("e").over(Window.partitionBy(*by)) - F.col("e"), F.sum("t").over(Window.partitionBy(*by)) - F.col("t"))
    total = base.groupBy("dataset", "fold").agg(F.sum("event").alias("e"), F.sum("time").alias("t"))
    e, t = of("dataset")
    total = total.select("dataset", "fold", (e / t).alias("rate"))
    by = ["dataset", "feature", "value"]
    per = long.groupBy(*by, "fold").agg(F.sum("event").alias("e"), F.sum("time").alias("t"), F.count(F.lit(1)).alias("n"))
    e, t = of(*by)
    per = per.select(*by, "fold", e.alias("e"), t.alias("t"), "n").join(broadcast_bounded(total), ["dataset", "fold"])
    rate = F.when(F.col("rate") > 0, F.ln((F.col("e") + 1) / (F.col("t") + 1 / F.col("rate")) / F.col("rate"))).otherwise(0.0)
    per = cut(per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("fold", rate.alias("w")))).alias("ws"), F.sum("n").alias("n")))
    weighed = _with_weights(long, per, by).withColumn("w", F.element_at("ws", F.col("fold")))
    uses = {m: [i for i, (g, _) in enumerate(cols) if g in ("clinical", *more)] for m, more in MODELS.items()}
    scored = weighed.groupBy("dataset", "fold", "key").agg(F.first("time").alias("time"), F.first("event").alias("event"), *[F.sum(F.when(F.col("feature").isin(*ix), F.col("w")).otherwise(0.0)).alias(m) for m, ix in uses.items()])
    return scored.select("dataset", "fold", "key", "time", "event", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(m, 6).alias("risk")) for m in MODELS])).alias("m")).select("dataset", "fold", "m.model", "key", "time", "event", "m.risk")


def fold_metrics(risks: DataFrame) -> DataFrame:
    """dataset, fold, model, n_test, concordant, tied, comparable and c_index (null without a comparable pair) over the records of each test fold."""
    by = ["dataset", "fold", "model"]
    n = risks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"))
    return n.join(concordance(risks, "time", "event", "risk", keys=by), by).select(*by, "n_test", "concordant", "tied", "comparable", "c_index")


def stage_slices(predictions: DataFrame, cancers: Sequence[str], stages: Sequence[str] = ("Stage I-III", "Stage IV")) -> DataFrame:
    """Out-of-fold predictions (dataset, cancer_type, stage_group and more) cut into the files that are written of them: each row once for each slice it is in, as slice.

    Slices per cancer: <cancer>_oof_predictions_all_models, <cancer>_main_dataset_oof_predictions (rows of the dataset of that name), and both for each stage group, by slugs.
    """
    from trellis.functions.text import slug

    c = slug(F.col("cancer_type"))
    st = F.concat(c, F.lit("_"), slug(F.col("stage_group")))
    staged = F.col("stage_group").isin(*stages)
    of_dataset = F.array(*[F.when(F.col("dataset") == n, F.lit(n)) for n in cancers])
    main = F.when(F.size(F.array_compact(of_dataset)) > 0, F.concat(slug(F.col("dataset")), F.lit("_main_dataset_oof_predictions")))
    main_stage = F.when(F.col("dataset").isin(*[f"{n} - {s}" for n in cancers for s in stages]), F.concat(slug(F.col("dataset")), F.lit("_main_dataset_oof_predictions")))
    listed = F.col("cancer_type").isin(*cancers)
    slices = F.array(F.when(listed, F.concat(c, F.lit("_oof_predictions_all_models"))), main, F.when(listed & staged, F.concat(st, F.lit("_oof_predictions_all_models"))), main_stage)
    return predictions.select("*", F.explode(F.array_compact(slices)).alias("slice"))
