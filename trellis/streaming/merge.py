"""Incremental merge: triples arrive in micro-batches and meet everything merged before them.

The state is an append-only Parquet table in folders batch=<id>/bucket=<hash of the pair>, so a batch reads only the buckets that its own pairs touch, and one that is run again replaces its
own folder and nothing else: after a failure the result is as if each batch had run once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellis.operators.merge import merge_status, typed_edges
from trellis.session import cut

TRIPLE = "id long, s string, p string, o string, origins array<string>, support long, loaded_at timestamp"
STATE = "x_name string, y_name string, relation string, first_id long, statements long, status string, bucket int, batch long"
#: Folders that the state is spread over by the hash of a pair; a fixed property of a state table.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("x_name", "y_name"), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """What has been merged, of batches below before if given; nothing has where the folder is not there yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], STATE)
    x = spark.read.schema(STATE).parquet(path)
    return x if before is None else x.where(F.col("batch") < before)


def merge_batch(spark: SparkSession, batch: DataFrame, batch_id: int, path: str, min_support: int = 1) -> None:
    """Merge one batch against the buckets of the state that it touches and write its part of them."""
    new = cut(typed_edges(batch).withColumn("bucket", _bucket()))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
    if not touched:
        return
    base = state(spark, path, batch_id).where(F.col("bucket").isin(touched) & (F.col("status") != "duplicate"))
    out = cut(merge_status(base, new.drop("bucket"), min_support).withColumn("bucket", _bucket()))
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")


def merge_stream(triples: DataFrame, path: str, checkpoint: str, min_support: int = 1) -> StreamingQuery:
    """Start merging a stream of triples; ends when everything there has been read."""
    return (
        triples.writeStream.foreachBatch(lambda df, i: merge_batch(df.sparkSession, df, i, path, min_support))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_triples(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the triple files below path, files_per_batch at a time."""
    return spark.readStream.schema(TRIPLE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and type; works on streams (late rows are dropped beyond the watermark) and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def fresh(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requests not answered yet: the anti join that makes a table of answers a cache."""
    return requests.select(key).distinct().join(known.select(key), key, "left_anti")
