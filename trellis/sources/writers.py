"""Writers. Files are written in parallel, one per partition; nothing is gathered to make a single file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.ranking import global_index


def concepts(df: DataFrame, path: str) -> None:
    """id|concept without a header."""
    df.select("id", "concept").write.mode("overwrite").option("sep", "|").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def spo(df: DataFrame, path: str) -> None:
    json_lines(df.select("s", "p", "o"), path)


def fused(df: DataFrame, path: str) -> None:
    """Fused triples with dense ids from 0 in the order of (s, p, o)."""
    json_lines(global_index(df, ["s", "p", "o"], "id", 0), path)


def edges(base: DataFrame, new: DataFrame, path: str) -> None:
    """The base and new edges together, and the new ones apart under new_triples."""
    base.unionByName(new, allowMissingColumns=True).write.mode("overwrite").option("header", "true").csv(f"{path}/merged")
    new.write.mode("overwrite").option("header", "true").csv(f"{path}/new_triples")


def table(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite").option("header", "true")
    (w.partitionBy(partition) if partition else w).csv(path)


def report(df: DataFrame, path: str) -> None:
    """A one-row report as one JSON object."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def slices(df: DataFrame, path: str) -> None:
    """One folder of CSV files for each slice of ablation.stage_slices."""
    table(df, path, "slice")


def explanation(nodes: DataFrame, edges: DataFrame, paths: DataFrame, summary: DataFrame, path: str) -> None:
    """Nodes, edges and paths (nested columns as JSON) as CSV, and a one-row summary as JSON."""
    table(nodes, f"{path}/nodes")
    table(edges, f"{path}/edges")
    flat = paths.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in paths.schema.fields])
    table(flat, f"{path}/paths")
    report(summary, f"{path}/summary")
