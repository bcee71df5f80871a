"""Structured answers read out of model text: triples, objects, scores, and whatever is complete of a truncated list."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in "spo"]))
_FENCE = re.compile(r"```[a-zA-Z]*\s*|```")


def rescue_array(text: str | None) -> list:
    """The values of the first JSON array in text: whole if it parses, else every complete value before it breaks off; code fences do not matter."""
    if not text:
        return []
    t = _FENCE.sub("", text).strip()
    try:
        got = json.loads(t)
        return got if isinstance(got, list) else [got] if isinstance(got, dict) else []
    except ValueError:
        pass
    at = t.find("[")
    if at < 0 or 0 <= t.find("{") < at:
        obj = first_object(t)
        if isinstance(obj, dict) or at < 0:
            return [obj] if obj is not None else []
    reader, out, i = json.JSONDecoder(), [], at + 1
    while i < len(t):
        while i < len(t) and t[i] in " \t\r\n,":
            i += 1
        if i >= len(t) or t[i] == "]":
            break
        try:
            v, i = reader.raw_decode(t, i)
        except ValueError:
            break
        out.append(v)
    return out


def first_object(text: str | None):
    """The first JSON object in text that parses, else the first array, else None."""
    t = _FENCE.sub("", text or "")
    for opening in "{[":
        for m in re.finditer(re.escape(opening), t):
            try:
                return json.JSONDecoder().raw_decode(t, m.start())[0]
            except ValueError:
                continue
    return None


def as_triples(values: list) -> list[dict]:
    """Dicts with s, p and o as texts; a list-valued o is joined by commas; others are dropped one by one."""
    out = []
    for v in values:
        if isinstance(v, dict) and all(v.get(k) not in (None, "", []) for k in "spo"):
            out.append({k: ", ".join(map(str, v[k])) if isinstance(v[k], list) else str(v[k]) for k in "spo"})
    return out


#: What stands for an answer of which nothing can be read. Fixed values.
PARSE_ERROR = {"s": "None", "p": "None", "o": "ParseError"}


def strict_triples(text: str | None) -> list[dict]:
    """The triples of the first list of objects in text, code fences aside; an answer without a readable one gives the parse-error triple."""
    m = re.search(r"\[\s*\{.*?\}\s*\]", _FENCE.sub("", text or ""), re.S)
    try:
        return as_triples(json.loads(m[0])) if m else [dict(PARSE_ERROR)]
    except ValueError:
        return [dict(PARSE_ERROR)]


@F.pandas_udf(TRIPLES)
def rescued_triples(text: pd.Series) -> pd.Series:
    return text.map(lambda t: as_triples(rescue_array(t)))


#: The four rubric scores of a judge, in their order. Fixed values.
SCORES = ("relevancy", "coverage", "convincity", "factuality")


def parse_scores(text: str | None) -> dict[str, float]:
    """Scores by name from a JSON object (keys in any case), else from lines Name: number; 0 where there is none."""
    obj = first_object(text)
    low = {str(k).lower(): v for k, v in obj.items()} if isinstance(obj, dict) else {}
    out = {}
    for name in SCORES:
        v = low.get(name)
        if not isinstance(v, (int, float)):
            m = re.search(rf"{name}[\s:*\-]+(\d+(?:\.\d+)?)", text or "", re.I)
            v = float(m[1]) if m else 0.0
        out[name] = float(v)
    return out


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SCORES]))
def judge_scores(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_scores(t) for t in text], columns=list(SCORES), dtype="float64")


def triples_of(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row per triple that the texts hold."""
    return df.select(*keep, F.explode(rescued_triples(F.col(text_col))).alias("t")).select(*keep, "t.*")


def parse_graph_log(df: DataFrame) -> DataFrame:
    """Relationship records of an extraction log (column value): head, tail, description, weight.

    Records are parted by ##, fields by <|>; fences, parentheses and quotes are dropped; a record needs four fields; the
    weight defaults to 1; repeats of (head, tail, description) count once.
    """
    rec = F.explode(F.split(F.regexp_replace("value", r"```[a-z]*", ""), r"##|\n"))
    f = F.transform(F.split(F.regexp_replace(F.col("r"), r"[()]", ""), r"<\|>"), lambda x: F.regexp_replace(F.trim(x), r"^[\"']+|[\"']+$", ""))
    x = df.select(rec.alias("r")).select(f.alias("f")).where((F.size("f") >= 4) & (F.lower(F.col("f")[0]) == "relationship"))
    weight = F.coalesce(F.when(F.size("f") >= 5, F.col("f")[4]), F.lit("1"))
    return x.groupBy(F.col("f")[1].alias("head"), F.col("f")[2].alias("tail"), F.col("f")[3].alias("description")).agg(F.min(weight).alias("weight"))


def answers(df: DataFrame, prompt_col: str, backend, into: str = "answer", retries: int = 3, delay: float = 0.0) -> DataFrame:
    """df with a model's answer to each prompt; backend.complete(list of prompts) -> list of texts.

    Equal prompts of a batch are asked once. A failed batch is asked again after delay seconds, up to retries times in all; if it fails still, its answers are null and the last error is in
    <into>_error, so that nothing is lost in silence.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType()), T.StructField(f"{into}_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes, prompts = pd.factorize(b[prompt_col])
            got, error = [None] * len(prompts), None
            for attempt in range(retries):
                try:
                    got, error = backend.complete(list(prompts)), None
                    break
                except Exception as e:  # noqa: BLE001 - whatever a model client raises
                    error = f"{type(e).__name__}: {e}"
                    if attempt + 1 < retries:
                        time.sleep(delay)
            yield b.assign(**{into: [got[c] if c >= 0 else None for c in codes], f"{into}_error": error})

    return df.mapInPandas(run, schema)


@F.udtf(returnType="s: string, p: string, o: string")
class RescueTriples:
    """rescue_triples(text) as a table function: one row per complete triple of a text."""

    def eval(self, text: str):
        for t in as_triples(rescue_array(text)):
            yield t["s"], t["p"], t["o"]
