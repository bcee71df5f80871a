"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte-level BPE for many languages; any rank file of this form will do.
VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_multi_50k.tiktoken")
#: The pattern that splits text before the merges; part of the public vocabulary's definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Largest piece handed to the encoder at once, in characters; cut only where the pattern never joins.
PIECE = 100_000


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """A broadcast of the vocabulary file's bytes (about 1 MB, whatever the data): workers need no path of their own."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_ENCODERS: dict[int, object] = {}


def encoder(data: bytes):
    """Built once a worker."""
    import tiktoken

    key = hash(data)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def pieces(s: str) -> Iterator[str]:
    """s in pieces of about PIECE characters, cut only before a blank that follows a character other than white space, where no token reaches across; a longer run without such a place stays whole."""
    at = 0
    while len(s) - at > PIECE:
        end = at + PIECE
        cut = next((i for i in range(end, at + PIECE // 2, -1) if s[i] == " " and not s[i - 1].isspace()), None)
        if cut is None:
            cut = next((i for i in range(end + 1, len(s)) if s[i] == " " and not s[i - 1].isspace()), len(s))
        yield s[at:cut]
        at = cut
    if at < len(s) or not s:
        yield s[at:]


def count_tokens(enc, s: str) -> int:
    s = s.encode("utf-8", "replace").decode()
    return sum(len(enc.encode_ordinary(p)) for p in pieces(s))


def sized(df: DataFrame, text_col: str, vocabulary_path: str = VOCABULARY, distinct: bool = False) -> DataFrame:
    """df without its text, with __tokens (int, 0 for a null or empty text) and __same (128-bit digest of the text).

    Each text is read whole, once per distinct value of a batch; the text leaves the plan here. Sizes are those of
    the whole text, however long its unbroken runs are.
    """
    import hashlib

    voc = vocabulary(df.sparkSession, vocabulary_path)
    rest = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(voc.value)
        for b in batches:
            d = b.column(len(rest)).dictionary_encode()
            values = d.dictionary.to_pylist()
            n = pa.array([count_tokens(enc, v) for v in values], pa.int32()).take(d.indices).fill_null(0)
            h = pa.array([hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).digest() for v in values], pa.binary()).take(d.indices)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(rest))], n, h], names=[*rest, "__tokens", "__same"])

    x = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1]) + ", __tokens int, __same binary"
    return x.mapInArrow(run, schema)
