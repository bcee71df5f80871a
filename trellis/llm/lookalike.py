"""Text that looks the same brought to one form.

normal() composes: removal of invisible characters, white space mapped to the plain blank, compatibility
decomposition, letters of other scripts replaced by the Latin letter they are shaped like, composition. On top of it
the search form folds case. Both are worked out once per distinct value of a batch.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.session import cut

#: Letters of other scripts that have the shape of a Latin letter, and that letter. Fixed values.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "ԍ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Ա": "U", "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "ց": "g", "հ": "h", "զ": "q",
}
#: Signs that composition leaves and that look like an ASCII one: hyphens and the slash within a fraction. Fixed values.
SIGNS = {"‐": "-", "‑": "-", "⁄": "/"}
#: Code points without any shape of their own (default-ignorable), as ranges. Fixed values.
INVISIBLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


class _Table(dict):
    """A translation that works a character out when it first occurs."""

    def __init__(self, others: Mapping[str, str]):
        self.others = others

    def __missing__(self, cp: int) -> str | None:
        out = self[cp] = self.of(chr(cp), cp)
        return out

    def of(self, c: str, cp: int) -> str | None:
        if cp < 0x80:
            return c
        if any(a <= cp <= b for a, b in INVISIBLE):
            return None
        if unicodedata.category(c) == "Zs":
            return " " if cp != 0x1680 else c  # that one is drawn as a line
        how = unicodedata.decomposition(c)
        if how.startswith(("<super>", "<sub>")) and unicodedata.normalize("NFKD", c).isdigit():
            return c  # a raised or lowered digit is not the plain one
        apart = unicodedata.normalize("NFKD", c)
        if how.startswith("<compat> 0020"):
            return c  # an accent standing alone
        return "".join(SIGNS.get(x) or LOOKALIKES.get(x) or self.others.get(x, x) for x in apart)


def confusables(path: str) -> dict[str, str]:
    """Further letters with the shape of an ASCII letter, read from a file of the public confusables data (lines source ; target ; type # comment).

    Only single letters outside ASCII whose target is one ASCII letter of the same case are taken, and no lower-case Greek
    ones, most of which have a shape of their own that the data sets equal to a Latin letter.
    """
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [p.strip() for p in line.split("#")[0].split(";")]
            if len(parts) < 2 or " " in parts[0] or " " in parts[1] or not parts[0] or not parts[1]:
                continue
            c, t = chr(int(parts[0], 16)), chr(int(parts[1], 16))
            greek = unicodedata.name(c, "").startswith("GREEK SMALL")
            if c.isalpha() and not c.isascii() and t.isascii() and t.isalpha() and c.isupper() == t.isupper() and not greek:
                out[c] = t
    return out


_TABLES: dict[frozenset, _Table] = {}


def table_of(others: Mapping[str, str] | None = None) -> _Table:
    key = frozenset((others or {}).items())
    if key not in _TABLES:
        _TABLES[key] = _Table(dict(key))
    return _TABLES[key]


def normal(s: str, table: _Table | None = None) -> str:
    """The one form of all texts that look like s; case, accents, raised digits and ASCII characters stay as they are."""
    if s.isascii():
        return s
    return unicodedata.normalize("NFC", s.translate(table_of() if table is None else table))


def folded(s: str, table: _Table | None = None) -> str:
    """normal(s) in full case folding, composed again."""
    n = normal(s, table).casefold()
    return n if n.isascii() else unicodedata.normalize("NFC", n)


def normalised(df: DataFrame, column: str, into: str | None = None, fold: bool = True, others: Mapping[str, str] | None = None) -> DataFrame:
    """df with column (or into) holding the one form of each text; fold also folds case, others are further look-alike letters (see confusables). Null stays null."""
    pairs = dict(others or {})

    @F.pandas_udf(T.StringType())
    def form(values: pd.Series) -> pd.Series:
        table, f = table_of(pairs), folded if fold else normal
        codes, uniques = pd.factorize(values)  # once per distinct value
        done = [f(u, table) for u in uniques]
        return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)

    return df.withColumn(into or column, form(F.col(f"`{column}`").cast("string")))


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_PRINTS = pa.schema([("id", pa.int64()), ("look", pa.binary()), ("exact", pa.binary()), ("text", pa.binary())])


def fingerprints(df: DataFrame, id_col: str, column: str, others: Mapping[str, str] | None = None) -> DataFrame:
    """id, and 128-bit digests of each non-null text: look (its folded form), exact (its form with case) and text (itself). Texts stay where they are."""
    pairs = dict(others or {})

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(pairs)
        for b in batches:
            d = b.column(1).dictionary_encode()
            looks, exacts, texts = [], [], []
            for v in d.dictionary.to_pylist():
                n = normal(v, table)
                c = n.casefold()
                looks.append(_digest(c if c.isascii() else unicodedata.normalize("NFC", c)))
                exacts.append(_digest(n))
                texts.append(_digest(v))
            at = d.indices
            yield pa.record_batch([b.column(0), *[pa.array(x, pa.binary()).take(at) for x in (looks, exacts, texts)]], schema=_PRINTS)

    x = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{column}`").cast("string").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return x.mapInArrow(prints, "id bigint, look binary, exact binary, text binary")


def same_looking(df: DataFrame, id_col: str, column: str, others: Mapping[str, str] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of ids whose texts differ but look the same.

    Candidates agree in the operator's folded form; the exact check then holds their forms with case, in which
    raised digits, accents and Greek letters of their own shape differ. Equal texts are no case, nor are null
    texts; an empty text and one of invisible characters alone look the same. Equal texts collapse to one row each before anything is paired, so
    plain repeats are never compared: of a class the different texts are paired, and only those pairs are given out for each
    of their documents. A class that holds a third of all rows is split by Spark's skew join, its pairs being the result asked for.
    """
    x = cut(fingerprints(df, id_col, column, others))  # 56 bytes a row, so that texts are read once
    texts = x.select("look", "exact", "text").distinct()  # combines map-side
    mixed = texts.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look", "exact")
    texts = cut(texts.join(mixed, ["look", "exact"], "left_semi"))
    a, b = (texts.select("look", "exact", F.col("text").alias(t)) for t in ("ta", "tb"))
    pairs = a.join(b, ["look", "exact"]).where("ta < tb").select("ta", "tb")
    docs = x.join(texts.select("text"), "text", "left_semi").select("id", "text")
    met = pairs.join(docs.withColumnsRenamed({"id": "i", "text": "ta"}), "ta").join(docs.withColumnsRenamed({"id": "j", "text": "tb"}), "tb")
    return met.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def look_classes(df: DataFrame, id_col: str, column: str, others: Mapping[str, str] | None = None) -> DataFrame:
    """One row per id with a text: id, class_id (the smallest id of those that look the same) and variants (different texts in the class)."""
    x = cut(fingerprints(df, id_col, column, others))
    sizes = x.groupBy("look", "exact", "text").agg(F.min("id").alias("id")).groupBy("look", "exact").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("variants"))
    return x.join(sizes, ["look", "exact"]).select("id", "class_id", "variants")


__all__ = ["INVISIBLE", "LOOKALIKES", "SIGNS", "confusables", "fingerprints", "folded", "look_classes", "normal", "normalised", "same_looking"]
