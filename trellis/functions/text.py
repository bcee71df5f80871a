"""Scalar text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, values: Mapping[str, str]) -> Column:
    """values[key], null where absent; for tables of a fixed size."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def trimmed(c: Column) -> Column:
    """White space of any kind dropped at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_text(c: Column) -> Column:
    """Null as empty; trimmed, lower case, runs of white space as one blank."""
    return F.lower(F.regexp_replace(trimmed(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "))


def compact_text(c: Column) -> Column:
    return F.regexp_replace(norm_text(c), r"[^a-z0-9]+", "")


def slug(c: Column, default: str = "unknown") -> Column:
    """Lower case, everything but letters and digits as single underscores, default if nothing is left."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^_+|_+$", ""), F.lit("")), F.lit(default))


def norm_predicate(c: Column) -> Column:
    """Lower case, blanks and underscores as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(trimmed(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-")), r"\s+", "-"), r"-+", "-")


#: White space of any script, as a character class.
SPACE = r"[\t-\r\x1C-\x20\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

#: Passes of clean_text in their order, pattern and replacement. What is dropped is LaTeX packages, citations with and without a year, times of day
#: (alone, then with a specimen, of which the first leaves the second nothing but what it is), doses and LaTeX commands; then all but ASCII letters, digits, hyphens and slashes becomes a blank.
CLEANING = (
    (r"\\usepackage\{[^}]+\}", ""),
    (r"(?iuU)\b([a-z]+ )?(et al|al)\s*\d{4}[a-z]?\b", ""),
    (r"(?iuU)\b(et al|al)\b", ""),
    (r"(?iuU)\b\d{1,2}(\s?\d{2})?\s?(am|pm)\b", ""),
    (r"(?iuU)\b\d{1,2}(\s?\d{2})?\s?(am|pm)\s+(blood|urine|serum|plasma)\b", ""),
    (r"(?iuU)\b\d+\s?(mg|g|mcg|ug|ml|iu)\b", ""),
    (r"\\[a-zA-Z]+", ""),
    (r"[^a-zA-Z0-9\-/]+", " "),
)
#: The short variant. Fixed values.
CLEANING_SHORT = (CLEANING[0], CLEANING[6], CLEANING[7])


def clean_text(c: Column, passes=CLEANING) -> Column:
    """c after the passes, trimmed, in lower case; null stays null."""
    for pattern, by in passes:
        c = F.regexp_replace(c, pattern, by)
    return F.lower(F.trim(c))


def words(c: Column) -> Column:
    """Non-empty runs of letters, marks and digits of any script, in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{Nd}]+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


#: Plural nouns whose singular no ending tells. Fixed values.
IRREGULAR = {
    "mice": "mouse", "feet": "foot", "teeth": "tooth", "children": "child", "men": "man", "women": "woman", "vertebrae": "vertebra", "metastases": "metastasis", "diagnoses": "diagnosis", "prognoses": "prognosis",
    "bacteria": "bacterium", "criteria": "criterion", "phenomena": "phenomenon", "nuclei": "nucleus", "stimuli": "stimulus", "foci": "focus", "data": "datum", "indices": "index", "biopsies": "biopsy",
}


def singularize(c: Column, lemmas: Mapping[str, str] = IRREGULAR) -> Column:
    """Each word between blanks in the singular: by the dictionary of lemmas (a parameter), else by its ending; words in ss, us, is and of up to three letters stay."""

    def one(w: Column) -> Column:
        stays = (F.length(w) <= 3) | w.rlike("(ss|us|is)$")
        es = F.when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(x|z|ch|sh|ss)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("s$"), F.regexp_replace(w, "s$", ""))
        return F.coalesce(lookup(w, lemmas), F.when(~stays, es), w)

    return F.array_join(F.transform(tokens(F.coalesce(c, F.lit(""))), one), " ")


def ngrams(w: Column, lo: int, hi: int) -> Column:
    """All n-grams of the word array w for n in lo..hi, joined by blanks."""

    def of(x: Column, n: int) -> Column:
        if n == 1:
            return x
        at = F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(x, i, n), " "))

    # the array is bound once as a lambda's variable; else every n-gram would split the text again
    return F.flatten(F.flatten(F.transform(F.array(w), lambda x: F.array(*[of(x, n) for n in range(lo, hi + 1)]))))


def verbalise(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("("), s, F.lit(", "), p, F.lit(", "), o, F.lit(")"))


def pretty_name(kind: Column, name: Column) -> Column:
    """Genes in capitals, other names with capital initials (of words parted by blanks)."""
    return F.when(kind == "gene/protein", F.upper(name)).otherwise(F.initcap(name))


def json_list(c: Column) -> Column:
    """A JSON list's trimmed non-blank texts; anything else is the empty list."""
    items = F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), trimmed)
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def flexible_list(c: Column) -> Column:
    """A JSON list, else one with single quotes, else parts between | ; and commas; trimmed, blanks dropped."""
    t = F.trim(F.coalesce(c, F.lit("")))
    quoted = F.when(F.startswith(t, F.lit("[")), F.from_json(F.translate(t, "'", '"'), "array<string>"))
    plain = F.split(F.regexp_replace(t, r"[\[\]'\"]", ""), r"[|;,]")
    return F.filter(F.transform(F.coalesce(F.from_json(t, "array<string>"), quoted, plain), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def p_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def count_label(n: Column) -> Column:
    """1234567 as 1.23M, 12345 as 12.3K, 123 as 123."""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 2), F.lit("M"))).when(n >= 1_000, F.concat(F.format_number(n / 1_000, 1), F.lit("K"))).otherwise(n.cast("string"))
