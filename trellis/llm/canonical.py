"""Free-entered values mapped to the entries of a reference list, misses reported.

A symmetric-delete dictionary of the reference forms (terms and aliases) is broadcast to the workers. Values are counted
first, each distinct one that is no term is looked up once, and the answers are joined back to the rows.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.session import BROADCAST_ROWS, bounded, cut

#: Reference rows that one dictionary may hold; a longer list is looked up block by block, each of this size.
BLOCK_TERMS = 20_000
#: Words that a dictionary remembers having weighed; beyond that it starts anew.
REMEMBERED = 100_000
#: Different words that all forms of the reference may have; the blocks of a long list share them. More are an error.
MOST_WORDS = 5_000_000
#: Leading characters that the delete neighbourhoods are made of.
PREFIX = 12
#: Neighbours on a keyboard, row by row; a slip to one costs less than another letter.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
def _near() -> frozenset[tuple[str, str]]:
    out = set()
    for r, row in enumerate(KEY_ROWS):
        for i, a in enumerate(row):
            near = [*row[max(0, i - 1) : i + 2]]
            if r + 1 < len(KEY_ROWS):
                near += [*KEY_ROWS[r + 1][max(0, i - 1) : i + 1]]
            out |= {(a, b) for b in near if b != a} | {(b, a) for b in near if b != a}
    return frozenset(out)


NEAR = _near()


def edits_allowed(n: int) -> int:
    """Edits that a form of n letters and digits may take: codes of up to four none."""
    return 0 if n <= 4 else 1 if n <= 6 else 2 if n <= 24 else 3


def damerau(a: str, b: str, most: int) -> tuple[int, float] | None:
    """(edits, weighted edits) of the restricted Damerau-Levenshtein distance, or None beyond most edits.

    Insertion, deletion, substitution and the exchange of neighbours are one edit each; the weights make an
    exchange 0.7, a doubled or dropped double letter 0.6, a neighbouring key 0.8 and the rest 1. Only a band
    of most cells about the diagonal is computed.
    """
    if a == b:
        return 0, 0.0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    far = (most + 1, 1e9)
    before: list[tuple[int, float]] = []
    row = [(j, float(j)) if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        last, row, best = row, [far] * (m + 1), most + 1
        if i <= most:
            row[0] = (i, float(i))
            best = i
        x = a[i - 1]
        for j in range(max(1, i - most), min(m, i + most) + 1):
            y = b[j - 1]
            if x == y:
                c = last[j - 1]
            else:
                p, q, r = last[j - 1], last[j], row[j - 1]
                c = min((p[0] + 1, p[1] + (0.8 if (x, y) in NEAR else 1.0)), (q[0] + 1, q[1] + (0.6 if i > 1 and a[i - 2] == x else 1.0)), (r[0] + 1, r[1] + (0.6 if j > 1 and b[j - 2] == y else 1.0)))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    t = before[j - 2]
                    c = min(c, (t[0] + 1, t[1] + 0.7))
            row[j] = c
            best = min(best, c[0])
        if best > most:
            return None
        before = last
    return row[m] if row[m][0] <= most else None


def deletes(s: str, most: int) -> set[str]:
    """s and everything left of its prefix after up to most deletions."""
    s = s[:PREFIX]
    out, level = {s}, {s}
    for _ in range(min(most, len(s))):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out |= level
    return out


def words(s: str) -> list[str]:
    """Runs of letters and digits, in folded case, without accents, in compatibility form."""
    s = unicodedata.normalize("NFKD", s).casefold()
    return "".join(c if c.isalnum() else " " for c in s if not unicodedata.combining(c)).split()


@dataclass(frozen=True)
class Form:
    ref_id: int
    text: str  # words joined
    tokens: tuple[str, ...]
    freq: int


class Dictionary:
    """The forms of one field with their delete neighbourhoods."""

    def __init__(self, rows: Sequence[tuple[int, str, Sequence[str], int]], longest: int = 0, vocabulary: Iterable[str] | None = None):
        """rows: ref_id, term, aliases, how often the term occurs as such; longest and vocabulary: words of the field's longest form and of all its forms, where rows are a block of it."""
        self.forms = [Form(ref, "".join(w), tuple(w), freq) for ref, term, aliases, freq in rows for t in (term, *(aliases or ())) if t and (w := words(t))]
        self.exact: dict[str, list[Form]] = defaultdict(list)
        self.bag: dict[tuple[str, ...], list[Form]] = defaultdict(list)
        self.near: dict[str, list[Form]] = defaultdict(list)
        self.starts: dict[str, list[Form]] = defaultdict(list)
        self.weight = set(vocabulary) if vocabulary is not None else {w for f in self.forms for w in f.tokens}  # words that count
        self.weighed: dict[str, bool] = {}
        self.near_word: dict[str, set[str]] = defaultdict(set)
        for f in self.forms:
            self.exact[f.text].append(f)
            self.bag[tuple(sorted(f.tokens))].append(f)
            for d in deletes(f.text, edits_allowed(len(f.text))):
                self.near[d].append(f)
            for w in f.tokens if len(f.tokens) > 1 else ():
                self.starts[w[0]].append(f)
        for w in self.weight:
            for d in deletes(w, edits_allowed(len(w))):
                self.near_word[d].add(w)
        self.longest = max(longest, max((len(f.tokens) for f in self.forms), default=0))
        self.letters = max((len(f.text) for f in self.forms), default=0) + 3

    @staticmethod
    def _offer(forms, cost, stage: int, length: int = 0, run: int = 0) -> tuple:
        c, f = min(((cost(f), f) for f in forms), key=lambda x: (x[0], -x[1].freq, x[1].ref_id))
        return stage, c, -length, run, -f.freq, f.ref_id

    def _edited(self, text: str, stage: int, length: int = 0, run: int = 0) -> tuple | None:
        most = edits_allowed(len(text) + 1)
        if not most or len(text) > self.letters:
            return None
        seen = {id(f): f for d in deletes(text, most) for f in self.near.get(d, ())}
        met = {id(f): (d[1], f) for f in seen.values() if (d := damerau(text, f.text, edits_allowed(len(f.text))))}
        return self._offer([f for _, f in met.values()], lambda f: met[id(f)][0], stage, length, run) if met else None

    def _weighs(self, word: str) -> bool:
        """A word has weight if it is in some form of the field, or within the allowed edits of one that is; a word with a digit only if it is in one."""
        if word in self.weight:
            return True
        if word not in self.weighed:
            if len(self.weighed) >= REMEMBERED:
                self.weighed.clear()
            self.weighed[word] = self._near_weight(word)
        return self.weighed[word]

    def _near_weight(self, word: str) -> bool:
        most = edits_allowed(len(word) + 1)
        if not most or any(c.isdigit() for c in word) or len(word) > self.letters:
            return False
        return any(damerau(word, x, edits_allowed(len(x))) for x in {x for d in deletes(word, most) for x in self.near_word.get(d, ())})

    def _shortened(self, tokens: list[str]) -> set[int]:
        """The terms whose words these are, in order, some of them cut short or without inner letters (neopl, ca, jct, r); one word must be whole."""

        def short(x: str, y: str) -> bool:
            rest = iter(y)
            return x[0] == y[0] and all(c in rest for c in x)

        same = {id(f): f for w in tokens for f in self.starts.get(w[0], ()) if len(f.tokens) == len(tokens)}
        return {f.ref_id for f in same.values() if any(x == y for x, y in zip(tokens, f.tokens)) and all(x == y or short(x, y) for x, y in zip(tokens, f.tokens))}

    def find(self, value: str) -> tuple[int, float, str]:
        """(ref_id, weighted edits, how); ref_id 0 if the value means no entry.

        In order: the same letters and digits; the same words in another order; within the allowed edits;
        words cut short; and then the same for what is left without the words that have no weight in the reference, then for every run of words
        inside the value that is long enough to be no accident. Ties go to the more frequent term, then to the smaller id.
        """
        return settle(self.offers(value))

    def offers(self, value: str) -> list[tuple]:
        """What settle needs of this dictionary: (stage, cost, -length, run, -frequency, ref_id) of the first stage that answers, and
        before it up to two terms whose words are cut short, as another block may hold a second one, with which that stage gives no answer."""
        w = words(value)
        if not w:
            return []
        out = []
        for part, first in ((w, 0), ([x for x in w if self._weighs(x)], STAGES)):
            if part and (not first or part != w):
                got, sure = self._one(part, first)
                out += got
                if sure:
                    return out
        runs = []
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + self.longest + 4) + 1):
                text = "".join(w[i:j])
                if (i, j) == (0, len(w)) or len(text) > self.letters:
                    continue
                run = i * (len(w) + 1) + j
                if f := self.exact.get(text):
                    runs.append(self._offer(f, lambda _: 0.0, 2 * STAGES, len(text), run))
                elif len(text) >= 7 and (got := self._edited(text, 2 * STAGES, len(text), run)):
                    runs.append(got)
        return out + _cheapest(runs)

    def _one(self, w: list[str], first: int) -> tuple[list[tuple], bool]:
        """Offers of the stages from first on, and whether no other block can take the last one's answer away without a better one."""
        text = "".join(w)
        if f := self.exact.get(text):
            return [self._offer(f, lambda _: 0.0, first)], True
        if f := self.bag.get(tuple(sorted(w))):
            return [self._offer(f, lambda _: 0.1, first + 1)], True
        if got := self._edited(text, first + 2):
            return [got], True
        if not 1 < len(w) <= self.longest:
            return [], False
        short = [(first + SHORTENED, 0.2, 0, 0, 0, ref) for ref in sorted(self._shortened(w))[:2]]
        # words moved and misspelt: one cyclic turn at a time
        turned = _cheapest([x for k in range(1, len(w)) if (x := self._edited("".join(w[k:] + w[:k]), first + 4, 0, k))])
        return short + turned, bool(turned)


#: Stages of find for one reading of a value: same letters, same words, edits, words cut short, words moved and misspelt.
STAGES, SHORTENED = 5, 3


def _cheapest(offers: list[tuple]) -> list[tuple]:
    """Offers of one stage that share its least cost and greatest length; no other one can win."""
    best = min((o[1:3] for o in offers), default=None)
    return [o for o in offers if o[1:3] == best]


def settle(offers: Sequence[tuple]) -> tuple[int, float, str]:
    """(ref_id, cost, how) of the offers of all blocks, the same as of one dictionary over all of them."""
    by_stage = defaultdict(list)
    for o in offers:
        by_stage[o[0]].append(o)
    for stage in sorted(by_stage):
        met = _cheapest(by_stage[stage])
        if stage in (SHORTENED, STAGES + SHORTENED) and len({o[5] for o in met}) > 1:
            continue  # words cut short that may mean several terms mean none
        runs: dict[int, tuple] = {}
        for o in met:
            runs[o[3]] = min(runs.get(o[3], o), o)
        return min(o[5] for o in runs.values()), met[0][1], ("whole", "stripped", "inside")[stage // STAGES]
    return 0, 0.0, "none"


OFFER = "struct<stage:int,cost:double,size:int,run:int,freq:bigint,ref_id:int>"


def _lookup(books, last: bool):
    """A vectorised lookup in books, a broadcast of one block's dictionaries by field. last: the answer, else the offers."""

    def offers(fields: pd.Series, values: pd.Series) -> list:
        return [books.value[f].offers(v) if f in books.value else [] for f, v in zip(fields, values)]

    @F.pandas_udf("struct<ref_id:int,cost:double,how:string>")
    def answer(fields: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([settle(o) for o in offers(fields, values)], columns=["ref_id", "cost", "how"]).astype({"ref_id": "int32"})

    @F.pandas_udf(f"array<{OFFER}>")
    def several(fields: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("stage", "cost", "size", "run", "freq", "ref_id"), o)) for o in of] for of in offers(fields, values)], dtype=object)

    return answer if last else several


def _settled(offers: Column) -> Column:
    @F.pandas_udf("struct<ref_id:int,cost:double,how:string>")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = [settle([(o["stage"], o["cost"], o["size"], o["run"], o["freq"], o["ref_id"]) for o in of]) for of in x]
        return pd.DataFrame(rows, columns=["ref_id", "cost", "how"]).astype({"ref_id": "int32"})

    return run(offers)


def _all_words(term: Column, aliases: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(terms: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([sorted({w for x in (t, *(a if a is not None else ())) if x is not None for w in words(x)}) for t, a in zip(terms, others)], dtype=object)

    return run(term, aliases)


def _most_words(term: Column, aliases: Column) -> Column:
    @F.pandas_udf("int")
    def run(terms: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([max(len(words(x)) for x in (t, *(a if a is not None else ())) if x is not None) for t, a in zip(terms, others)], dtype="int32")

    return run(term, aliases)


def map_to_list(values: DataFrame, reference: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """values (row_id, field_name, item_no, value) with the entry each means: also ref_id, cost and how; ref_id 0 if none.

    reference: ref_id int, field_name, term, aliases array<string>. Rows whose value is null or empty
    give no row, nor do values written exactly as a term of their field. A value of a field without reference rows is unmatched.
    Blank values are unmatched. Very long values are read to their end, in time linear in their length.
    Repeated rows come out as often as they are there. The reference is collected in blocks of block_terms
    rows, each broadcast as one dictionary; each block offers its candidates for the distinct values, and settle takes of all blocks' the
    one that a single dictionary would give. Counting values combines map-side, so one that a third of all rows hold is one row a task;
    the answers go back to the rows by a broadcast if they were counted and are few, else by a shuffle join.
    """
    x = values.select("row_id", "field_name", "item_no", F.col("value").cast("string").alias("value")).where("value IS NOT NULL AND value <> ''")
    ref = reference.select(F.col("ref_id").cast("int").alias("ref_id"), "field_name", "term", "aliases").where("ref_id IS NOT NULL AND term IS NOT NULL AND field_name IS NOT NULL")
    size = ref.count()
    if not size:
        return x.select("row_id", "field_name", "item_no", "value", F.lit(0).alias("ref_id"), F.lit(0.0).alias("cost"), F.lit("none").alias("how"))
    small = F.broadcast if size <= block_terms else (lambda y: y)
    terms = ref.select("field_name", F.col("term").alias("value"), F.lit(True).alias("is_term")).distinct()
    counted = cut(x.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("times")).join(small(terms), ["field_name", "value"], "left"))
    freq = counted.where("is_term").select("field_name", F.col("value").alias("term"), "times")
    ref = ref.join(freq, ["field_name", "term"], "left").select("ref_id", "field_name", "term", "aliases", F.coalesce("times", F.lit(0)).alias("freq"))
    one = size <= block_terms
    if one:
        ref = ref.withColumn("longest", F.lit(0))
    else:
        ref = ref.join(ref.groupBy("field_name").agg(F.max(_most_words(F.col("term"), F.col("aliases"))).alias("longest")), "field_name")
    vocabulary: dict[str, set[str]] | None = None
    if not one:
        vocabulary = defaultdict(set)
        for r in bounded(ref.select("field_name", F.explode(_all_words(F.col("term"), F.col("aliases"))).alias("w")).distinct(), MOST_WORDS, "different words of the reference"):
            vocabulary[r["field_name"]].add(r["w"])
    n = -(-size // block_terms) * 2
    blocks = [ref] if one else [ref.where(F.pmod(F.hash("ref_id"), F.lit(n)) == b) for b in range(n)]
    typed, columns = counted.where("is_term IS NULL").select("field_name", "value"), []
    for block in blocks:
        rows, longest = defaultdict(list), {}
        for r in block.collect():  # at most about block_terms rows
            rows[r["field_name"]].append((r["ref_id"], r["term"], list(r["aliases"] or []), int(r["freq"])))
            longest[r["field_name"]] = r["longest"]
        if rows:
            books = x.sparkSession.sparkContext.broadcast({f: Dictionary(sorted(y), longest[f], vocabulary[f] if vocabulary is not None else None) for f, y in rows.items()})
            columns.append(_lookup(books, one)("field_name", "value"))
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = typed.repartition(tasks, "field_name", "value")  # a lookup costs far more than a row's way, so the few bytes are not put together again
    found = spread.withColumn("best", columns[0] if one else _settled(F.concat(*columns)))
    found = cut(found.select("field_name", "value", "best.ref_id", "best.cost", "best.how"))
    return x.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, ["field_name", "value"]).select("row_id", "field_name", "item_no", "value", "ref_id", "cost", "how")


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """The misses: field_name, value, times."""
    return mapped.where("ref_id = 0").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("times"))
