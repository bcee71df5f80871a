"""Retrieval by vectors and the scoring of answers."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.similarity import token_sort
from trellis.operators.ranking import top_per_key
from trellis.session import cut, stored

#: Queries that one pass over the corpus answers.
BLOCK_QUERIES = 20_000
#: Entity names that one pass over the mentions is compared with.
BLOCK_NAMES = 50_000
#: Blocks of names that a task holds at once; one takes about 60 MB.
BLOCKS_HELD = 5
#: Words, the most frequent ones, whose distance from every text is tabled, and from how many pairs of texts on; which words have a table changes the time taken, not what is found.
TABLED_WORDS, TABLED_PAIRS = 255, 10**8
#: Longest text that is tabled: its length and what a word gains must fit a byte.
TABLED_CHARS = 190
#: What a character of a word that the text has not costs, if one between them that only the text has costs 1.
MISSING = 3


def top_cosine(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest corpus vectors of each query by cosine: query_id, vec_id, score (rounded to 6), rank; ties by vec_id.

    queries and corpus have id bigint and vector array<float>. Queries, however many, come to the driver one block at a time; a block is broadcast to every task, which
    multiplies matrices and keeps its own k best of each query (all ties of the k-th included); only those meet in the shuffle. Exact.
    """
    q = queries.select("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL")
    size, spark = q.count(), corpus.sparkSession
    n = max(1, -(-size // block))
    q = cut(q) if n > 1 else q
    out = None
    for at in range(n):
        rows = (q if n == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(n)) == at)).collect()  # about block queries
        ids = np.array([r["id"] for r in rows], np.int64)
        m = np.array([r["vector"] for r in rows], np.float64)
        if len(ids):
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        held = spark.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, m = held.value
            for b in batches:
                keep = pa.compute.is_valid(b.column(1))
                b = b.filter(keep)
                if not b.num_rows or not len(ids):
                    continue
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                s = np.round(m @ x.T, 6) + 0.0
                if s.shape[1] > k:
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                    i, j = np.nonzero(s >= least)
                else:
                    i, j = np.nonzero(np.ones_like(s, bool))
                yield pa.record_batch([pa.array(ids[i]), b.column(0).take(pa.array(j)).cast(pa.int64()), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

        part = corpus.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    return top_per_key(out, ["query_id"], [F.desc("score"), "vec_id"], k)


def _letters(texts: list[str]) -> np.ndarray:
    """Per text how often it has each of 64 groups of characters."""
    out = np.zeros((len(texts), 64), np.uint8)
    for i, t in enumerate(texts):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le"), np.uint32)[:255] % 64, 1)
    return out


def _longest_common(text: str, masks: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of text and a text of n characters, given as masks of its places by character; all of them at once."""
    v = whole = (1 << n) - 1
    for c in text:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & whole
    return n - v.bit_count()


#: Of a sorted text, the runs of letters and digits; those of 3 to 20 characters may have a table.
_RUNS = re.compile(r"[^\W_]+")


def _mixed(t: str) -> int:
    """A number that texts of the same letters and digits share, whatever their order and what is between them."""
    return crc32("".join(sorted("".join(_RUNS.findall(t)))).encode("utf-8", "surrogatepass"))


def _nearness(texts: list[str], words: list[str]) -> np.ndarray:
    """Per text and word the least cost of turning the word into any part of the text, a missing character at MISSING and one between at 1; 0 for texts beyond TABLED_CHARS.

    Whatever two texts have in common, in order, gives each run of the one a part of the other, and these parts do not overlap: so the costs of a text's runs
    add up to no more than MISSING times the characters that only it has and those that only the other has.
    """
    out = np.zeros((len(texts), len(words)), np.uint8)
    order = sorted((i for i, t in enumerate(texts) if len(t) <= TABLED_CHARS), key=lambda i: len(texts[i]))
    chars = {c: i for i, c in enumerate(sorted(set("".join(words))))}
    places = [np.array([chars[c] for c in w]) for w in words]
    for at in range(0, len(order), 4096):
        some = order[at : at + 4096]
        size = np.array([len(texts[i]) for i in some])
        x = np.zeros((len(some), int(size.max())), np.uint32)
        x[np.arange(x.shape[1]) < size[:, None]] = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.ascontiguousarray(x.T)
        met = np.zeros((len(x), len(chars), len(some)), np.uint8)
        for c, i in chars.items():
            met[:, i][x == ord(c)] = MISSING + 1
        passed = np.arange(1, len(x) + 1, dtype=np.uint8)
        for j, of in enumerate(places):
            # row i: what the first i characters gain at best, MISSING for each that is met, less 1 for each one passed over, and 1 for each place so far, so that passing costs nothing here
            gain = np.zeros((len(of) + 1, len(some)), np.uint8)
            step, best = np.empty((len(of), len(some)), np.uint8), np.zeros(len(some), np.uint8)
            above, below, last = gain[:-1], gain[1:], gain[-1]
            pairs = list(zip(above, below))
            for p in range(len(x)):
                np.take(met[p], of, axis=0, out=step, mode="clip")
                step += above
                np.maximum(below, step, out=below)
                gain[0] = passed[p]
                for a, b in pairs:
                    np.maximum(a, b, out=b)
                np.maximum(best, last - passed[p], out=best)
            out[some, j] = MISSING * len(of) - best
    return out


class _Names:
    """Entity names in order of the length of their sorted texts, with an index of their pairs of neighbouring characters (the ends of a text count as a character)
    and, where words are given, a table of each word's cost in each name (near, in order of names; worked out here if not given)."""

    def __init__(self, names: list[str], words: list[str] = (), near: np.ndarray | None = None):
        sorted_texts = [token_sort(n) for n in names]
        order = sorted(range(len(names)), key=lambda i: (len(sorted_texts[i]), sorted_texts[i], names[i]))
        self.rows = [(len(sorted_texts[i]), sorted_texts[i], names[i]) for i in order]
        self.word = {w: i for i, w in enumerate(words)}
        self.cost = [MISSING * len(w) for w in words]  # of a word of which a text has nothing
        self.same: dict[int, int] = {}
        if words:
            self.same = {_mixed(r[1]): i for i, r in enumerate(self.rows)}
            near = _nearness(sorted_texts, words) if near is None else near
            self.near = np.ascontiguousarray(near[order].T)
            # the words that each name has, filled up with the number behind the last
            self.has = np.full((len(names), 24), len(words), np.uint8)
            for row, r in enumerate(self.rows):
                mine = [self.word[w] for w in _RUNS.findall(r[1]) if w in self.word][:24]
                self.has[row, : len(mine)] = mine
        self.sizes = [r[0] for r in self.rows]
        self.lengths = np.array(self.sizes, np.int64)
        self.most = int(np.searchsorted(self.lengths, 255, side="right"))  # names beyond have no index
        self.of_length = np.searchsorted(self.lengths[: self.most], np.arange(257))
        size = self.lengths[: self.most]
        flat = np.frombuffer("".join(f"\0{r[1]}\0" for r in self.rows[: self.most]).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.unique(flat)
        self.code = {chr(c): i + 1 for i, c in enumerate(chars)}
        code = np.searchsorted(chars, flat).astype(np.int32) + 1
        row = np.repeat(np.arange(self.most, dtype=np.int32), size + 2)
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(size + 2) - (size + 2), size + 2)).astype(np.int16)
        inside = (place > 0) & (place <= np.repeat(size, size + 2))
        self.letters = np.bincount(row[inside].astype(np.int64) * 64 + flat[inside] % 64, minlength=self.most * 64).astype(np.uint8).reshape(-1, 64)
        # the codes of a text's characters, filled up with 0 to whole words
        self.texts = np.zeros((self.most, -(-int(size.max(initial=0)) // 64) * 64), np.uint8 if len(chars) < 255 else np.uint32)
        self.texts[row[inside], place[inside] - 1] = code[inside]
        # the same in one byte, and which of its text's characters of that kind each is, from the left and from the right
        few = (code[inside] - 1) % 254 + 1
        self.kinds = self.texts if self.texts.dtype == np.uint8 else np.zeros(self.texts.shape, np.uint8)
        self.kinds[row[inside], place[inside] - 1] = few
        kind = (row[inside].astype(np.int64) * 256 + few) * 256 + place[inside] - 1
        kind.sort()
        kind, at = kind // 256, (kind % 256).astype(np.uint8)
        new = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))) if len(kind) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(kind)))
        left = np.arange(len(kind)) - np.repeat(new, times)
        self.left, self.right = np.full(self.texts.shape, 255, np.uint8), np.full(self.texts.shape, 255, np.uint8)
        self.left[kind // 256, at], self.right[kind // 256, at] = left, np.repeat(times, times) - 1 - left
        del kind, at, new, times, left, few, flat, inside
        first = np.flatnonzero(place <= np.repeat(size, size + 2))
        pair, self.feature, self.starts, self.having = self._pair(code[first].astype(np.int64), code[first + 1]), {}, [0], np.zeros(0, np.int32)
        if len(pair):
            pair *= self.most
            pair += row[first]
            pair.sort()
            del place, code, first
            pair, row = np.divmod(pair, self.most)
            new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1]))))
            time = np.arange(len(pair)) - np.repeat(new, np.diff(np.append(new, len(pair))))  # a pair's second, third ... time in a text is a feature of its own
            pair, row = np.divmod(np.sort((pair * 256 + time) * self.most + row), self.most)
            new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            self.feature = {int(p): i for i, p in enumerate(pair[new])}
            self.starts, self.having = np.append(new, len(pair)).tolist(), row.astype(np.int32)
        self.dense: dict[int, np.ndarray] = {}

    @staticmethod
    def _pair(a, b):
        """A number for two codes side by side; codes beyond 30,000 share numbers, which only makes the bound looser."""
        return a % 30_000 * 30_000 + b % 30_000

    def _shared(self, t: str, lo: int, hi: int) -> np.ndarray:
        """How many pairs of neighbours, each as often as both have it, t shares with each of the rows lo to hi."""
        out = np.zeros(self.most, np.uint16 if len(t) > 250 else np.uint8)
        some, times = out[lo:hi], {}
        codes = [self.code.get(c, 0) for c in f"\0{t}\0"]
        for p in map(self._pair, codes, codes[1:]):
            times[p] = k = times.get(p, -1) + 1
            if (i := self.feature.get(p * 256 + k)) is None:
                continue
            start, end = self.starts[i], self.starts[i + 1]
            if (end - start) * 64 < self.most:
                out[self.having[start:end]] += 1
                continue
            if (row := self.dense.get(i)) is None:  # common ones as a row of zeros and ones
                self.dense[i] = row = np.zeros(self.most, np.uint8)
                row[self.having[start:end]] = 1
            some += row[lo:hi]
        return some

    def _needed(self, n: int, lo: int, hi: int, least: float) -> np.ndarray:
        """How many pairs of neighbours the rows lo to hi must share with a text of n characters for a ratio of least: a character more or less takes or adds three at most."""
        m = np.arange(256)
        apart = np.floor((1 - least / 100.0) * (n + m) + 1e-4)
        needed = np.clip(np.ceil((n + m + 2 - 3 * apart) / 2), 0, 65_535).astype(np.uint16)
        needed = needed.astype(np.uint8) if needed.max() < 256 else needed
        return np.repeat(needed, np.diff(np.clip(self.of_length, lo, hi)))

    def _split(self, at: np.ndarray, t: str, p: int) -> np.ndarray:
        """The most that t and each of the rows at can have in common if t is cut at p: over all cuts of the row, the characters that both left and both right parts share in any order."""
        width = int(self.lengths[at].max())
        kinds, sums = np.ascontiguousarray(self.kinds[at, :width]).tobytes(), []
        for part, nth in ((t[:p], self.left), (t[p:], self.right)):
            table = bytearray(256)
            for c in part:
                if i := self.code.get(c):
                    table[(i - 1) % 254 + 1] += 1
            sums.append(nth[at, :width] < np.frombuffer(kinds.translate(table), np.uint8).reshape(len(at), width))
        left, right = (np.cumsum(x, axis=1, dtype=np.int16) for x in sums)
        # cut before a row's first character, or behind the character at each place
        return np.maximum(right[:, -1], (left - right).max(axis=1) + right[:, -1]).astype(np.int64)

    def _common(self, at: np.ndarray, t: str) -> np.ndarray:
        """Length of the longest common subsequence of t and each of the rows at: all places of a row at once, 64 to a word."""
        words = -(-int(self.lengths[at].max()) // 64)
        texts = self.texts[at, : words * 64]
        places = {}
        for c in set(t):
            if i := self.code.get(c):
                bits = np.packbits(texts == i, axis=1, bitorder="little").view("<u8")
                places[c] = [np.ascontiguousarray(bits[:, k]) for k in range(words)]
        v = [np.full(len(at), 2**64 - 1, np.uint64) for _ in range(words)]
        u, s, over, carry = np.empty_like(v[0]), np.empty_like(v[0]), np.empty(len(at), bool), np.empty(len(at), bool)
        for c in t:
            if (mine := places.get(c)) is None:
                continue
            for k in range(words):
                np.bitwise_and(v[k], mine[k], out=u)
                np.add(v[k], u, out=s)
                if k + 1 < words:
                    np.less(s, u, out=over)
                if k:
                    np.add(s, carry, out=s)
                    if k + 1 < words:
                        over |= carry & (s == 0)
                np.bitwise_xor(v[k], u, out=u)  # u has no bit that v has not, so this is the difference
                np.bitwise_or(s, u, out=v[k])
                over, carry = carry, over
        return sum(np.bitwise_count(~x).astype(np.int64) for x in v)

    def _common_of_pairs(self, at: np.ndarray, texts: list[str], of: np.ndarray) -> np.ndarray:
        """As _common, of the row at[i] and texts[of[i]] for each i, a thousand pairs at a time."""
        sizes = np.array([len(t) for t in texts], np.int64)
        none = np.iinfo(self.texts.dtype).max  # no code of a character
        codes = np.full((len(texts), int(sizes.max())), none, self.texts.dtype)
        for i, t in enumerate(texts):
            codes[i, : len(t)] = [self.code.get(c, none) for c in t]
        out, order = np.zeros(len(at), np.int64), np.argsort(sizes[of], kind="stable")
        for some in np.split(order, range(1024, len(order), 1024)):
            words = -(-int(self.lengths[at[some]].max()) // 64)
            rows, mine = self.texts[at[some], : words * 64], np.ascontiguousarray(codes[of[some]].T)
            v = [np.full(len(some), 2**64 - 1, np.uint64) for _ in range(words)]
            for j in range(int(sizes[of[some[-1]]])):
                bits = np.packbits(rows == mine[j][:, None], axis=1, bitorder="little").view("<u8")
                carry = None
                for k in range(words):
                    u = v[k] & bits[:, k]
                    s = v[k] + u
                    over = s < u
                    if carry is not None:
                        s += carry
                        over |= carry & (s == 0)
                    v[k], carry = s | (v[k] ^ u), over
            out[some] = sum(np.bitwise_count(~x).astype(np.int64) for x in v)
        return out

    def _near(self, t: str, words: list[int], lo: int, hi: int, least: float, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of lo to hi that may reach a ratio of least with t, and a bound of what each has in common with it, by the tabled words of t in the rows and by those of the rows in t (costs)."""
        n, m = len(t), np.arange(256)
        # MISSING * (n - c) + (m - c) is left to the words of t if c characters are in common
        allowed = MISSING * n + m - (MISSING + 1) * np.ceil(least * (n + m) / 200.0 - 1e-5)
        allowed = np.repeat(np.clip(allowed, 0, 255).astype(np.uint8), np.diff(np.clip(self.of_length, lo, hi)))
        words = sorted(words, key=lambda w: -self.cost[w])
        first = int(np.searchsorted(np.cumsum([self.cost[w] for w in words]), 255, side="right"))  # whose sum fits a byte
        sums = self.near[words[0], lo:hi].copy()
        for w in words[1:first]:
            sums += self.near[w, lo:hi]
        at = np.flatnonzero(sums <= allowed)
        sums = sums[at].astype(np.int64)
        at += lo
        for w in words[first:]:
            sums += self.near[w, at]
        size = self.lengths[at]
        common = (MISSING * n + size - sums) // (MISSING + 1)
        return at, np.minimum(common, (MISSING * size + n - costs[self.has[at]].sum(axis=1, dtype=np.int64)) // (MISSING + 1))

    def best(self, mention: str, k: int, least: float, known: list[tuple[str, float]] | None = None, costs: np.ndarray | None = None) -> list[tuple[str, float]]:
        """As best_of_each, of one mention."""
        return self.best_of_each([mention], k, least, [known or []], [costs])[0]

    def best_of_each(self, mentions: list[str], k: int, least: float, known: list[list[tuple[str, float]]], costs: list[np.ndarray | None]) -> list[list[tuple[str, float]]]:
        """Of each mention the k names of the highest ratio of at least least, ties by name; with those that other blocks gave, as known. costs: of the tabled words in the mention's sorted text.

        What is left to compare of several mentions is compared together.
        """
        found, texts, ats, of = [], [], [], []
        for mention, mine, cost in zip(mentions, known, costs):
            out, at = self._search(mention, k, least, mine, cost)
            found.append(out)
            texts.append(token_sort(mention) if len(at) else "")
            ats.append(at)
            of.append(np.full(len(at), len(of)))
        at, of = np.concatenate(ats), np.concatenate(of)
        if len(at):
            ratio = np.round(200.0 * self._common_of_pairs(at, texts, of) / (np.array([len(t) for t in texts])[of] + self.lengths[at]), 6)
            for i in np.flatnonzero(ratio >= least):
                insort(out := found[of[i]], (-float(ratio[i]), self.rows[at[i]][2]))
                del out[k:]
        return [[(name, -s) for s, name in out] for out in found]

    def _search(self, mention: str, k: int, least: float, known: list[tuple[str, float]], costs: np.ndarray | None) -> tuple[list[tuple[float, str]], np.ndarray]:
        """(minus ratio, name) of the k best names seen, in order, and the rows that are still to be compared.

        No pair of that ratio is missed: lengths that cannot reach it are left out, then names that share too few pairs of neighbouring characters (by an index of the pairs), or, of a mention
        that tabled words make up by half, names in which these cost too much or whose own cost too much in the mention, then names
        that do not share enough characters, whatever their order, nor in two parts one after the other; the rest is compared in order of the bound until no bound reaches the k-th best: the first few one by one, the others together.
        """
        t = token_sort(mention)
        n = len(t)
        if not n:
            return sorted([*[(-s, name) for name, s in known], *[(-100.0, r[2]) for r in self.rows if not r[0]]])[:k], np.zeros(0, np.int64)
        out = [(-s, name) for name, s in known]
        if len(out) >= k:
            least = max(least, -out[k - 1][0])
        masks: dict[str, int] = {}
        for j, c in enumerate(t):
            masks[c] = masks.get(c, 0) | 1 << j
        alike = self.same.get(_mixed(t), -1) if self.same else -1  # one that is likely to be the best, to have a high bar from the start
        if alike >= 0:
            score = round(200.0 * _longest_common(self.rows[alike][1], masks, n) / (n + self.sizes[alike]), 6)
            if score >= least:
                insort(out, (-score, self.rows[alike][2]))
                del out[k:]
                if len(out) >= k:
                    least = max(least, -out[k - 1][0])
        share = max(least - 1e-6, 1e-9) / 200.0  # the bar may be a ratio that was rounded up
        lo, hi = bisect_left(self.sizes, n * share / (1 - share) - 1e-9), bisect_right(self.sizes, n * (1 - share) / share + 1e-9)
        cut_at = max(lo, min(hi, self.most))

        def take(some: np.ndarray, together: bool) -> None:
            nonlocal least
            mine = some[some < self.most] if together else some[:0]
            ratio = np.round(200.0 * self._common(mine, t) / (n + self.lengths[mine]), 6) if len(mine) else np.zeros(0)
            good = np.flatnonzero(ratio >= least)
            scores = list(zip(mine[good], ratio[good].tolist()))
            scores += [(i, round(200.0 * _longest_common(self.rows[i][1], masks, n) / (n + self.rows[i][0]), 6)) for i in (some[some >= self.most] if together else some)]
            for i, score in scores:
                if score >= least:
                    insort(out, (-score, self.rows[i][2]))
                    del out[k:]
            if len(out) >= k:
                least = max(least, -out[k - 1][0])

        if n > 255:  # counts stop there
            at = np.arange(lo, hi)
            bound = 200.0 * np.minimum(self.lengths[lo:hi], n) / (self.lengths[lo:hi] + n)
        else:
            words = [self.word[w] for w in _RUNS.findall(t) if w in self.word] if self.word else []
            if 2 * sum(self.cost[w] for w in words) >= MISSING * n and cut_at > lo:
                costs = _nearness([t], list(self.word))[0] if costs is None else costs
                at, common = self._near(t, words, lo, cut_at, least, np.append(costs, np.uint8(0)))
                bound = 200.0 * common / (self.lengths[at] + n)
            else:
                shared = self._shared(t, lo, cut_at)
                at = np.flatnonzero(shared >= self._needed(n, lo, cut_at, least))
                apart = self.lengths[lo + at] + n + 2 - 2 * shared[at].astype(np.int64)
                at = lo + at
                size = self.lengths[at] + n
                apart = -(-apart // 3)
                bound = 100.0 - 100.0 * (apart + (apart + size) % 2) / size  # as odd or even as the sum of the lengths
            at, bound = at[keep := (np.round(bound, 6) >= least) & (at != alike)], bound[keep]
            if len(at) <= 24 and hi <= self.most:
                return out, at
            if len(out) < k:  # the most promising first: what they reach rules out many
                order = np.argsort(-bound)
                take(at[order[:2]], False)
                at, bound = at[order[2:]], bound[order[2:]]
                at, bound = at[keep := np.round(bound, 6) >= least], bound[keep]
            letters = np.minimum(self.letters[at], _letters([t])[0]).sum(axis=1, dtype=np.uint16)
            bound = np.minimum(bound, 200.0 * letters / (self.lengths[at] + n))
            for p in (n // 2, n // 4, n - n // 4):
                at, bound = at[keep := np.round(bound, 6) >= least], bound[keep]
                if len(at) > 16:
                    bound = np.minimum(bound, 200.0 * self._split(at, t, p) / (self.lengths[at] + n))
            rest = np.arange(cut_at, hi)
            at, bound = np.concatenate([at, rest]), np.concatenate([bound, 200.0 * n / (self.lengths[rest] + n)])
        at, bound = at[keep := (np.round(bound, 6) >= least) & (at != alike)], bound[keep]
        if n <= 255 and len(at) <= 256 and hi <= self.most:
            return out, at
        order = np.argsort(-bound, kind="stable")
        at, bound = at[order], bound[order]
        done = 0
        while done < len(at) and round(bound[done], 6) >= least:
            together = done >= 8 and n <= 255
            some = at[done : done + 64 + 4 * done if together else done + 1]
            done += len(some)
            take(some, together)
        return out, at[:0]


def _frequent_words(texts: DataFrame) -> list[str]:
    """The runs of 3 to 20 letters and digits that occur most often in text, TABLED_WORDS at most."""
    w = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))).alias("w")).where("length(w) <= 20")
    return [r["w"] for r in w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(TABLED_WORDS).collect()]


def _priced(names: DataFrame, rows: int, words: list[str]) -> DataFrame:
    """names (one column, of about so many rows), spread over tasks, with costs: those of the words in the sorted text, a byte each.

    Spread by a hash of its own: the partitioning that made the names distinct may have been put together into a few tasks.
    """
    name = names.columns[0]
    most = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = names.repartition(max(1, min(most, -(-rows // 4096))) if words else most, F.xxhash64(name))
    if not words:
        return spread.withColumn("costs", F.lit(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = _nearness([token_sort(x) for x in b.column(0).to_pylist()], words)
            yield pa.record_batch([b.column(0), pa.array([c.tobytes() for c in costs], pa.binary())], names=[name, "costs"])

    return spread.mapInArrow(run, f"{name} string, costs binary")


def fuzzy_top(mentions: DataFrame, entities: DataFrame, k: int = 5, least: float = 60.0, block: int = BLOCK_NAMES) -> DataFrame:
    """The k entities most like each mention by token-sort ratio of at least least: mention, entity, score, rank.

    Both sides are made distinct. Every mention meets every entity, in blocks of entities that are broadcast, each of about block names and BLOCKS_HELD of them to a pass;
    bounds without loss keep most pairs from being compared letter by letter, and the k best of a block are the bar for the next. Mentions are spread over tasks, and each pass returns k rows a mention.
    """
    m = stored(mentions.select("mention").where("mention IS NOT NULL").distinct())
    e = stored(entities.select("entity").where("entity IS NOT NULL").distinct())
    spark = m.sparkSession
    rows, names = m.count(), e.count()
    words = _frequent_words(m.select(F.col("mention").alias("text")).unionByName(e.select(F.col("entity").alias("text")))) if rows * names >= TABLED_PAIRS else []
    n = max(1, -(-names // block))
    spread = _priced(m, rows, words)
    spread = stored(spread) if words and n > BLOCKS_HELD else spread
    held = []
    for i in range(n):
        mine = e if n == 1 else e.where(F.pmod(F.xxhash64("entity"), F.lit(n)) == i)  # about block names
        got = _priced(mine, names // n, words).toArrow()
        near = np.frombuffer(b"".join(got.column(1).to_pylist()), np.uint8).reshape(len(got), -1) if words else None
        held.append(spark.sparkContext.broadcast(_Names(got.column(0).to_pylist(), words, near)))
    out = None
    for i in range(0, n, BLOCKS_HELD):

        def run(batches: Iterator[pa.RecordBatch], some=tuple(held[i : i + BLOCKS_HELD])) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, mentions, costs = [], b.column(0).to_pylist(), [np.frombuffer(x, np.uint8) for x in b.column(1).to_pylist()]
                for i in range(0, len(mentions), 512):
                    mine = mentions[i : i + 512]
                    best: list[list[tuple[str, float]]] = [[] for _ in mine]
                    for names in some:
                        best = names.value.best_of_each(mine, k, least, best, costs[i : i + 512])
                    rows += [(x, name, s) for x, found in zip(mine, best) for name, s in found]
                yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["mention", "entity", "score"])

        part = spread.mapInArrow(run, "mention string, entity string, score double")
        out = part if out is None else out.unionByName(part)
    return top_per_key(out, ["mention"], [F.desc("score"), "entity"], k)


def align(mentions: DataFrame, entities: DataFrame, accept: float = 80.0, ask: float = 60.0, rerank=None, confirm=None, accept_rerank: float = 0.85, k: int = 5) -> DataFrame:
    """mention, entity (null for a new one), how: exact, fuzzy, semantic, model, ask or new.

    In turn: the same name but for case and blanks at its ends; the best token-sort ratio of at least accept; of the k best
    candidates of at least ask, the best by rerank, if given (a Column of mention and entity, such as the cosine of their embeddings), of at least accept_rerank; then what confirm says, if given
    (a function from a table mention, candidates array<string> to one of mention, entity, null for none). Without confirm such mentions are left
    as ask. Equal scores go to the smaller name.
    """
    m = mentions.select("mention").where("mention IS NOT NULL").distinct()
    exact = m.join(entities.select(F.lower(F.trim("entity")).alias("n"), "entity").groupBy("n").agg(F.min("entity").alias("entity")), F.lower(F.trim("mention")) == F.col("n")).select("mention", "entity", F.lit("exact").alias("how"))
    rest = m.join(exact.select("mention"), "mention", "left_anti")
    top = fuzzy_top(rest, entities, k if rerank is not None or confirm is not None else 1, ask)
    top = cut(top)  # read by each of the following stages
    best = top.where("rank = 1").select("mention", "entity", "score")
    y = rest.join(best, "mention", "left")
    sure = exact.unionByName(y.where(F.col("score").isNull()).select("mention", F.lit(None).cast("string").alias("entity"), F.lit("new").alias("how")))
    sure = sure.unionByName(y.where(F.col("score") >= accept).select("mention", "entity", F.lit("fuzzy").alias("how")))
    left = y.where(F.col("score") < accept)
    if rerank is not None:
        ranked = top.join(left.select("mention"), "mention", "left_semi").withColumn("__s", rerank(F.col("mention"), F.col("entity"))).where(F.col("__s") >= accept_rerank)
        met = top_per_key(ranked, ["mention"], [F.desc("__s"), "entity"], 1, "__r").select("mention", "entity", F.lit("semantic").alias("how"))
        sure, left = sure.unionByName(met), left.join(met.select("mention"), "mention", "left_anti")
    if confirm is None:
        return sure.unionByName(left.select("mention", F.lit(None).cast("string").alias("entity"), F.lit("ask").alias("how")))
    asked = top.join(left.select("mention"), "mention", "left_semi").groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("c")).select("mention", F.col("c.entity").alias("candidates"))
    return sure.unionByName(confirm(asked).select("mention", "entity", F.when(F.col("entity").isNull(), "new").otherwise("model").alias("how")))


def chunks(text: Column, most: int = 30) -> Column:
    """An answer's parts between line ends, | ; : and commas, each followed by its own parts between arrows; at least two characters, in order, without repeats, the first most."""
    parts = F.filter(F.transform(F.split(text, r"[\n\r|;:,]+"), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
    each = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), F.transform(F.split(p, r"--\[.*?\]-->|<--\[.*?\]--|->"), lambda q: F.trim(q)))))
    return F.slice(F.array_distinct(F.filter(each, lambda p: F.length(p) >= 2)), 1, most)


def middle_hits(answer: Column, path: Column) -> Column:
    """struct(hits, needed, success): middle nodes of path that answer names, of which min(2, all) are needed; a path without a middle succeeds."""
    mids = F.slice(path, 2, F.greatest(F.size(path) - 2, F.lit(0)))
    hits = F.size(F.filter(mids, lambda m: F.contains(F.lower(answer), F.lower(m))))
    needed = F.least(F.lit(2), F.size(mids))
    return F.struct(hits.alias("hits"), needed.alias("needed"), (hits >= needed).alias("success"))


def hit_rate(df: DataFrame, by: str, flag: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("hits"), F.avg(F.col(flag).cast("int")).alias("rate"))
