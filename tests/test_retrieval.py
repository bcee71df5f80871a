import random
import time

from trellis.functions import similarity as S
from trellis.operators import retrieval as R


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_fuzzy_top_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["ovarian", "surface", "upper", "lobe", "lung", "colon", "skin"]
    entities = sorted({" ".join(rnd.sample(words, rnd.randrange(1, 4))) for _ in range(40)})
    mentions = {"Oarian syrface", "xung", "u p p e r", "  lung    upper  ", "", "q"}
    for e in entities:
        mentions.add(" ".join(w[:i] + rnd.choice("xyz") + w[i + 1 :] for w in e.split() for i in [rnd.randrange(3)]))  # a slip in each word's first letters
        mentions.add(e.replace(" ", "     "))  # raw lengths are far apart, sorted ones are equal
    for k, least in ((1, 60.0), (5, 60.0), (3, 30.0)):
        want = set()
        for m in mentions:
            scored = sorted((-round(S.token_sort_ratio(m, e), 6), e) for e in entities)
            want |= {(m, e, -s, i + 1) for i, (s, e) in enumerate([x for x in scored if -x[0] >= least][:k])}
        got = R.fuzzy_top(column(spark, "mention", sorted(mentions)), column(spark, "entity", entities), k, least).collect()
        assert {(r.mention, r.entity, r.score, r["rank"]) for r in got} == want and len(got) == len(want)


def test_slips_in_the_first_letters_are_aligned(spark):
    got = R.align(column(spark, "mention", ["Oarian syrface", "Qwx"]), column(spark, "entity", ["Ovarian Surface", "Lung"])).collect()
    assert {tuple(r) for r in got} == {("Oarian syrface", "Ovarian Surface", "fuzzy"), ("Qwx", None, "new")}


def test_names_index_against_all_pairs():
    """Texts of many words, few of which two names share, as statements of several findings are: with the names known from other blocks, and beyond 64 and 255 characters."""
    rnd = random.Random(5)
    words = ["acute", "chronic", "lung", "lobe", "cyst", "il-6", "type", "\u03b1", "\u00e9lev\u00e9e", "grade", "2", "tumour", "of", "edema", "tibia", "lymphoma", "\U0001f600", "aaaa"]
    text = lambda most: " ".join(rnd.choice(words) for _ in range(rnd.randrange(most)))
    spoilt = lambda t: "".join(rnd.choice(["", c, c, c, c, c, c, c, c + "-"]) for c in t)
    names = sorted({text(m) for m in (4, 12, 16, 60) for _ in range(120)})
    blocks = [R._Names(names[::2]), R._Names(names[1::2])]
    for m in [spoilt(rnd.choice(names)) for _ in range(60)] + [text(m) for m in (4, 12, 16, 60) for _ in range(12)]:
        for k, least in ((1, 80.0), (5, 60.0), (3, 95.0)):
            all_pairs = sorted((-round(S.token_sort_ratio(m, x), 6), x) for x in names)
            known: list = []
            for b in blocks:
                known = b.best(m, k, least, known)
            assert known == [(x, -s) for s, x in all_pairs if -s >= least][:k], m


def test_names_index_speed():
    """Names of three findings that are unlike the mentions: compared letter by letter they took 23 s."""
    rnd = random.Random(6)
    part = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvy") for _ in range(rnd.randrange(4, 9)))
    words = [part() for _ in range(400)]
    text = lambda: ", ".join(" ".join([*rnd.sample(words, 3), "type", rnd.choice("123")]) for _ in range(3))
    names = R._Names([text() for _ in range(20_000)])
    began = time.process_time()
    for _ in range(100):
        assert names.best(text(), 1, 80.0) == []
    assert time.process_time() - began < 6


def test_tabled_words_against_all_pairs(spark, monkeypatch):
    """A table of frequent words leaves out names by what the words cost in them; without one, all names were compared by the neighbours of their characters, which took ten times as long."""
    rnd = random.Random(7)
    words = ["ovarian", "chronic", "surface", "upper", "lobe", "phase", "iii", "\u00e9lev\u00e9e", "type", "carcinoma", "colon", "calcified"]
    spoilt = lambda t: "".join(rnd.choice([c] * 12 + ["", c + "'", "x"]) for c in t)
    text = lambda most: rnd.choice([" ", " ", "-"]).join(rnd.choice(words) for _ in range(rnd.randrange(1, most)))
    names = sorted({spoilt(text(m)) for m in (4, 9, 16, 30, 50) for _ in range(80)})
    costs = R._nearness([S.token_sort(x) for x in names], words)
    assert all(costs[i, j] == 0 for i, x in enumerate(names) for j, w in enumerate(words) if w in S.token_sort(x) and len(x) < R.TABLED_CHARS)
    mentions = sorted({spoilt(rnd.choice(names)) for _ in range(60)} | {text(m) for m in (4, 9, 16, 30, 50) for _ in range(8)})
    blocks = [R._Names(names[::2], words, costs[::2]), R._Names(names[1::2], words)]
    none = [None] * len(mentions)
    for k, least in ((1, 80.0), (4, 60.0), (2, 95.0)):
        found: list = [[] for _ in mentions]
        for b in blocks:
            found = b.best_of_each(mentions, k, least, found, none)
        for m, got in zip(mentions, found):
            all_pairs = sorted((-round(S.token_sort_ratio(m, x), 6), x) for x in names)
            assert got == [(x, -s) for s, x in all_pairs if -s >= least][:k], m
    monkeypatch.setattr(R, "TABLED_PAIRS", 1)
    got = R.fuzzy_top(column(spark, "mention", mentions), column(spark, "entity", names), 1, 80.0, block=100).collect()
    assert sorted((r.mention, r.entity, r.score) for r in got) == sorted((m, x, -s) for m in mentions for s, x in [min((-round(S.token_sort_ratio(m, x), 6), x) for x in names)] if -s >= 80.0)


def test_alignment_without_edges(spark):
    """The query merge_alignment leaves the edges out and gives the alignment of the merge."""
    from trellis.plans import triples as P

    got, want = P.alignment(spark, "/root/testdata/sf0.001"), P.merged(spark, "/root/testdata/sf0.001")[1]
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
