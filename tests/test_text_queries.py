import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from trellis.operators import evidence as E
from trellis.plans.text import QUERIES


def save(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def grams(w, lo, hi):
    return [" ".join(w[i : i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


def plain_words(t):
    return [w for w in re.split("[^a-z0-9]+", t.lower()) if w]


def test_boost_reaches_every_term_of_a_class(spark, tmp_path):
    rnd = random.Random(4)
    heavy = [f"w{i}" for i in range(80)]  # heavier than any ontology term
    docs = []
    for i in range(24):
        text = [rnd.choice([*heavy, "the", "of", "and"]) for _ in range(200)]
        text[50:50] = ["Upper", "lobe", "lung"] if i % 3 else ["skin"]
        docs.append((i, f"c{i % 2}", " ".join(text)))
    docs.append((99, "c0", "only once"))
    docs.append((100, None, "skin skin"))
    save(spark, tmp_path, "documents", docs, "doc_id long, source string, text string")
    save(spark, tmp_path, "canonical_terms", [("Upper Lobe Lung",), ("Skin",), ("once",), ("the",)], "term string")
    n, held = defaultdict(Counter), Counter()
    for _, c, t in docs:
        if c:
            g = grams([w for w in plain_words(t) if w not in E.STOP_WORDS], 1, 3)
            n[c].update(g)
            held.update(set(g))
    n = {c: {t: k for t, k in x.items() if held[t] >= 2} for c, x in n.items()}
    total = Counter()
    for x in n.values():
        total.update(x)
    a = math.floor(sum(total.values()) / len(n))
    want = set()
    for c, x in n.items():
        s = sum(x.values())
        w = {t: round(round(k / s * math.log(1 + a / total[t]), 9) + 0.5 * (t in ("upper lobe lung", "skin", "once", "the")), 6) for t, k in x.items()}
        want |= {(c, t, w[t]) for t in sorted(w, key=lambda t: (-w[t], t))[:5]}
    got = {(r["class"], r.term, r.weight) for r in QUERIES["docs_ctfidf_boosted"](spark, str(tmp_path)).collect()}
    top = {(c, t) for c, t, w in got if w > 0.5}
    assert top == {(c, t) for c in ("c0", "c1") for t in ("upper lobe lung", "skin")}
    assert {x[:2] for x in got if x[2] > 0.5} == {x[:2] for x in want if x[2] > 0.5} and len(got) == 10
    assert sorted(round(x[2], 5) for x in got) == sorted(round(x[2], 5) for x in want)


def test_frequent_concepts_count_trigrams(spark, tmp_path):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["resected", "margins", "were", "free", "of", "record", "this"]) for _ in range(rnd.randrange(30))) for _ in range(40)] + [None]
    save(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    n = Counter(g for t in texts if t for g in grams([w for w in plain_words(t) if len(w) >= 4], 1, 3))
    want = sorted(((g, k) for g, k in n.items() if k >= 2), key=lambda x: (-x[1], x[0]))[:100]
    assert any(len(g.split()) == 3 for g, _ in want)
    assert sorted(tuple(r) for r in QUERIES["concept_frequent"](spark, str(tmp_path)).collect()) == sorted(want)


def test_documents_of_every_language_are_cleaned(spark, tmp_path):
    rows = [(1, "en", "Aspirin 40 mg!"), (2, "de", "Stra\u00dfe und Fieber"), (3, None, "no language"), (4, "en", None)]
    save(spark, tmp_path, "documents", rows, "doc_id long, lang string, text string")
    md5 = {i: t and hashlib.md5(t.encode()).hexdigest() for i, t in ((1, "aspirin"), (2, "stra e und fieber"), (3, "no language"), (4, None))}
    assert {r.doc_id: r.digest for r in QUERIES["docs_clean"](spark, str(tmp_path)).collect()} == md5


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_evidence_of_long_concepts_of_the_tables(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(E, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(8)
    some = lambda k: " ".join(rnd.choice("abc") for _ in range(k))
    names = sorted({some(rnd.randrange(1, 9)) for _ in range(60)}) + ["A b-c A b C", "upper lobe of left lung, apex"]
    texts = [some(rnd.randrange(60)) for _ in range(40)] + ["The Upper lobe of (left) lung apex.", "upper lobe of left lung apexes", None]
    save(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    save(spark, tmp_path, "step_03", [(a, b) for a, b in zip(names[::2], names[1::2])] + [(None, names[-1])], "s string, o string")
    save(spark, tmp_path, "canonical_terms", [(n,) for n in names[:5] + ["not there at all in any"]], "term string")
    want = {n: [i for i, t in enumerate(texts) if t and f" {' '.join(plain_words(n))} " in f" {' '.join(plain_words(t))} "] for n in [*names, "not there at all in any"]}
    assert want["upper lobe of left lung, apex"] == [40] and any(len(n.split()) > 5 and want[n] for n in names)
    got = QUERIES["concept_evidence_top3"](spark, str(tmp_path)).collect()
    assert sorted((r.concept, r.doc, r["rank"]) for r in got) == sorted((n, i, k + 1) for n, at in want.items() for k, i in enumerate(at[:3]))
    every = QUERIES["concept_evidence_all"](spark, str(tmp_path)).collect()
    assert sorted((r.concept, r.docs) for r in every) == sorted((n, len(at)) for n, at in want.items() if at)
