import random

from trellis.llm import canonical as C

VALUES = "row_id long, field_name string, item_no int, value string"
REFERENCE = "ref_id int, field_name string, term string, aliases array<string>"


def mapped(spark, values, ref, block):
    x = C.map_to_list(spark.createDataFrame(values, VALUES), spark.createDataFrame(ref, REFERENCE), block)
    return sorted((r.row_id, r.ref_id, round(r.cost, 6), r.how) for r in x.collect())


def test_blocks_answer_as_one_dictionary(spark):
    rnd = random.Random(9)
    some = ["upper", "lobe", "lung", "colon", "neoplasm", "carcinoma", "left", "skin", "ovary", "surface"]
    ref = [(1, "site", "Upper Lobe of Lung", ["lobus superior"]), (2, "site", "Lung", None)]
    ref += [(i, "site", " ".join(rnd.choice(some) for _ in range(rnd.randrange(1, 5))), ["x" + some[i % 10]] if i % 3 else None) for i in range(3, 40)]
    values = ["Uper Lobe of Lung", "neopl lung", "carc skin", "lobe upper", "lung of uper lobe", "lugn 12 mg", "seen in the skinn of", "", "zz"]
    for r in ref:
        w = r[2].split()
        values += [" ".join(x[:4] if rnd.random() < 0.4 else x for x in w), " ".join(w[1:] + w[:1])[:-1], "seen " + r[2][1:] + " twice", r[2], r[2].upper()]
    values = [(i, "site", 0, v) for i, v in enumerate(values)]
    want = mapped(spark, values, ref, 1000)
    assert (0, 1, 0.6, "whole") in [(a, b, 0.6, d) for a, b, _, d in want]
    assert len({x[3] for x in want}) >= 3
    for block in (20, 7):
        assert mapped(spark, values, ref, block) == want


def test_every_field_is_looked_up(spark):
    ref = [(i + 1, f"f{i}", "carcinoma", None) for i in range(1100)]
    got = mapped(spark, [(i, f"f{i}", 0, "carcinona") for i in range(1100)], ref, 20_000)
    assert [(r, i) for r, i, _, _ in got] == [(i, i + 1) for i in range(1100)]
