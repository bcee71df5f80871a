from collections import Counter

from trellis.plans.cohort import QUERIES


def test_every_class_is_spread_over_all_folds(spark, tmp_path):
    rows = [(i, 1 if i % 40 == 0 else 0) for i in range(403)] + [(1000, None)]
    for part in (1, 7):
        spark.createDataFrame(rows, "row_id long, os_event int").repartition(part).write.parquet(f"{tmp_path}/{part}/msk_chord_patient_level.parquet")
    got = [sorted(tuple(r) for r in QUERIES["stratified_folds"](spark, f"{tmp_path}/{part}").collect()) for part in (1, 7)]
    assert got[0] == got[1] and [r[:2] for r in got[0]] == rows[:-1]
    n = Counter(r[1:] for r in got[0])
    for e in (0, 1):
        sizes = [n[e, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and min(sizes) >= 2
