from trellis.operators import quantiles as Q
from trellis.plans.problems import QUERIES


def test_hot_keys_come_from_the_profile_of_every_key(spark, tmp_path, monkeypatch):
    rows = [("hot", f"o{i}", i % 7) for i in range(300)] + [(f"s{i}", "warm", 1) for i in range(5)] + [(None, None, 1)]
    spark.createDataFrame(rows, "s string, o string, support int").write.parquet(f"{tmp_path}/step_03.parquet")
    seen, real = [], Q.key_histogram

    def spy(df, keys, value):
        seen.append((df.select(*keys).distinct().count(), df.where("partner IS NOT NULL").count()))
        return real(df, keys, value)

    monkeypatch.setattr(Q, "key_histogram", spy)
    got = {tuple(r) for r in QUERIES["p4_found"](spark, str(tmp_path)).collect()}
    assert got == {("s", "hot"), ("o", "warm")} and seen == [(1 + 5 + 300 + 1, 610)]
