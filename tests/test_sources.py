from __future__ import annotations



from loomspan.sources import readers as S
from loomspan.streaming.incremental import new_files, windowed_counts


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k int, v string")
    S.write_parquet(df, f"{tmp_path}/p", by=["k"])
    assert S.read_parquet(spark, f"{tmp_path}/p").count() == 2
    S.write_csv(df, f"{tmp_path}/c")
    assert dict(S.read_csv(spark, f"{tmp_path}/c", text_only=True).dtypes) == {"k": "string", "v": "string"}
    assert {r.k for r in S.read_csv(spark, f"{tmp_path}/c").collect()} == {1, 2}


def test_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"de": "Germany", "fr": "France"}')
    assert {tuple(r) for r in S.read_json_lookup(spark, f"{tmp_path}/x.json").collect()} == {("de", "Germany"), ("fr", "France")}
    assert S.read_json(spark, f"{tmp_path}/x.json", whole=True).count() == 1


def test_aligned_files(spark, tmp_path):
    spark.createDataFrame([("1", "x")], "k string, z string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2, 0.5)], "k int, v double").write.parquet(f"{tmp_path}/b")
    out = S.read_aligned(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], {"k": "bigint", "v": "double"})
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (2, 0.5)]


def test_ranges():
    assert S.key_ranges(1, 10, 3) == [(1, 3), (4, 6), (7, 10)]
    assert S.key_ranges(5, 6, 9) == [(5, 5), (6, 6)]


def test_append_and_cache(spark, tmp_path):
    old, new = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert [r.k for r in S.append_new(new, old, ["k"]).collect()] == [2]
    calls = []

    def build():
        calls.append(1)
        return new

    for mark in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert S.cached(spark, f"{tmp_path}/t", mark, build).count() == 3
    assert len(calls) == 2


def test_new_files_only_once(spark, tmp_path):
    seen = []
    take = lambda: new_files(spark, f"{tmp_path}/in", "k int", lambda b, n: seen.extend(r.k for r in b.collect()), f"{tmp_path}/mark")
    spark.createDataFrame([(1,)], "k int").write.parquet(f"{tmp_path}/in")
    take()
    spark.createDataFrame([(2,)], "k int").write.mode("append").parquet(f"{tmp_path}/in")
    take()
    assert sorted(seen) == [1, 2]


def test_windows(spark):
    e = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:01' AS ts, 1 AS u UNION ALL SELECT TIMESTAMP'2024-01-01 00:00:59', 1 UNION ALL SELECT TIMESTAMP'2024-01-01 00:01:01', 1")
    assert sorted(r.n for r in windowed_counts(e, "ts", "u", "1 minute", "1 hour").collect()) == [1, 2]
