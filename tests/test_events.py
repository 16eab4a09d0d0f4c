from datetime import datetime, timedelta

from lorespark.streaming import events as E
from lorespark.streaming import jobs as S

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_lateness_is_judged_for_every_row_and_goes_on(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "id long, ts timestamp"
    for rows in ([(1, 100), (2, 0), (3, None)], [(4, 39), (5, 40), (6, 500)], [(7, None)], [(8, 439), (9, 440)]):
        spark.createDataFrame([(i, None if m is None else at(m)) for i, m in rows], schema).coalesce(1).write.mode("append").parquet(source)
        judged = E.with_lateness(spark.readStream.schema(schema).parquet(source), folder, 60 * 60_000)
    assert {r["id"]: r["late"] for r in judged.collect()} == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True, 9: False}


def test_pairs_meet_once_within_the_interval(spark):
    causes = [(u, 10 * u + k, at(m)) for u in (1, 2) for k, m in enumerate((0, 59, 60, 61, 125))]
    effects = [(u, 100 + 10 * u + k, at(m)) for u in (1, 3) for k, m in enumerate((0, 60, 120, 400))]
    c = spark.createDataFrame(causes, "user_id long, cause_id long, cause_ts timestamp")
    e = spark.createDataFrame(effects, "user_id long, effect_id long, effect_ts timestamp")
    hour = timedelta(hours=1)
    want = sorted((u, j, i) for u, j, t in effects for v, i, s in causes if u == v and timedelta(0) <= t - s <= hour)
    assert sorted((r["user_id"], r["effect_id"], r["cause_id"]) for r in E.within(c, e, 3600).collect()) == want
    outer = E.within(c, e, 3600, how="leftOuter")
    assert sorted(r["effect_id"] for r in outer.where("cause_id is null").collect()) == [113, 130, 131, 132, 133]


def test_sessions_close_when_the_watermark_passes(spark):
    rows = [(1, at(m), 1.0, m) for m in (0, 10, 39, 80, 300)] + [(None, at(5), 1.0, 5), (2, at(290), 2.0, 290)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, value double, minute long")
    out = S.drain(E.user_sessions(S.in_batches(df, "minute", 3), "30 minutes", "1 hour"), S.append)
    found = sorted((r["user_id"], r["first"], r["until"], r["n"], r["total"]) for r in out.collect())
    assert found == [(1, at(0), at(69), 3, 3.0), (1, at(80), at(110), 1, 1.0)]
