"""Kept state: result cache, daily tables, roll-ups and sketches against full scans."""

import datetime as dt
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from metercast.operators import budget, rollups, usage
from metercast.session import task_sizes
from metercast.sources import daily_table
from metercast.sources.catalog import local_frame
from metercast.sources.daily_table import DailyTable
from metercast.sources.result_cache import NotCacheable, ResultCache, plan_text, snapshot

D = dt.date


# -- S18 ---------------------------------------------------------------------------
@pytest.fixture()
def table(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(100).selectExpr("id", "id % 7 AS k").write.parquet(path)
    return path


def report(spark, path):
    return spark.read.parquet(path).groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k")


def test_results_are_served_until_they_are_old(spark, table, tmp_path):
    now = [1000.0]
    cache = ResultCache(spark, f"{tmp_path}/cache", ttl=60, clock=lambda: now[0])
    want = report(spark, table).collect()
    for later, counts in ((0, (0, 1)), (59, (1, 1)), (61, (1, 2)), (100, (2, 2))):
        now[0] = 1000.0 + later
        got = cache.get(report(spark, table))
        assert got.collect() == want and got.columns == ["k", "n"] and (cache.hits, cache.misses) == counts
    other = ResultCache(spark, f"{tmp_path}/cache", ttl=60, clock=lambda: now[0])  # another application's
    assert other.get(report(spark, table)).collect() == want and other.hits == 1


def test_changed_inputs_plans_and_rows_have_other_keys(spark, table, tmp_path):
    cache = ResultCache(spark, f"{tmp_path}/cache")
    cache.get(report(spark, table))
    spark.range(100, 110).selectExpr("id", "id % 7 AS k").write.mode("append").parquet(table)
    assert sum(r.n for r in cache.get(report(spark, table)).collect()) == 110 and cache.misses == 2
    time.sleep(1.1)  # rewritten with equal sizes: the files' times and names differ
    spark.range(100).selectExpr("id", "id % 7 AS k").write.mode("overwrite").parquet(table)
    assert sum(r.n for r in cache.get(report(spark, table)).collect()) == 100 and cache.misses == 3
    cache.get(report(spark, table).where("k > 1"))
    assert cache.misses == 4
    names = [local_frame(spark, [(x,)], "name string") for x in ("a", "b")]  # one plan text, other rows
    assert plan_text(names[0]) == plan_text(names[1]) and snapshot(names[0]) != snapshot(names[1])
    assert [cache.get(n).first().name for n in names] == ["a", "b"]
    joined = spark.read.parquet(table).where(F.col("id") > spark.read.parquet(table).agg(F.max("k")).scalar())
    assert cache.key(joined) != cache.key(spark.read.parquet(table))


def test_ordered_and_empty_results(spark, table, tmp_path):
    cache = ResultCache(spark, f"{tmp_path}/cache")
    ordered = spark.read.parquet(table).repartition(7).orderBy(F.desc("id"))
    assert [r.id for r in cache.get(ordered).collect()] == [*range(99, -1, -1)]
    assert [r.id for r in cache.get(ordered).collect()] == [*range(99, -1, -1)] and cache.hits == 1
    empty = spark.read.parquet(table).where("id < 0")
    assert cache.get(empty).count() == 0 and cache.get(empty).schema == empty.schema


def test_what_has_no_key_is_not_cached(spark, table, tmp_path):
    cache = ResultCache(spark, f"{tmp_path}/cache")
    rdd = spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "x int")
    assert cache.get(rdd).collect() == [(1,)] and (cache.hits, cache.misses) == (0, 0)
    python = spark.read.parquet(table).mapInArrow(lambda batches: batches, "id long, k long")
    with pytest.raises(NotCacheable):
        cache.key(python)
    assert cache.get(python).count() == 100 and cache.misses == 0
    assert cache.get(python, version="1").count() == 100 and cache.misses == 1
    assert cache.get(python, version="2").count() == 100 and cache.misses == 2


def test_invalidate_sweep_and_two_writers(spark, table, tmp_path):
    now = [1000.0]
    cache = ResultCache(spark, f"{tmp_path}/cache", ttl=60, clock=lambda: now[0])
    key = cache.key(report(spark, table))
    threads = [threading.Thread(target=lambda: cache._store(report(spark, table), key)) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert cache.get(report(spark, table)).count() == 7 and cache.hits == 1
    begun = cache.get(report(spark, table))
    assert cache.invalidate(report(spark, table)) == 2 and begun.count() == 7  # who reads it goes on
    cache.get(report(spark, table))
    assert cache.misses == 1
    report(spark, table).write.parquet(f"{tmp_path}/cache/{key}/000000000000001-dead")  # its writer died before it was published
    assert cache.get(report(spark, table)).count() == 7
    now[0] += 61
    assert cache.sweep(grace=600) == 1 and cache.sweep(grace=0) == 3 and cache._names() == []


# -- daily tables ------------------------------------------------------------------
def test_days_are_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    t = DailyTable(spark, f"{tmp_path}/d", "v long")
    rows = lambda *r: spark.createDataFrame([(D(2024, 1, d), v) for d, v in r], "day date, v long")
    read = lambda **k: sorted((r.day.day, r.v) for r in t.read(**k).collect())
    assert read() == [] and t.days() == []
    t.replace([D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)], rows((1, 1), (2, 2), (3, 3), (9, 9)))
    assert read() == [(1, 1), (2, 2), (3, 3)]  # the ninth was not asked for
    t.replace([D(2024, 1, 2)], rows((2, 20), (2, 21)))
    t.replace([D(2024, 1, 2)], rows((2, 20), (2, 21)))  # a repeated replacement
    assert read() == [(1, 1), (2, 20), (2, 21), (3, 3)]
    t.replace([D(2024, 1, 3)], rows())
    assert read() == [(1, 1), (2, 20), (2, 21)] and read(first=D(2024, 1, 2), last=D(2024, 1, 2)) == [(2, 20), (2, 21)]
    assert t.vacuum(keep=1) >= 1 and read() == [(1, 1), (2, 20), (2, 21)]
    monkeypatch.setattr(daily_table, "MAX_FOLDERS", 2)
    t.replace([D(2024, 1, 4)], rows((4, 4)))
    assert read() == [(1, 1), (2, 20), (2, 21), (4, 4)] and len(set(t._manifest()[1].values())) == 1


def test_two_writers_of_a_daily_table(spark, tmp_path, monkeypatch):
    t, other = (DailyTable(spark, f"{tmp_path}/d", "v long") for _ in range(2))
    row = lambda d: spark.createDataFrame([(D(2024, 1, d), d)], "day date, v long")
    old = t._manifest
    first = []

    def late():  # another writer publishes between this one's reading and publishing
        state = old()
        if not first:
            first.append(1)
            other.replace([D(2024, 1, 2)], row(2))
        return state
    monkeypatch.setattr(t, "_manifest", late)
    t.replace([D(2024, 1, 1)], row(1))
    assert sorted(r.v for r in t.read().collect()) == [1, 2]


# -- roll-ups ----------------------------------------------------------------------
AS_OF = "2024-03-20 13:30:00"
_CALL = "query_id long, function_name string, model_name string, tokens long, token_credits double, token_credits_e8 long"
_QUERY = "query_id long, user_name string, start_time timestamp_ntz"


def logs(seed):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 2, 1)
    queries = [(q, rnd.choice(["ann", "bob", None, *map(str, range(30))]), start + dt.timedelta(minutes=rnd.randrange(50 * 24 * 60))) for q in range(400)]
    queries += [(401, "ann", None), (402, "edge", dt.datetime(2024, 3, 13, 13, 30)), (403, "edge", dt.datetime(2024, 3, 13, 13, 29, 59)),
                (404, "noon", dt.datetime(2024, 3, 20)), (404, "twice", dt.datetime(2024, 3, 14))]
    calls = [(rnd.randrange(430), rnd.choice(["COMPLETE", "SENTIMENT", None]), rnd.choice(["m1", "m2", "", None]),
              rnd.choice([None, rnd.randrange(5000)]), None, rnd.randrange(10**9)) for _ in range(1500)]
    calls += [(q, "COMPLETE", "m1", 10, None, 7) for q in (401, 402, 403, 404, None)]
    return [(*c[:4], None if c[5] is None else c[5] / 1e8, c[5]) for c in calls], queries


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_equal_full_scans_after_any_arrivals(spark, tmp_path, seed):
    calls, queries = logs(seed)
    rnd = random.Random(seed)
    rnd.shuffle(calls)
    rnd.shuffle(queries)
    own = rollups.UsageRollups(spark, f"{tmp_path}/r")
    call_cuts, query_cuts = [0, 600, 600, 1490, len(calls)], [0, 250, 390, 390, len(queries)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for k in range(1, 5):
        u, h = frame(calls[:call_cuts[k]], _CALL), frame(queries[:query_cuts[k]], _QUERY)
        new_u, new_h = frame(calls[call_cuts[k - 1]:call_cuts[k]], _CALL), frame(queries[query_cuts[k - 1]:query_cuts[k]], _QUERY)
        touched = own.apply(u, h, new_u, new_h)
        if k == 4:
            assert own.apply(u, h, new_u, new_h) == touched  # applied twice
    for as_of, days in ((AS_OF, 7), (AS_OF, 30), ("2024-03-20 00:00:00", 6), ("2025-01-01 00:00:00", 5)):
        assert own.model_analysis(u, h, as_of, days).collect() == usage.model_analysis(u, h, as_of, days).collect()
        assert own.usage_by_user(u, h, as_of, days).collect() == usage.usage_by_user(u, h, as_of, days).collect()
        assert own.usage_by_function(u, h, as_of, days).collect() == usage.usage_by_function(u, h, as_of, days).collect()
        exact = {r.model_name: r.users for r in usage.distinct_users(u, h, as_of, days).collect()}
        near = {r.model_name: r.users for r in own.distinct_users(u, h, as_of, days).collect()}
        assert exact.keys() == near.keys() and all(abs(near[m] - n) <= max(1, 0.065 * n) for m, n in exact.items())


def test_only_touched_days_are_replaced(spark, tmp_path):
    calls, queries = logs(3)
    u, h = spark.createDataFrame(calls, _CALL), spark.createDataFrame(queries, _QUERY)
    own = rollups.UsageRollups(spark, f"{tmp_path}/r")
    own.apply(u, h)
    before = own.sums._manifest()[1]
    late = [(402, "COMPLETE", "m9", 5, 1e-8, 1)]
    u2 = spark.createDataFrame(calls + late, _CALL)
    assert own.apply(u2, h, spark.createDataFrame(late, _CALL)) == {D(2024, 3, 13)}
    after = own.sums._manifest()[1]
    assert {d for d in after if after[d] != before.get(d)} == {"2024-03-13"}
    assert own.model_analysis(u2, h, AS_OF, 30).collect() == usage.model_analysis(u2, h, AS_OF, 30).collect()


def test_upkeep_joins_the_logs_once(spark, tmp_path):
    calls, queries = logs(4)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    u = spark.createDataFrame(calls, _CALL).mapInArrow(count, _CALL)
    h = spark.createDataFrame(queries, _QUERY)
    own = rollups.UsageRollups(spark, f"{tmp_path}/r")
    own.apply(u, h)
    assert read.value == len(calls)  # sums and sketches from one pass
    own.apply(u, h, new_history=h.where("query_id IN (402, 404)"))
    assert read.value == 2 * len(calls)
    exact = {r.model_name: r.users for r in usage.distinct_users(u, h, AS_OF, 30).collect()}
    near = {r.model_name: r.users for r in own.distinct_users(u, h, AS_OF, 30).collect()}
    assert exact.keys() == near.keys() and all(abs(near[m] - n) <= max(1, 0.065 * n) for m, n in exact.items())


def test_calls_of_few_late_queries_are_picked_in_the_scan(spark, monkeypatch):
    calls, queries = logs(5)
    u, h = spark.createDataFrame(calls, _CALL), spark.createDataFrame(queries, _QUERY).where("query_id > 400")
    own = rollups.UsageRollups
    few = own.calls_of(u, h)
    assert few.count() == u.where("query_id IN (401, 402, 403, 404)").count() < u.count()
    assert sorted(own.calls(few, h).collect(), key=str) == sorted(own.calls(u, h).collect(), key=str)
    monkeypatch.setattr(rollups, "FEW_QUERIES", 3)
    assert own.calls_of(u, h) is u


def test_task_sizes_end_with_their_block(spark):
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    now = lambda: [spark.conf.get(n) for n in names]
    old = now()
    with pytest.raises(KeyError), task_sizes(spark, 24 << 20, 1 << 40):
        assert now()[0] == str(24 << 20) and int(now()[1]) == 128 << 20  # the session's own is smaller
        raise KeyError
    assert now() == old


def test_sketches_of_many_users(spark, tmp_path):
    n = 60_000
    u = spark.range(n).selectExpr("id AS query_id", "'COMPLETE' AS function_name", "concat('m', id % 2) AS model_name", "1L AS tokens",
                                  "0.0D AS token_credits", "1L AS token_credits_e8")
    h = spark.range(n).selectExpr("id AS query_id", "concat('u', id % 20001) AS user_name",
                                  "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, cast(id % 400 as int)) AS start_time")
    own = rollups.UsageRollups(spark, f"{tmp_path}/r")
    own.apply(u, h)
    exact = {r.model_name: r.users for r in usage.distinct_users(u, h, AS_OF, 30).collect()}
    near = {r.model_name: r.users for r in own.distinct_users(u, h, AS_OF, 30).collect()}
    assert exact == {"m0": 20001, "m1": 20001} and all(abs(near[m] / exact[m] - 1) < 0.065 for m in exact)


def test_metering_rollups(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(dt.datetime(2024, 2, 1) + dt.timedelta(minutes=rnd.randrange(60 * 24 * 60)), rnd.choice(["AI_SERVICES", "WAREHOUSE"]), None, rnd.randrange(10**9))
            for _ in range(1500)] + [(None, "AI_SERVICES", None, 5), (dt.datetime(2024, 3, 13, 13, 30), "AI_SERVICES", None, 11)]
    rows = [(*r[:2], r[3] / 1e8, r[3]) for r in rows]
    schema = "start_time timestamp_ntz, service_type string, credits_used double, credits_used_e8 long"
    limits = spark.createDataFrame([("daily", 10.0, True), ("weekly", 900.0, True), ("monthly", 1.0, False)], "period string, `limit` double, enabled boolean")
    own = rollups.MeteringRollups(spark, f"{tmp_path}/m")
    for cut, at in ((0, 500), (500, 1400), (1400, len(rows))):
        m = spark.createDataFrame(rows[:at], schema)
        own.apply(m, spark.createDataFrame(rows[cut:at], schema))
    for as_of, days in ((AS_OF, 30), ("2024-03-20 00:00:00", 7), ("2024-03-02 08:00:00", 30), ("2026-01-01 00:00:00", 30)):
        assert own.daily_usage(m, as_of, days).collect() == usage.daily_usage(m, as_of, days).collect()
        assert own.usage_overview(m, as_of, days).collect() == usage.usage_overview(m, as_of, days).collect()
        assert sorted(own.budget_status(m, limits, as_of).collect()) == sorted(budget.budget_status(m, limits, as_of).collect())
