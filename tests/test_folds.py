"""Rate limiters and caches: exact transitions, brute force, streams."""

import math
import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from compare import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vettle.operators import folds, service
from vettle.queries import ORACLES, QUERIES
from vettle.streaming import limits


def test_token_bucket():
    b = folds.TokenBucket(100, 5, 1)
    got = [b.call(100) for _ in range(6)] + [b.call(100.5), b.call(101)]
    assert [x[0] for x in got] == [True] * 5 + [False, False, True] and [x[1] for x in got[5:7]] == [1.0, 0.5]
    assert folds.TokenBucket(10, 10, 2).call(110)[:3] == (True, 0.0, 9.0)
    assert folds.TokenBucket(10, 10, 2).call(5)[2] == 9.0  # time that runs backwards adds nothing
    with pytest.raises(ValueError):
        folds.TokenBucket(0, 0, 1)


def test_sliding_window():
    w = folds.SlidingWindow(100, 5, 60)
    assert [w.call(100)[0] for _ in range(6)] == [True] * 5 + [False]
    assert w.call(190)[0] and w.state[2] == 5 and w.call(1000)[2] == 4.0


def test_leaky_bucket():
    b = folds.LeakyBucket(10, 2, 2)
    assert [b.call(10) for _ in range(6)] == [(True, 0), (True, 0.5), (True, 1.0), (True, 1.5), (True, 2.0), (False, 2.5)]


def calls(spark, rows):
    return spark.createDataFrame([(k, float(t), i, 1.0) for i, (k, t) in enumerate(rows)], "key string, ts double, seq long, cost double")


def test_keyed(spark):
    rows = [("A", 0), ("B", 0), ("C", 0), ("A", 0), ("D", 0), ("B", 0), ("A", 0)]
    got = {r.seq: r.allowed for r in folds.keyed_limiter(calls(spark, rows), 1.0, 0.001, most_keys=3).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: False}  # D drops B, which starts anew
    free = {r.seq: r.allowed for r in folds.keyed_limiter(calls(spark, rows), 1.0, 0.001).collect()}
    assert free == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: False}
    old = [("A", 0), ("A", 1), ("A", 3601)]
    assert [r.remaining for r in folds.keyed_limiter(calls(spark, old), 2.0, 0.00001).orderBy("seq").collect()] == [1.0, pytest.approx(0.00001), 1.0]


def test_http(spark):
    df = spark.createDataFrame([("u", "/screen", "POST", 0.0, i) for i in range(3)] + [("u", "/jobs", "GET", 0.0, 3)], "client string, route string, method string, ts double, seq long")
    got = {r.seq: (r.status, r.retry_after) for r in folds.http_rate_limit(df).collect()}
    assert got == {0: (202, None), 1: (202, None), 2: (429, 10), 3: (202, None)}


def test_http_short_waits(spark, tmp_path):
    """Waits below the SQL's rounding: sixty calls at once, then one that comes a hair before the next token."""
    at = lambda us: datetime(2024, 1, 1) + timedelta(microseconds=us)
    rows = [(i, at(0 if i < 60 else 2_499_975_000), 1, "view", 1.0) for i in range(63)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    same(QUERIES["http_rate_limit"](spark, str(tmp_path)), ORACLES["http_rate_limit"], str(tmp_path))


def test_pause(spark):
    rows = [("k", 100.0, 0, 200, 3.0, 9, None), ("k", 101.0, 1, 200, None, 9, None), ("k", 102.0, 2, 429, None, 0, 110.0), ("k", 103.0, 3, 403, None, 0, None), ("k", 120.0, 4, 200, None, 1, None)]
    df = spark.createDataFrame(rows, "key string, ts double, seq long, status int, retry_after double, remaining int, reset double")
    assert [r.paused_until for r in folds.pause_until(df).orderBy("seq").collect()] == [103.0, 103.0, 110.5, 110.5, 122.0]


def test_lru_bytes_and_expiry():
    c = folds.Lru(10, 200)
    for k in "abc":
        c.put(k, k, 80, 0)
    assert list(c.entries) == ["b", "c"] and (c.size, c.evictions) == (160, 1)
    c.put("huge", 1, 500, 0)
    assert not c.entries and c.size == 0
    d = folds.Lru()
    for k in range(5):
        d.put(k, k, 100, 0)
    assert d.evict_to(250) == 3 and d.size == 200
    e = folds.Lru()
    e.put("x", 1, 1, 100, 10)
    assert e.get("x", 105) == 1 and e.get("x", 111) is None and e.expirations == 1
    e.put("y", 1, 1, 0, 10)
    e.put("y", 1, 1, 5, 10)
    assert e.sweep(12) == 0 and e.sweep(15) == 1


def test_segmented_resists_scans():
    c = folds.Segmented(10, 1000, 0.2)
    for k in ("hot1", "hot2"):
        c.put(k, 1, 1, 0)
        assert c.get(k, 0) == 1
    for i in range(20):
        c.put(f"s{i}", 1, 1, 0)
    assert c.get("hot1", 0) == 1 and c.get("hot2", 0) == 1


def test_segmented_parts():
    """Byte floors, promotion with its size, misses asked of probation only, byte targets, pops and sweeps of both parts."""
    c = folds.Segmented(10, 2000, 0.01, ttl=50.0)
    assert [(p.most_items, p.most_size) for p in c.parts] == [(1, 1024), (9, 1024)]
    c.put("a", 1, 100, 0)
    assert c.get("a", 0) == 1 and c.parts[1].size == 100 and not c.parts[0].entries
    c.put("b", 1, 60, 0, 5)
    assert c.get("zz", 1) is None and c.get("a", 2) == 1
    assert c.statistics() == {"hits": 2, "misses": 1, "evictions": 0, "expirations": 0, "size": 160, "items": 2}
    assert c.sweep(6) == 1 and c.pop("a") and not c.pop("a")
    d = folds.Segmented(10, 10_000, 0.5)
    for k in range(4):
        d.put(k, 1, 100, 0)
    for k in (0, 1):
        d.get(k, 0)
    assert d.evict_to(250) == 2 and (d.parts[0].size, d.parts[1].size) == (0, 200)  # 50 for probation, 200 for the rest
    assert d.get(0, 0) == 1 and d.get(0, 100) == 1


def test_sharded(spark):
    """Limits are shares, operations without a key go to all shards."""
    assert folds.shard_limits(16, 100, 1 << 20) == (6, 65_536) and folds.shard_limits(16, 8, 100) == (1, 1024)
    nan = float("nan")
    rows = [("c", float(i), i, "put", f"k{i}", 10, 5.0 if i % 2 else nan) for i in range(40)] + [("c", 40.0, 40, "evict_to", None, 160, nan), ("c", 99.0, 41, "sweep", None, 0, nan)]
    ops = spark.createDataFrame(rows, "cache string, ts double, seq long, op string, k string, size long, ttl_s double")
    log = folds.cache_log(folds.sharded(ops, 4), lambda: folds.Lru(100, math.inf)).collect()
    shards = {}
    for r in log:
        if r.op == "put":
            shards.setdefault(r.cache, []).append(r.seq)
    for name, puts in shards.items():
        evict, sweep = (next(r for r in log if r.cache == name and r.op == op) for op in ("evict_to", "sweep"))
        assert evict.removed == max(0, len(puts) - 4) and evict.bytes <= 40
        assert sweep.removed == sum(i % 2 for i in puts[-4:])
    assert sum(len(p) for p in shards.values()) == 40 and len([r for r in log if r.op == "sweep"]) == 4


def test_lru_in_blocks(spark):
    """Hits by blocks replayed side by side equal one cache's."""
    rng = random.Random(5)
    rows = [(float(i // 3), i, f"k{min(rng.randrange(60), rng.randrange(60))}") for i in range(1500)]
    uses = spark.createDataFrame(rows, "ts double, seq long, k string").repartition(7)
    cache, want = OrderedDict(), {}
    for _, i, k in rows:
        want[i] = k in cache
        cache.pop(k, None)
        cache[k] = 1
        if len(cache) > 12:
            cache.popitem(last=False)
    for block in (40, 10_000):
        assert {r.seq: r.hit for r in folds.lru_hits(uses, 12, block).collect()} == want


def test_job_queue():
    q = service.JobQueue(2)
    got = [q.step(t, op, 10.0) for t, op in ((0, "submit"), (1, "submit"), (2, "submit"), (3, "submit"), (10, "submit"), (11, "stop"), (50, "submit"))]
    assert got == [("queued", 0, 10), ("queued", 10, 20), ("queued", 20, 30), ("full", None, None), ("queued", 30, 40), ("stopping", None, None), ("unavailable", None, None)]


def test_outbound():
    nan = float("nan")
    o = service.Outbound(0.0, 2, 1.0, 2.0)
    assert [o.step(0.0, 10.0, 200, nan, nan, nan) for _ in range(4)] == [(0.0, 10.0), (0.0, 10.0), (10.0, 20.0), (10.0, 20.0)]
    p = service.Outbound(0.0, 5, 1.0, 1.0)
    assert p.step(0.0, 1.0, 200, 30.0, nan, nan) == (0.0, 1.0)  # asks for half a minute when it comes back
    assert p.step(0.5, 1.0, 200, nan, nan, nan) == (1.0, 2.0)  # before that: only the bucket holds it
    assert p.step(1.5, 1.0, 200, nan, nan, nan)[0] == 31.0
    assert [service.pause(100.0, *x) for x in ((429, nan, 0, 110.0), (403, nan, 0, nan), (200, nan, 1, nan), (200, nan, 9, nan), (429, nan, nan, nan))] == [110.5, 105.0, 102.0, -math.inf, -math.inf]


def test_retried(spark):
    rows = [(1, 0, 503, None), (1, 1, None, "bad"), (1, 2, None, "good"), (2, 0, 401, None), (2, 1, None, "good"), (3, 0, None, "good"), (4, 0, 429, None), (4, 1, 500, None), (4, 2, None, "bad"), (4, 3, None, "good"), (5, 0, None, None)]
    df = spark.createDataFrame(rows, "id long, attempt int, http_status int, answer string")
    got = {r.id: (r.status, r.attempts, r.answer, r.wait_s) for r in service.retried(df, "id", F.col("answer") == "good").collect()}
    assert got == {1: ("ok", 3, "good", 3.0), 2: ("failed", 1, None, 0.0), 3: ("ok", 1, "good", 0.0), 4: ("failed", 3, None, 3.0), 5: ("failed", 1, None, 0.0)}


def test_handle_cache(spark, tmp_path):
    now = F.to_timestamp(F.lit("2026-10-08 00:00:00"))
    assert service.read_handle_cache(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert service.read_handle_cache(spark, f"{tmp_path}/bad.json").count() == 0
    (tmp_path / "c.json").write_text('{"Ada": {"at": "2026-10-07T12:00:00+00:00", "repos": [{"name": "x", "fork": false, "topics": ["rag"], "extra": 1}]}, "old": {"at": "2026-10-01T00:00:00+00:00", "repos": []}, "none": {"at": "2026-10-07T23:00:00+00:00", "repos": []}, "odd": {"at": "?", "repos": []}}')
    cache = service.read_handle_cache(spark, f"{tmp_path}/c.json")
    assert sorted((r.username, r.name, r.fork) for r in service.cached_repositories(cache, now, 24.0).collect()) == [("ada", "x", False), ("none", None, None)]
    service.write_handle_cache(cache, f"{tmp_path}/again")
    assert sorted(map(str, service.read_handle_cache(spark, f"{tmp_path}/again").collect())) == sorted(map(str, cache.collect()))


def test_guard_evictions(spark):
    rows = [("a", f"k{i}", 100, float(i)) for i in range(9)] + [("b", "x", 50, 0.0)]
    df = spark.createDataFrame(rows, "cache string, k string, size long, used double")
    gone = {r.k for r in folds.guard_evictions(df, 1000.0).filter("evicted").collect()}
    assert gone == {"k0", "k1", "k2", "k3", "k4", "k5"}  # to 300 bytes a cache
    assert not folds.guard_evictions(df, 10_000.0).filter("evicted").count() and folds.guard_evictions(df, 10_000.0, rss_mb=600.0).filter("evicted").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["get", "put", "pop"]), st.integers(0, 11)), max_size=200))
def test_lru_is_an_ordered_dict(ops):
    c, o = folds.Lru(10, math.inf), OrderedDict()
    for op, k in ops:
        if op == "get":
            assert (c.get(k, 0) is not None) == (k in o)
            if k in o:
                o.move_to_end(k)
        elif op == "put":
            c.put(k, 1, 1, 0)
            o.pop(k, None)
            o[k] = 1
            if len(o) > 10:
                o.popitem(last=False)
        else:
            assert c.pop(k) == (o.pop(k, None) is not None)
        assert list(c.entries) == list(o)


def test_cache_log_survives_batches_and_order(spark):
    rng = random.Random(1)
    rows = [("c", float(i), i, "get", f"k{rng.randrange(30)}", 1, float("nan")) for i in range(3000)]
    ops = spark.createDataFrame(rows, "cache string, ts double, seq long, op string, k string, size long, ttl_s double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = [r.hit for r in folds.cache_log(ops, lambda: folds.Lru(10, math.inf), load=True).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cache, want = OrderedDict(), []
    for r in rows:
        want.append(r[4] in cache)
        cache.pop(r[4], None)
        cache[r[4]] = 1
        if len(cache) > 10:
            cache.popitem(last=False)
    assert got == want


def test_guard(spark):
    one = spark.createDataFrame([("c", 700)], "cache string, bytes long")
    assert folds.guard_targets(one, 1000.0).first().evict_to is None
    assert folds.guard_targets(one.withColumn("bytes", F.lit(900)), 1000.0).first().evict_to == 600
    assert folds.guard_targets(one, 1000.0, rss_mb=600).first().evict_to == 600


def test_stream(spark, tmp_path):
    rows = [("a", 0.0), ("a", 0.0), ("a", 0.0), ("b", 0.0), ("a", 10.0)]
    calls(spark, rows).filter("seq < 2").write.parquet(f"{tmp_path}/in/1")
    source = spark.readStream.schema("key string, ts double, seq long, cost double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = limits.token_bucket(source, 2.0, 0.1).writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
        calls(spark, rows).filter("seq >= 2").coalesce(1).write.parquet(f"{tmp_path}/in/2")
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.seq: r.allowed for r in spark.sql("select * from decisions").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_windowed_counts(spark, tmp_path):
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00", "view", 1.0), (2, "2024-01-01 00:50:00", "view", 2.0), (3, "2024-01-01 05:00:00", "view", 4.0)], "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    ev.write.parquet(f"{tmp_path}/e")
    q = limits.event_counts(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/e")).writeStream.format("memory").queryName("counts").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.n, r.value) for r in spark.sql("select * from counts").collect()] == [(2, 3.0)]
