"""What runs beside the batch, as tables: retried calls, a bounded job queue, an outbound limiter, a cache of handles.

Retries are one aggregation. The queue and the limiter depend on all that came before under the same key, so they are
folds: a service's requests in order, with a state no larger than the queue or the number of calls at once.
"""

from __future__ import annotations

import heapq
import math
import os
import resource
from collections import deque
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettle.operators.folds import TokenBucket, fold

# Answers of a model's service that are worth another try, and the longest wait before one in seconds.
TRIED_AGAIN = (429, 500, 502, 503, 529)
MOST_RETRIES, LONGEST_WAIT = 2, 8


def retried(attempts: DataFrame, key: str, valid: Column, most_retries: int = MOST_RETRIES, longest: int = LONGEST_WAIT) -> DataFrame:
    """attempts(key, attempt from 0, http_status: null where an answer came, answer) -> (key, status, attempts, answer, wait_s).

    The first valid answer counts; an HTTP error that is not worth another try ends it; so does the last try. wait_s is the
    least time spent between tries: 1, 2, 4 ... seconds, `longest` at most, without the random part.
    """
    good = F.col("http_status").isNull() & F.coalesce(valid, F.lit(False))
    final = good | (F.col("http_status").isNotNull() & ~F.col("http_status").isin(*TRIED_AGAIN))
    tries = attempts.filter(F.col("attempt") <= most_retries).select(key, "attempt", final.alias("final"), F.when(good, F.col("answer")).alias("answer"), good.alias("good"))
    end = F.min(F.when(F.col("final"), F.struct("attempt", "good", "answer")))
    g = tries.groupBy(key).agg(end.alias("end"), F.max("attempt").alias("last"))
    made = F.coalesce(F.col("end")["attempt"], F.col("last")) + 1
    ok = F.coalesce(F.col("end")["good"], F.lit(False))
    wait = F.aggregate(F.sequence(F.lit(0), F.lit(most_retries)), F.lit(0.0), lambda a, i: a + F.when(i < made - 1, F.least(F.lit(float(longest)), F.pow(F.lit(2.0), i))).otherwise(0.0))
    return g.select(key, F.when(ok, "ok").otherwise("failed").alias("status"), made.alias("attempts"), F.col("end")["answer"].alias("answer"), wait.alias("wait_s"))


class JobQueue:
    """One worker, first come first served, and a bounded number of jobs that wait; after a stop none is taken."""

    def __init__(self, size: int):
        self.size, self.free, self.open = size, -math.inf, True
        self.starts: deque[float] = deque()  # of the jobs that wait

    def step(self, ts: float, op: str, run_s: float) -> tuple[str, float | None, float | None]:
        while self.starts and self.starts[0] <= ts:
            self.starts.popleft()
        if op == "stop":
            self.open = False
            return "stopping", None, None
        if not self.open:
            return "unavailable", None, None
        if len(self.starts) >= self.size:
            return "full", None, None
        start = max(ts, self.free)
        self.free = start + run_s
        if start > ts:
            self.starts.append(start)
        return "queued", start, self.free


def job_queue(requests: DataFrame, size: int = 50) -> DataFrame:
    """requests(service, ts, seq, op submit or stop, run_s) -> (service, ts, seq, status, started, completed)."""
    kinds = dict(requests.dtypes)
    schema = f"service {kinds['service']}, ts double, seq {kinds['seq']}, status string, started double, completed double"
    return fold(requests, "service", ["ts", "seq"], lambda *_: JobQueue(size), schema, ["ts", "op", "run_s"])


def pause(now: float, status: int, retry_after: float | None, remaining: float | None, reset: float | None) -> float:
    """Until when a response asks callers to pause; no time at all: minus infinity."""
    given = lambda x: x is not None and x == x
    if given(retry_after):
        return now + retry_after
    if status in (403, 429) and remaining == 0:
        return now + (min(3600.0, max(0.0, reset - now) + 0.5) if given(reset) else 5.0)
    return now + 2.0 if given(remaining) and remaining <= 1 else -math.inf


class Outbound:
    """Calls to a service: so many at once, a burst and a rate, and pauses that responses ask for."""

    def __init__(self, now: float, at_once: int, rate: float, burst: float):
        self.at_once, self.bucket = at_once, TokenBucket(now, burst, rate)
        self.ends: list[float] = []
        self.told: list[tuple[float, float]] = []  # (when a response came, until when it asks to pause)
        self.turn = self.paused = -math.inf

    def _paused(self, now: float) -> float:
        while self.told and self.told[0][0] <= now:
            self.paused = max(self.paused, heapq.heappop(self.told)[1])
        return self.paused

    def step(self, ts: float, run_s: float, status: int, retry_after: float, remaining: float, reset: float) -> tuple[float, float]:
        slot = heapq.heappop(self.ends) if len(self.ends) >= self.at_once else ts
        self.turn = now = max(ts, slot, self.turn)
        while (until := self._paused(now)) > now:
            now = until
        allowed, wait, _, _ = self.bucket.call(now)
        start = now if allowed else now + wait
        end = start + run_s
        heapq.heappush(self.ends, end)
        heapq.heappush(self.told, (end, pause(end, status, retry_after, remaining, reset)))
        return start, end


def outbound(calls: DataFrame, at_once: int = 5, rate: float = 2.0, burst: float = 5.0) -> DataFrame:
    """calls(key, ts, seq, run_s, status, retry_after, remaining, reset) -> (key, ts, seq, started, ended), first come first served."""
    kinds = dict(calls.dtypes)
    schema = f"key {kinds['key']}, ts double, seq {kinds['seq']}, started double, ended double"
    inputs = ["ts", "run_s", "status", "retry_after", "remaining", "reset"]
    return fold(calls, "key", ["ts", "seq"], lambda ts, *_: Outbound(ts, at_once, rate, burst), schema, inputs)


REPOSITORY = "struct<name:string,fork:boolean,archived:boolean,pushed_at:string,language:string,topics:array<string>,description:string,stargazers_count:int>"


def read_handle_cache(spark: SparkSession, path: str) -> DataFrame:
    """(username, at, repos) of a JSON cache {username: {at, repos}}; one that is missing or not JSON is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    kind = f"map<string,struct<at:string,repos:array<{REPOSITORY}>>>"
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"username string, at timestamp, repos array<{REPOSITORY}>")
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("username", "entry"))
    return whole.select(F.lower("username").alias("username"), F.try_to_timestamp(F.col("entry.at")).alias("at"), "entry.repos").filter("at is not null")


def cached_repositories(cache: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """(username, name, fork, ...) of the repositories in entries that have not expired."""
    from vettle.operators.enrich import valid_cache

    fresh = valid_cache(cache, now, ttl_hours)
    return fresh.select("username", F.explode_outer("repos").alias("r")).select("username", "r.*").withColumn("pushed_at", F.try_to_timestamp("pushed_at"))


def write_handle_cache(cache: DataFrame, path: str) -> None:
    """The cache as one JSON document: one row, as large as the cache of one batch's handles."""
    one = cache.select(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.lower("username"), F.struct(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("at"), "repos"))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def rss_mb() -> float:
    """Resident memory of this process in MB: as the kernel tells it, else its peak."""
    try:
        pages = int(Path("/proc/self/statm").read_text().split()[1])
        return pages * os.sysconf("SC_PAGE_SIZE") / 2**20
    except (OSError, ValueError, IndexError):
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
