"""Streaming variants: a keyed token bucket with state, and windowed event counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vettle.operators.folds import DECISION, TokenBucket


def token_bucket(calls: DataFrame, capacity: float, rate: float, ttl: float = 3600.0) -> DataFrame:
    """Streaming calls(key, ts, seq, cost) -> decisions. A micro-batch's calls are put in order; time never runs backwards."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        bucket = TokenBucket(float(rows.ts.iloc[0]), capacity, rate, ttl)
        if state.exists:
            bucket.tokens, bucket.last, bucket.made = state.get
        out = [(key[0], r.ts, r.seq, *bucket.call(r.ts, r.cost)) for r in rows.itertuples(index=False)]
        state.update((bucket.tokens, bucket.last, bucket.made))
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "allowed", "retry_after_s", "remaining", "reset_time"])

    kinds = dict(calls.dtypes)
    schema = f"key {kinds['key']}, ts double, seq {kinds['seq']}, {DECISION}"
    return calls.groupBy("key").applyInPandasWithState(step, schema, "tokens double, last double, made double", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) of each window, closed when the watermark passes it."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value")
