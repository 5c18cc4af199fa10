"""Structured Streaming forms of the folds: the same rules over unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by type in windows of event time; rows later than ``late`` are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def distinct_within(events: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def token_bucket(requests: DataFrame, key: str = "user_id", at: str = "at_ms", rate: float = 100.0, burst: float = 200.0, idle_ms: int = 86_400_000) -> DataFrame:
    """Totals of granted and refused requests per key, after each batch; state is four numbers a key.

    A key without requests for ``idle_ms`` is forgotten: its bucket would be full
    again, and its totals begin anew.
    """

    def step(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last, granted, refused = state.get if state.exists else (burst, -1, 0, 0)
        times = np.sort(np.concatenate([b[at].to_numpy() for b in batches]))
        for t in times.tolist():
            if last >= 0:
                tokens = min(burst, tokens + max(0, t - last) / 1000 * rate)
            last = t
            if tokens >= 1:
                tokens, granted = tokens - 1, granted + 1
            else:
                refused += 1
        state.update((tokens, int(last), granted, refused))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [name[0]], "granted": [granted], "refused": [refused]})

    kind = dict(requests.dtypes)[key]
    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, granted long, refused long", "tokens double, last long, granted long, refused long", "update", "ProcessingTimeTimeout")
