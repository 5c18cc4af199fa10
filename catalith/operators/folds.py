"""Ordered folds over event histories: op logs, token buckets, counters, state machines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def compacted(log: DataFrame) -> DataFrame:
    """An op log without what its last checkpoint covers."""
    last = log.where(F.col("kind") == "checkpoint").groupBy("path_id").agg(F.max("seq").alias("ckpt"))
    return log.join(last, "path_id", "left").where(F.col("ckpt").isNull() | (F.col("seq") >= F.col("ckpt"))).drop("ckpt")


def replayed(log: DataFrame, value: str = "value") -> DataFrame:
    """The state of every path: its last checkpoint's value, then ops added; the last operation and their number."""
    rows = compacted(log)
    return rows.groupBy("path_id").agg(F.sum(value).alias("state"), F.count("*").alias("ops"), F.max("seq").alias("last_seq"), F.max_by("op", "seq").alias("last_op"))


def due_for_compaction(log: DataFrame, now_ms: int, ops: int = 50, age_ms: int = 60_000) -> DataFrame:
    """Paths with enough ops since their checkpoint, or any at all and the last checkpoint (without one, the first op) long ago."""
    last = log.where(F.col("kind") == "checkpoint").groupBy("path_id").agg(F.max("ts").alias("at"))
    tail = compacted(log).where(F.col("kind") == "op").groupBy("path_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    rows = tail.join(last, "path_id", "left").select("path_id", "n", F.coalesce("at", "first").alias("since"))
    return rows.where((F.col("n") >= ops) | (now_ms - F.col("since") >= age_ms))


def fold(rows: DataFrame, key: str, order: str, columns: list[str], start: Callable[[], object], step: Callable, finish: Callable[[object], tuple], schema: str) -> DataFrame:
    """``finish`` of the state after ``step(state, *columns)`` over each key's rows in order, for steps that cannot be combined.

    Rows are sorted by Spark and read in a stream; only the state of one key is
    held, so that a key of any length takes no more memory than a short one.
    """
    kind = dict(rows.dtypes)[key]
    out = f"{key} {kind}, {schema}"
    names, types = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun, done = None, start(), False, []
        for b in batches:
            for k, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if begun and k != now:
                    done.append((now, *finish(state)))
                    state = start()
                now, begun, state = k, True, step(state, *values)
            if len(done) > 4096:
                yield _batch(done, names, types)
                done = []
        if begun:
            done.append((now, *finish(state)))
        if done:
            yield _batch(done, names, types)

    ordered = rows.select(key, order, *(c for c in columns if c != order)).repartition(F.col(key)).sortWithinPartitions(key, order)
    return ordered.select(key, *columns).mapInArrow(run, out)


def _arrow(schema: str) -> tuple[list[str], list]:
    target = to_arrow_schema(StructType.fromDDL(schema))
    return target.names, target.types


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def token_bucket(requests: DataFrame, key: str = "user_id", at: str = "ts", rate: float = 100.0, burst: float = 200.0) -> DataFrame:
    """Per key: requests granted and refused, and tokens left; a refusal consumes nothing but advances the clock."""

    def step(s: tuple, t: int) -> tuple:
        tokens, last, granted, refused = s
        tokens = min(burst, tokens + max(t - (t if last is None else last), 0) / 1000.0 * rate)
        return (tokens - 1, t, granted + 1, refused) if tokens >= 1 else (tokens, t, granted, refused + 1)

    return fold(requests, key, at, [at], lambda: (burst, None, 0, 0), step, lambda s: (s[2], s[3], float(s[0])), "granted long, refused long, tokens double")


def _clamped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, delta) as segments: a counter x becomes max(x + add, least), and its peak max(x + high, top)."""
    part, serial = TaskContext.get().partitionId(), 0
    for b in batches:
        keys, delta = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        out = []
        for s, e in zip(edges, edges[1:], strict=False):
            if s == e:
                continue
            sums = np.cumsum(delta[s:e])
            # From x: sum + x while it never fell below zero; else the sum less the least sum so far.
            from_zero = sums - np.minimum.accumulate(sums)
            out.append((keys[s].as_py(), part, serial, int(sums[-1]), int(from_zero[-1]), int(sums.max()), int(from_zero.max())))
            serial += 1
        if out:
            cols = list(zip(*out, strict=True))
            types = (keys.type, pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "part", "serial", "add", "least", "high", "top"])


def usage(deltas: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """Counters that never fall below zero, and their high-water mark: order matters, a sum would not do.

    A run of deltas takes a counter x to max(x + add, least); such steps combine,
    so that histories are cut into segments of sorted ranges and a key of any
    length is spread over tasks.
    """
    kind, n = dict(deltas.dtypes)[key], int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = deltas.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(delta).cast("long").alias("delta"))
    ordered = rows.repartitionByRange(n, "key", "at").sortWithinPartitions("key", "at").select("key", "delta")
    segments = ordered.mapInArrow(_clamped, f"key {kind}, part int, serial long, add long, least long, high long, top long")
    listed = F.array_sort(F.collect_list(F.struct("part", "serial", "add", "least", "high", "top")))
    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("peak"))
    step = lambda s, x: F.struct(
        F.greatest(s["now"] + x["add"], x["least"]).alias("now"), F.greatest(s["peak"], s["now"] + x["high"], x["top"]).alias("peak")
    )
    return segments.groupBy("key").agg(F.aggregate(listed, zero, step).alias("s")).select(F.col("key").alias(key), F.col("s.now").alias("used"), F.col("s.peak").alias("peak"))


#: The window at first, at most and at least, and the threshold of its fast growth (fixed values).
WINDOW, MOST_WINDOW, LEAST_WINDOW, THRESHOLD = 4.0, 64.0, 2.0, 32.0


def aimd(samples: DataFrame, key: str, order: str, rtt: str, ok: str) -> DataFrame:
    """Per key: a window of requests, its threshold, the smoothed round trip, its deviation, and the time to wait for an answer.

    A success adds one to the window below the threshold, else its inverse; a
    failure halves both, and tells nothing of the round trip.
    """

    def step(s: tuple, x: float, good: bool) -> tuple:
        window, threshold, srtt, var = s
        if not good:
            half = max(window / 2, LEAST_WINDOW)
            return half, half, srtt, var
        srtt, var = (x, x / 2) if srtt is None else (0.875 * srtt + 0.125 * x, 0.75 * var + 0.25 * abs(srtt - x))
        return min(MOST_WINDOW, window + (1 if window < threshold else 1 / window)), threshold, srtt, var

    rows = samples.withColumn(rtt, F.col(rtt).cast("double"))
    wait = lambda s: 1000.0 if s[2] is None else max(1000.0, s[2] + 4 * s[3])
    return fold(rows, key, order, [rtt, ok], lambda: (WINDOW, THRESHOLD, None, 0.0), step, lambda s: (*s, wait(s)), "cwnd double, ssthresh double, srtt double, rttvar double, rto double")


def outbox(intents: DataFrame, now_ms: int, lease_ms: int = 300_000) -> DataFrame:
    """Cleanup intents after one scheduler step: due ones are leased, expired leases go back to pending, finished ones go."""
    due = (F.col("state") == "pending") & (F.col("next_attempt_at") <= now_ms)
    lapsed = (F.col("state") == "in_flight") & (F.col("updated_at") + lease_ms <= now_ms)
    state = F.when(due, "in_flight").when(lapsed, "pending").otherwise(F.col("state"))
    out = intents.withColumns({"new_state": state, "new_attempts": F.col("attempts") + F.when(due, 1).otherwise(0), "new_generation": F.col("generation") + F.when(due | lapsed, 1).otherwise(0)})
    return out.where(F.col("state") != "cleaned")


def illegal_transitions(log: DataFrame, key: str, order: str, state: str, legal: dict[str, set[str]]) -> DataFrame:
    """Rows whose state may not follow the one before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    ok = F.lit(False)
    for a, after in legal.items():
        ok = ok | ((F.col("before") == a) & F.col(state).isin(*after))
    return log.withColumn("before", before).where(F.col("before").isNotNull() & ~ok)


def revisions(mutations: DataFrame) -> DataFrame:
    """A folder's revision, from mutations (parent_id, and for moves new_parent_id): each one bumps the folder, a move both if they differ."""
    place = lambda c: F.coalesce(c, F.lit(""))
    one = F.array(place("parent_id"))
    if "new_parent_id" in mutations.columns:
        one = F.when(F.col("op") == "move", F.array_distinct(F.array(place("parent_id"), place("new_parent_id")))).otherwise(one)
    return mutations.select(F.explode(one).alias("parent_id")).groupBy("parent_id").agg(F.count("*").alias("revision"))


def appended(log: DataFrame, new: DataFrame, key: str = "path_id", order: str = "ts") -> DataFrame:
    """New ops with the next numbers of their paths, in their order."""
    last = log.groupBy(key).agg(F.max("seq").alias("__last"))
    w = Window.partitionBy(key).orderBy(order)
    return new.withColumn("__place", F.row_number().over(w)).join(last, key, "left").withColumn("seq", F.coalesce("__last", F.lit(0)) + F.col("__place")).drop("__last", "__place")


def log_page(log: DataFrame, path: str, after: int, limit: int = 1000) -> DataFrame:
    """A path's ops after a number, at most ``limit``, each with whether more follow the page."""
    rows = log.where((F.col("path_id") == path) & (F.col("seq") > after)).orderBy("seq").limit(limit + 1)
    more = F.count("*").over(Window.partitionBy("path_id")) > limit
    return rows.withColumn("has_more", more).orderBy("seq").limit(limit)


def compacted_if(log: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log after checkpoints (path_id, expected_next, ts, value) that apply only if the path's next number is still the expected one, and each one's outcome."""
    now = log.groupBy("path_id").agg((F.max("seq") + 1).alias("next"))
    out = asked.join(now, "path_id", "left").withColumn("next", F.coalesce("next", F.lit(1)))
    out = out.withColumn("applied", F.col("next") == F.col("expected_next"))
    done = out.where("applied").select("path_id", F.col("next").alias("seq"), F.lit("checkpoint").alias("kind"), "ts", "value")
    kept = log.join(done.select("path_id"), "path_id", "left_anti").select("path_id", "seq", "kind", "ts", "value")
    return kept.unionByName(done), out.select("path_id", "next", "applied")


def expired_uploads(sessions: DataFrame, now_ms: int, most: int = 5) -> DataFrame:
    """Sessions (state, expires_at, attempts, failed) after a sweep: of those past their time, open or half ended, each is aborted unless that ``failed``; ``most`` failures poison it."""
    due = F.col("state").isin("open", "finalizing", "aborting") & (F.col("expires_at") < now_ms)
    lost, tried = due & F.col("failed"), F.col("attempts") + 1
    return sessions.withColumns({"new_attempts": F.when(lost, tried).otherwise(F.col("attempts")), "new_state": F.when(lost & (tried >= most), "poisoned").when(due & ~F.col("failed"), "aborted").otherwise(F.col("state"))})


def concurrency(transfers: DataFrame, key: str, order: str, ms: str, ok: str, lanes: int = 8, most: int = 64, window: int = 8, ring: int = 32) -> DataFrame:
    """Per key: lanes after a trace of transfers.

    Every ``window`` successes four lanes are added if the 95th percentile of the
    last ``ring`` times (nearest rank) is below 1.2 times their median; a failure
    halves the lanes, to one at least.
    """

    def step(s: tuple, x: float, good: bool) -> tuple:
        n, times, successes = s
        if not good:
            return max(1, n // 2), times, successes
        times, successes = (*times[-ring + 1 :], x), successes + 1
        if n < most and successes >= window:
            ranked = sorted(times)
            rank = lambda q: ranked[min(len(ranked) - 1, int(q * len(ranked)))]
            n, successes = (min(most, n + 4) if rank(0.95) < 1.2 * max(rank(0.5), 1.0) else n), 0
        return n, times, successes

    return fold(transfers.withColumn(ms, F.col(ms).cast("double")), key, order, [ms, ok], lambda: (lanes, (), 0), step, lambda s: (s[0],), "lanes int")


def justified(photos: DataFrame, key: str, order: str, aspect: str, width: float, height: float, gap: float = 0.0) -> DataFrame:
    """Photos of each album in rows of one width: a row is full when the height that fills it is ``height`` or less.

    ``row`` is its number, ``row_height`` that height, 1.8 times ``height`` at
    most; a last row of one or two photos that would be over 1.5 times as high
    has ``height``.
    """
    kinds = dict(photos.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, row int, row_height double"
    names, types = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, row, held, total = None, False, 0, [], 0.0

        def full(last: bool) -> list[tuple]:
            fits = (width - (len(held) - 1) * gap) / total
            fits = height if last and len(held) < 3 and fits > 1.5 * height else min(fits, 1.8 * height)
            return [(now, p, row, fits) for p in held]

        for b in batches:
            out = []
            for k, at, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if begun and k != now:
                    out += full(True) if held else []
                    row, held, total = 0, [], 0.0
                now, begun = k, True
                held.append(at)
                total += a
                if (width - (len(held) - 1) * gap) / total <= height:
                    out += full(False)
                    row, held, total = row + 1, [], 0.0
            if out:
                yield _batch(out, names, types)
        if held:
            yield _batch(full(True), names, types)

    rows = photos.select(key, order, F.col(aspect).cast("double").alias("a"))
    return rows.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(run, schema)


def coalesced(requests: DataFrame, keys: list[str], at: str, width_ms: int) -> DataFrame:
    """One row for equal requests of one window of time."""
    return requests.select(*keys, F.floor(F.col(at) / width_ms).alias("window")).distinct()


def throttled(samples: DataFrame, key: str, at: str, value: str, width: int) -> DataFrame:
    """The last sample of each key and window, the greatest of equal times."""
    bucket = F.floor(F.col(at) / width).alias("bucket")
    return samples.groupBy(key, bucket).agg(F.max_by(value, F.struct(at, value)).alias(value))


def tiers(writes: DataFrame, user: str, order: str, size: str, most: int = 16 << 10, cap: int = 1 << 30) -> DataFrame:
    """Where each write's bytes go: inline for small ones while the user's inline bytes stay within the cap, else chunks; a write that does not fit takes nothing of it."""
    kinds = dict(writes.dtypes)
    schema = f"{user} {kinds[user]}, {order} {kinds[order]}, tier string, inline_bytes long"
    names, types = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, used = None, False, 0
        for b in batches:
            out = []
            for k, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or k != now:
                    now, begun, used = k, True, 0
                fits = n <= most and used + n <= cap
                used += n if fits else 0
                out.append((k, at, "inline" if fits else "chunks", used))
            if out:
                yield _batch(out, names, types)

    return writes.select(user, order, F.col(size).cast("long").alias("n")).repartition(F.col(user)).sortWithinPartitions(user, order).mapInArrow(run, schema)
