"""Streaming forms: verdicts as documents arrive, request limits, answers reused, activity, progress, sessions."""
from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

LATE = "1 hour"  # later rows are dropped and show in the query's progress


# --------------------------------------------------------------------------- verdicts


def verify_stream(docs: DataFrame, verify: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, query_name: str):
    """Runs ``verify`` on every micro-batch of ``docs`` and appends its verdicts, one folder per batch.

    A batch that is replayed after a failure overwrites its own folder, so no verdict is written twice. Start one
    query for the scans and one for the retrieval flows: the certain verdicts then come first.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        verify(batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return docs.writeStream.queryName(query_name).foreachBatch(write).option("checkpointLocation", checkpoint)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(sink) -> None:
    """Runs a stream over all that is there, on the RocksDB state store; the session's own setting is put back."""
    spark = sink._spark
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = sink.trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()


# --------------------------------------------------------------------------- request limit


def split_at_pauses(events: DataFrame, key: str, ts: str, gap: float) -> DataFrame:
    """Adds ``part``: a new part begins after a pause longer than ``gap`` seconds.

    Per hour first; only one row per hour crosses hours, so a client with very many events is spread over tasks.
    """
    sec = F.col(ts).cast("timestamp").cast("double")
    rows = events.withColumn("_s", sec).withColumn("_h", F.floor(F.col("_s") / 3600))
    hours = rows.groupBy(key, "_h").agg(F.max("_s").alias("_last"))
    hours = hours.withColumn("_before", F.lag("_last").over(W.partitionBy(key).orderBy("_h"))).drop("_last")
    w = W.partitionBy(key, "_h").orderBy("_s")
    rows = rows.join(hours, [key, "_h"]).withColumn("_prev", F.coalesce(F.lag("_s").over(w), F.col("_before")))
    rows = rows.withColumn("_new", F.when(F.coalesce(F.col("_s") - F.col("_prev") > gap, F.lit(True)), 1).otherwise(0))
    counts = rows.groupBy(key, "_h").agg(F.sum("_new").alias("_n"))
    counts = counts.select(key, "_h", F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_n0"))
    inside = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(counts, [key, "_h"]).withColumn("part", F.col("_in") + F.col("_n0")).drop("_h", "_before", "_prev", "_new", "_in", "_n0")


def limit_requests(events: DataFrame, limit: int = 30, window: float = 600.0, key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Events with ``denied``: as many accepted requests of the client as allowed lie in the last ``window`` seconds.

    Denied requests do not count, so this is a fold. A pause longer than the window empties it: each pause-free part
    is folded by itself, streaming through its task with at most ``limit`` remembered times.
    """
    if limit <= 0:
        return events.withColumn("denied", F.lit(False))
    parts = split_at_pauses(events.select(id_col, key, ts), key, ts, window).select(id_col, key, "part", "_s")
    ordered = parts.repartition(key, "part").sortWithinPartitions(key, "part", "_s", id_col)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for pdf in batches:
            denied = []
            for k, part, now in zip(pdf[key], pdf["part"], pdf["_s"]):
                if (k, part) != current:
                    current, accepted = (k, part), deque()
                while accepted and now - accepted[0] > window:
                    accepted.popleft()
                full = len(accepted) >= limit
                denied.append(full)
                if not full:
                    accepted.append(now)
            yield pd.DataFrame({id_col: pdf[id_col], "denied": denied})

    types = dict(events.dtypes)
    flags = ordered.mapInPandas(fold, f"{id_col} {types[id_col]}, denied boolean")
    return events.join(flags, id_col)


def limit_requests_stream(events: DataFrame, limit: int = 30, window: float = 600.0, key: str = "user_id") -> DataFrame:
    """The same on a stream (event_id, user_id, ts): accepted times are the state; idle clients are forgotten."""

    def on_events(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        denied = []
        for now in rows["ts"].astype("datetime64[us]").astype("int64") / 1e6:
            while accepted and now - accepted[0] > window:
                accepted.popleft()
            denied.append(len(accepted) >= limit)
            if not denied[-1]:
                accepted.append(now)
        state.update((list(accepted),))
        last = accepted[-1] if accepted else 0.0
        state.setTimeoutTimestamp(max(int((last + window) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"].values, key: rows[key].values, "denied": denied})

    timed = events.withWatermark("ts", LATE)
    return timed.groupBy(key).applyInPandasWithState(
        on_events, f"event_id bigint, {key} bigint, denied boolean", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


# --------------------------------------------------------------------------- spend guard

MINUTE = 60_000
GUARDED = "call_id bigint, spent_before double, guard_active boolean"


class SpendGuard(StatefulProcessor):
    """State of a day: what its finished minutes cost, and the calls of minutes that the watermark has not passed.

    Calls arrive in any order inside the watermark. A timer at the end of the oldest open minute lets the finished
    minutes out in order of time; the one at the end of the day removes the state.
    """

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "total double")
        self.open = handle.getMapState("open", "ts_us bigint, call_id bigint", "cost double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for pdf in rows:
            for at, call_id, cost in zip(pdf["ts_us"].tolist(), pdf["call_id"].tolist(), pdf["cost_usd"].fillna(0.0).tolist()):
                self.open.updateValue((at, call_id), (cost,))
                oldest = at if oldest is None else min(oldest, at)
        if oldest is not None:
            self._wake(oldest, key[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day_end = key[0]
        passed = timerValues.getCurrentWatermarkInMs() // MINUTE * MINUTE
        waiting = sorted((k[0], k[1], v[0]) for k, v in self.open.iterator())
        done = [w for w in waiting if w[0] < passed * 1000]
        total = self.spent.get()[0] if self.spent.exists() else 0.0
        out = []
        for at, call_id, cost in done:
            before = round(total, 6)
            out.append((call_id, before, self.limit > 0 and before >= self.limit))
            total += cost
            self.open.removeKey((at, call_id))
        if len(done) < len(waiting):
            self._wake(waiting[len(done)][0], day_end)
        if passed >= day_end:
            self.spent.clear()
        else:
            self.spent.update((total,))
            if len(done) == len(waiting):
                self.handle.registerTimer(day_end)
        if out:
            yield pd.DataFrame(out, columns=["call_id", "spent_before", "guard_active"])

    def _wake(self, at_us: int, day_end: int) -> None:
        self.handle.registerTimer(min((at_us // 1000 // MINUTE + 1) * MINUTE, day_end))

    def close(self) -> None:
        pass


def spend_guard_stream(calls: DataFrame, limit: float) -> DataFrame:
    """``report.spend_guard`` on a stream (call_id, ts, cost_usd): (call_id, spent_before, guard_active).

    A call comes out once the watermark has passed its minute, so calls that arrive out of order inside ``LATE`` get
    the values of the batch form; later ones are dropped. A null cost counts as 0, a call without a time is dropped, a
    call that comes twice with one time counts once while its minute is open. A day's calls are in one task, as
    each depends on all before it; only minutes still open are held. Needs the RocksDB state store.
    """
    day = F.date_trunc("day", "ts")
    rows = calls.withWatermark("ts", LATE).filter(F.col("ts").isNotNull()).select(
        "ts", "call_id", "cost_usd", F.unix_micros("ts").alias("ts_us"), F.unix_millis(day + F.expr("INTERVAL 1 DAY")).alias("day_end")
    )
    return rows.groupBy("day_end").transformWithStateInPandas(SpendGuard(limit), GUARDED, "Append", "EventTime")


# --------------------------------------------------------------------------- answers, activity, progress, sessions


def reuse_answers_stream(answers: DataFrame, max_age: str = "30 days") -> DataFrame:
    """First answer per key wins for ``max_age``."""
    return answers.withWatermark("ts", max_age).dropDuplicatesWithinWatermark(["k"])


def reuse_answers(answers: DataFrame, max_age_days: int = 30) -> DataFrame:
    """Batch form: answers of a key that are more than ``max_age_days`` after the last one that counted.

    A pause of more than that always lets the next answer count, so a key's answers are cut at such pauses and each
    stretch is folded by itself. ``period`` numbers the answers of a key that count, from 0.
    """
    by_time = W.partitionBy("k").orderBy("ts", "v")
    seconds = F.col("ts").cast("double")
    rows = answers.select("k", "ts", "v", seconds.alias("s"))
    rows = rows.withColumn("cut", F.coalesce(F.col("s") - F.lag("s").over(by_time) > max_age_days * 86400, F.lit(True)).cast("int"))
    parts = rows.withColumn("part", F.sum("cut").over(by_time)).groupBy("k", "part").agg(F.array_sort(F.collect_list(F.struct("ts", "v", "s"))).alias("a"))
    first = F.element_at("a", 1)
    start = F.struct(first["s"].alias("last"), F.array(first).alias("kept"))
    step = lambda acc, x: F.when(x["s"] - acc["last"] > max_age_days * 86400, F.struct(x["s"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    kept = parts.select("k", F.explode(F.aggregate("a", start, step, lambda acc: acc["kept"])).alias("m")).select("k", "m.ts", "m.v")
    return kept.withColumn("period", (F.row_number().over(by_time) - 1).cast("long")).select("k", "period", "ts", "v")


def activity(events: DataFrame, now: Column, days: int = 7, keep_days: int = 35) -> DataFrame:
    """Per user: verifications in the last ``days`` and in the remembered period; one count per instant."""
    age = (now.cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400
    kept = events.select("user_id", "ts").distinct().withColumn("age", age).filter((F.col("age") <= keep_days) & (F.col("age") >= 0))
    return kept.groupBy("user_id").agg(F.count_if(F.col("age") < days).alias("this_week"), F.count("*").alias("remembered"))


def activity_windows(events: DataFrame) -> DataFrame:
    """Counts per user over seven days sliding by one; works on a batch and, with its watermark, on a stream."""
    timed = events.withWatermark("ts", LATE) if events.isStreaming else events
    return timed.groupBy("user_id", F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n")


def progress(steps: DataFrame) -> DataFrame:
    """Done and total per document and stage (``update`` mode on a stream). ``steps``: (doc_id, stage, is_done)."""
    return steps.groupBy("doc_id", "stage").agg(F.count_if("is_done").alias("done"), F.count("*").alias("total"))


def timed_sessions(lines: DataFrame, gap: str = "2500 milliseconds", key: str = "doc_id") -> DataFrame:
    """Timed lines grouped while the pause stays under ``gap``: (key, from_ts, to_ts, n)."""
    timed = lines.withWatermark("ts", LATE) if lines.isStreaming else lines
    return timed.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("from_ts"), F.col("s.end").alias("to_ts"), "n")
