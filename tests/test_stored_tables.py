"""Stored call log and cache under replays, and the spend guard on a stream, against their batch forms."""
import random
from pathlib import Path

from pyspark.sql import functions as F

from attestor import schemas as SC
from attestor.operators import report as RP
from attestor.sources import stores as ST
from attestor.streaming import streams as SM

CALLS = "call_id long, s double, cost_usd double"


def call_rows(spark, rows):
    return spark.createDataFrame(rows, CALLS).select("call_id", F.col("s").cast("timestamp").alias("ts"), "cost_usd")


def some_calls(n, seed=3, start=1.7e9, span=3 * 86400):
    rnd = random.Random(seed)
    return [(i, start + rnd.randrange(span), rnd.randrange(64) / 64) for i in range(n)]


def test_log_is_the_same_after_replays(spark, tmp_path):
    rows, path = call_rows(spark, some_calls(90) + [(90, None, 1.0)]), str(tmp_path / "log")
    for k in (0, 1, 2, 1, 2):
        ST.append_calls(rows.filter(F.col("call_id") % 3 == k), path, k)
    stored = ST.read_calls(spark, path, rows.withColumn("day", F.lit("")).schema)
    assert sorted(r.call_id for r in stored.collect()) == list(range(91))
    assert {r.day for r in stored.filter("ts IS NULL").collect()} == {None}
    day = rows.select(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    one = stored.filter(F.col("day") == day)
    assert one.count() == rows.filter(F.date_format("ts", "yyyy-MM-dd") == day).count()
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()


def test_log_stream_goes_on_after_a_restart(spark, tmp_path):
    src, path, check = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    rows = call_rows(spark, some_calls(40))
    for k in (0, 1):
        rows.filter(F.col("call_id") % 2 == k).write.mode("append").parquet(src)
        ST.log_stream(spark.readStream.schema(rows.schema).parquet(src), path, check).trigger(availableNow=True).start().awaitTermination()
    got = ST.read_calls(spark, path, rows.schema)
    assert sorted(r.call_id for r in got.collect()) == list(range(40))


def test_stored_cache_equals_the_latest_of_all_batches(spark, tmp_path):
    rnd, path = random.Random(5), str(tmp_path / "cache")
    assert ST.read_entries(spark, path).count() == 0
    batches = [[(f"k{rnd.randrange(30)}", f"v{rnd.randrange(9)}", float(rnd.randrange(20))) for _ in range(40)] for _ in range(3)]
    want = {}
    for batch in (*batches, batches[0]):
        ST.upsert_stored(spark.createDataFrame(batch, SC.CACHE_ENTRY), path, 4)
        for k, v, t in batch:
            want[k] = max(want.get(k, (-1.0, "")), (t, v))
    assert {r.k: (r.t, r.v) for r in ST.read_entries(spark, path).collect()} == want
    ST.upsert_stored(spark.createDataFrame([], SC.CACHE_ENTRY), path, 4)
    assert ST.read_entries(spark, path).count() == len(want)


def test_small_batch_writes_its_buckets_only(spark, tmp_path):
    path = tmp_path / "cache"
    files = lambda: {str(f) for f in Path(path).glob("bucket=*/*.parquet")}
    ST.upsert_stored(spark.createDataFrame([(f"k{i}", "v", 1.0) for i in range(60)], SC.CACHE_ENTRY), str(path), 4)
    before = files()
    ST.upsert_stored(spark.createDataFrame([("k1", "new", 2.0)], SC.CACHE_ENTRY), str(path), 4)
    changed = {f.split("bucket=")[1][0] for f in files() ^ before}
    assert len(changed) == 1
    assert ST.read_entries(spark, str(path)).count() == 60


def guarded(spark, folder, schema, tmp_path, limit=5.0):
    stream = SM.spend_guard_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), limit)
    SM.run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    return {r.call_id: (r.spent_before, r.guard_active) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}


def test_spend_guard_stream_equals_batch_after_a_restart(spark, tmp_path):
    """Three arrivals, each mixed up inside the hour and overlapping the one before; stopped and started again."""
    first = 1_700_000_000 // 86400 * 86400 + 86400 - 5400.0  # the stream crosses midnight
    rnd = random.Random(9)
    calls = sorted((first + rnd.randrange(4 * 3600) + rnd.randrange(64) / 64, i, rnd.randrange(64) / 64) for i in range(150))
    order = sorted(calls, key=lambda c: c[0] + rnd.randrange(1500))  # nobody is more than 25 minutes late
    rows = [[(i, s, cost) for s, i, cost in order[k : k + 50]] for k in (0, 50, 100)]
    folder, every = str(tmp_path / "in"), call_rows(spark, [r for part in rows for r in part])
    for part in rows:
        call_rows(spark, part).coalesce(1).write.mode("append").parquet(folder)
        got = guarded(spark, folder, every.schema, tmp_path)
    batch = RP.spend_guard(every.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), 5.0)
    passed = int(max(c[0] for c in calls) - 3600) // 60 * 60
    want = {r.call_id: (r.spent_before, r.guard_active) for r in batch.filter(F.col("ts").cast("double") < passed).collect()}
    assert got == want
    assert {g for _, g in want.values()} == {True, False}


def test_late_calls_are_dropped_and_null_costs_count_as_zero(spark, tmp_path):
    folder = str(tmp_path / "in")
    start = 1_700_000_000 // 86400 * 86400 + 3600.0
    parts = [[(1, start, None), (2, start + 1, 6.0), (3, start + 7300, 1.0)], [(4, start + 2, 1.0), (5, None, 1.0), (6, start + 20000, 0.5)]]
    for part in parts:
        rows = call_rows(spark, part)
        rows.coalesce(1).write.mode("append").parquet(folder)
        got = guarded(spark, folder, rows.schema, tmp_path)
    assert got == {1: (0.0, False), 2: (0.0, False), 3: (6.0, True)}
