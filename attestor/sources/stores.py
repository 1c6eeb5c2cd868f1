"""Stored tables: call log, response cache, label files, result rows, reports."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import schemas as S
from ..session import cut_lineage

BUCKETS = 64  # folders of a stored cache; chosen once, when the cache is begun


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TESTSET).json(path)


def write_labels(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_calls(calls: DataFrame, path: str, batch_id: int = 0) -> None:
    """Adds a batch of calls to the log, a folder per day and batch.

    A batch that is written again after a failure replaces its own folders only: no call is lost or stands twice.
    Calls without a time are kept, in the folder of the null day.
    """
    rows = calls.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)


def read_calls(spark: SparkSession, path: str, schema: StructType = S.CALL_LOG) -> DataFrame:
    """The stored calls; a filter on ``day`` reads that day's folders only."""
    return spark.read.schema(schema).parquet(path).drop("batch_id")


def log_stream(calls: DataFrame, path: str, checkpoint: str):
    """Appends every micro-batch of ``calls`` to the log; a restart replays the unfinished batch under its own id."""
    return calls.writeStream.foreachBatch(lambda batch, batch_id: append_calls(batch, path, batch_id)).option("checkpointLocation", checkpoint)


def cache_key(namespace: str, *parts: Column) -> Column:
    return F.concat(F.lit(namespace + ":"), F.sha2(F.concat_ws("\u001f", *parts), 256))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Latest value per key: (k, v, t)."""
    return stored.unionByName(new).groupBy("k").agg(F.max(F.struct("t", "v")).alias("m")).select("k", "m.v", "m.t")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The stored entries (k, v, t, bucket); empty where nothing has been stored."""
    schema = StructType([*S.CACHE_ENTRY.fields, StructField("bucket", IntegerType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert_stored(new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Merges entries (k, v, t) into the cache stored in ``path``; the latest value of a key stays, of equal times the greatest.

    Keys are spread over ``buckets`` folders by hash. Only the buckets that ``new`` touches are read and written,
    so a small batch costs its buckets, not the cache. Writing a batch again changes nothing. The merged rows are
    written aside first; a job that is stopped while the folders are exchanged can lose entries of the touched
    buckets, which for a cache means answers that are asked for once more.
    """
    spark = new.sparkSession
    rows = cut_lineage(new.select("k", "v", "t").withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")))
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    stored = read_entries(spark, path).filter(F.col("bucket").isin(touched))
    latest = stored.unionByName(rows).groupBy("bucket", "k").agg(F.max(F.struct("t", "v")).alias("m")).select("k", "m.v", "m.t", "bucket")
    merged = cut_lineage(latest.repartition("bucket"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def cache_stream(entries: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Merges every micro-batch of entries into the stored cache."""
    return entries.writeStream.foreachBatch(lambda batch, _: upsert_stored(batch, path, buckets)).option("checkpointLocation", checkpoint)


def read_fresh(entries: DataFrame, now: Column, max_age: float | None = None) -> DataFrame:
    return entries if max_age is None else entries.filter(now - F.col("t") <= max_age)


def merge_results(stored: DataFrame, new: DataFrame, label: str = "label") -> DataFrame:
    """Rows of a new run replace the stored ones of the same label; other labels stay."""
    kept = stored.join(new.select(label).distinct(), label, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def report(verdicts: DataFrame, segments: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One nested row per document: verdicts by position, segments in order, counts per state."""
    detail = [c for c in verdicts.columns if c not in ("doc_id", "start")]
    cards = verdicts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", *detail))).alias("verdicts"), F.count("*").alias("total"))
    states = verdicts.groupBy("doc_id", "state").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("by_state"))
    segs = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("segments"))
    out = segs.join(cards, "doc_id", "left").join(states, "doc_id", "left").fillna(0, ["total"])
    return out if sources is None else out.join(sources, "doc_id", "left")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
