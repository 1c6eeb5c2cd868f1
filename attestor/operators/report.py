"""Report aggregates, log roll-ups and display orders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def counts_by_state(verdicts: DataFrame) -> DataFrame:
    """Zero-filled verdict counts per document and their total."""
    agg = [F.count_if(F.col("state") == s).alias(s) for s in V.STATES]
    return verdicts.groupBy("doc_id").agg(F.count("*").alias("total"), *agg)


def summary(verdicts: DataFrame, stages: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per document: counts, stage seconds as a map, distinct warnings in order of appearance.

    ``stages``: (doc_id, stage, seconds); ``warnings``: (doc_id, n, warning).
    """
    sec = stages.groupBy("doc_id", "stage").agg(F.round(F.sum("seconds"), 2).alias("s")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "s")))).alias("stage_seconds"))
    first = warnings.groupBy("doc_id", "warning").agg(F.min("n").alias("n"))
    warn = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "warning"))), lambda x: x["warning"]).alias("warnings"))
    return counts_by_state(verdicts).join(sec, "doc_id", "left").join(warn, "doc_id", "left")


def tally(verdicts: DataFrame) -> DataFrame:
    """Citations by state, questions apart."""
    cited = ~F.col("is_question")
    agg = [F.count_if(cited & (F.col("state") == s)).alias(s) for s in V.STATES]
    return verdicts.groupBy("doc_id").agg(F.count_if(cited).alias("citations"), F.count_if("is_question").alias("questions"), *agg)


def usage_rollup(calls: DataFrame, days: int = 7) -> DataFrame:
    """Calls per (day, task, model) on the most recent ``days`` distinct days."""
    per = calls.groupBy("day", "task", "model").agg(
        F.count("*").alias("calls"), F.sum(F.col("ok").cast("int")).alias("ok"), F.sum(F.col("fallback").cast("int")).alias("fallback_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.floor(F.avg("latency_ms")).cast("bigint").alias("avg_latency_ms"),
    )
    # the days are few: rank them by themselves, then keep their rows
    recent = per.select("day").distinct().orderBy(F.desc("day")).limit(days)
    return per.join(F.broadcast(recent), "day", "left_semi")


def spent_on(calls: DataFrame, day: Column, limit: float) -> DataFrame:
    spent = calls.filter(F.col("day") == day).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("spent"))
    return spent.select("spent", F.lit(limit).alias("daily_limit"), ((F.col("spent") >= limit) & F.lit(limit > 0)).alias("guard_active"))


def spend_guard(calls: DataFrame, limit: float) -> DataFrame:
    """Calls with what was spent earlier that day and whether the guard was active; a limit of 0 switches it off.

    The running total of a day is formed per hour first, so a busy day is spread over its hours.
    """
    rows = calls.withColumn("hour", F.hour("ts"))
    hours = rows.groupBy("day", "hour").agg(F.sum("cost_usd").alias("h"))
    earlier = hours.select("day", "hour", F.coalesce(F.sum("h").over(W.partitionBy("day").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("h0"))
    within = F.coalesce(F.sum("cost_usd").over(W.partitionBy("day", "hour").orderBy("ts", "call_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    out = rows.withColumn("in_hour", within).join(earlier, ["day", "hour"]).withColumn("spent_before", F.round(F.col("in_hour") + F.col("h0"), 6))
    return out.withColumn("guard_active", F.lit(limit > 0) & (F.col("spent_before") >= limit)).drop("hour", "in_hour", "h0")


def sources_used(verdicts: DataFrame) -> DataFrame:
    """(doc_id, name, url): every source name with the first link seen for it.

    ``verdicts``: (doc_id, start, sources array<struct<name,url>>) with sources, other sources and grades in order.
    """
    s = verdicts.select("doc_id", "start", F.posexplode("sources").alias("k", "s"))
    return s.groupBy("doc_id", F.col("s.name").alias("name")).agg(F.min_by("s.url", F.struct("start", "k")).alias("url"))


def distinct_grade_rows(grades: DataFrame) -> DataFrame:
    """(claim_id, gradings): distinct wordings in source order. ``grades``: (claim_id, n, text)."""
    first = grades.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).groupBy("claim_id", "text").agg(F.min("n").alias("n"))
    return first.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("gradings"))


def scan_trace(corpora: dict[str, DataFrame], claims: DataFrame) -> DataFrame:
    """One row: corpus sizes as scalar subqueries, hits per kind, marker count."""
    hits = claims.agg(
        F.count_if((F.col("type") == "ayah") & F.col("origin").endswith("_scan")).alias("canon_hits"),
        F.count_if((F.col("type") == "hadith") & F.col("origin").endswith("_scan")).alias("record_hits"),
        F.count_if(F.col("origin") == "marker").alias("markers"),
    )
    return hits.select("*", *[df.agg(F.count("*")).scalar().alias(f"{name}_size") for name, df in corpora.items()])


def verify_trace(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("notes"), F.coalesce(F.sum(F.size("grades")), F.lit(0)).alias("gradings"))


def risk_rank(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in V.STATES_BY_RISK]), state)


def by_attention(verdicts: DataFrame) -> DataFrame:
    """Adds the place of each verdict, riskiest state first, then text order (and the plain text order)."""
    at = F.coalesce("start", "index")
    first = W.partitionBy("doc_id").orderBy(risk_rank(F.col("state")), at, "index")
    text = W.partitionBy("doc_id").orderBy(at, "index")
    return verdicts.withColumn("attention_rank", F.row_number().over(first)).withColumn("text_rank", F.row_number().over(text))


def cap_grades(grades: DataFrame, limit: int = 6) -> DataFrame:
    w = W.partitionBy("claim_id").orderBy("n")
    return grades.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")
