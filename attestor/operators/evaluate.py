"""Scores of predictions against labelled rows, model comparisons, picks of labelled rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V

ENDORSED = ("supported", "supported_with_note")


def judge(rows: DataFrame, preds: DataFrame, same_ref: DataFrame | None = None, checks_source: bool = True) -> DataFrame:
    """Test row joined to its prediction with the judged flags: correct, fabricated, endorsed, abstained."""
    j = rows.join(preds.drop("detail"), "id")
    if same_ref is not None:
        j = j.join(same_ref, "id", "left")
    else:
        j = j.withColumn("same_ref", F.col("ref").eqNullSafe(F.col("expected_ref")))
    up = F.col("state").isin(*ENDORSED)
    abstain = F.col("category").isin(*V.ABSTAIN_CATEGORIES)
    on_canon = F.coalesce(F.col("expected_ref").startswith("canon:"), F.lit(False))
    fabricated = up & ((F.lit(checks_source) & ~F.col("has_source")) | abstain | (on_canon & ~F.coalesce("same_ref", F.lit(False))))
    return j.withColumns(
        {
            "correct": F.col("state") == F.col("expected_state"),
            "fabricated": fabricated,
            "endorsed": up & ~F.col("expected_state").isin(*ENDORSED) & (F.col("category") != "quote_misattributed"),
            "abstain_row": abstain,
            "abstained": abstain & (F.col("state") == "not_found") & ~F.col("has_source"),
        }
    )


def accuracy(judged: DataFrame) -> DataFrame:
    """Per (system, run): overall rates, failing ids in order, seconds per claim."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.col("id")))), ",")
    return judged.groupBy("system", "run").agg(
        F.count("*").alias("n"), rate("correct").alias("accuracy"), rate("fabricated").alias("fabricated_rate"), ids("fabricated").alias("fabricated_ids"),
        rate("endorsed").alias("endorsed_rate"), ids("endorsed").alias("endorsed_ids"),
        F.round(F.try_divide(F.count_if("abstained"), F.count_if("abstain_row")), 4).alias("abstention_rate"),
        F.count_if(F.col("state") == "no_output").alias("no_output"), F.round(F.avg("seconds"), 3).alias("seconds_per_claim"),
    )


def per_state(judged: DataFrame) -> DataFrame:
    """Precision, recall and support of every state, null where undefined: one pass, no pivot over data values."""
    got = judged.select("system", "run", F.explode(F.array(F.struct(F.col("state").alias("s"), F.lit(1).alias("p"), F.lit(0).alias("e")), F.struct(F.col("expected_state").alias("s"), F.lit(0).alias("p"), F.lit(1).alias("e")))).alias("x"), "correct")
    c = got.groupBy("system", "run", F.col("x.s").alias("state")).agg(
        F.sum("x.p").alias("predicted"), F.sum("x.e").alias("support"), F.sum(F.when(F.col("correct") & (F.col("x.p") == 1), 1).otherwise(0)).alias("tp")
    )
    return c.filter(F.col("state").isin(*V.STATES)).select(
        "system", "run", "state", F.round(F.try_divide("tp", "predicted"), 4).alias("precision"), F.round(F.try_divide("tp", "support"), 4).alias("recall"), "support"
    )


def per_category(judged: DataFrame) -> DataFrame:
    return judged.groupBy("system", "run", "category").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.round(F.avg(F.col("correct").cast("double")), 3).alias("accuracy")
    )


def over_runs(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(system, metric, mean, std): population standard deviation over runs."""
    long = scores.select("system", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    return long.groupBy("system", "x.metric").agg(F.round(F.avg("x.v"), 4).alias("mean"), F.round(F.stddev_pop("x.v"), 4).alias("std"))


def rows_per_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def compare_models(items: DataFrame, calls: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per label, complete runs first, then by state accuracy, level accuracy and cost.

    ``items``: (label, state_ok, type_ok, level_ok, mode, seconds); ``calls``: (label, ok, error, cost);
    ``quotes``: (label, exact).
    """
    mean = lambda c: F.avg(F.col(c).cast("double"))
    i = items.groupBy("label").agg(
        F.count("*").alias("n"), mean("state_ok").alias("state_accuracy"), mean("type_ok").alias("type_accuracy"), mean("level_ok").alias("level_accuracy"),
        F.count_if(F.col("mode") != "full").alias("lexical_only_items"), mean("seconds").alias("seconds_per_item"),
    )
    failed = lambda word: F.count_if(~F.col("ok") & F.coalesce(F.col("error"), F.lit("")).contains(word))
    c = calls.groupBy("label").agg(F.count("*").alias("calls"), failed("validation").alias("invalid"), failed("402").alias("refused"), failed("truncated").alias("truncated"), F.sum("cost").alias("cost_total"))
    q = quotes.groupBy("label").agg(mean("exact").alias("exact_quote_rate"))
    out = i.join(c, "label", "left").join(q, "label", "left").withColumn("cost_per_item", F.col("cost_total") / F.col("n"))
    incomplete = ((F.coalesce("refused", F.lit(0)) > 0) | (F.col("lexical_only_items") > 0)).cast("int")
    w = W.orderBy(incomplete, F.desc("state_accuracy"), F.desc(F.coalesce("level_accuracy", F.lit(0.0))), "cost_per_item", "label")
    return out.withColumn("place", F.row_number().over(w))


def compare_transcriptions(rows: DataFrame) -> DataFrame:
    """Per model: exact, corrected, failed and mean error rate of what was read; fewest failures first."""
    return rows.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if("corrected").alias("corrected"), F.count_if("failed").alias("failed_calls"),
        F.coalesce(F.avg(F.when(~F.col("failed"), F.col("cer"))), F.lit(0.0)).alias("mean_cer"), F.avg("cost").alias("cost_per_item"),
    )


def classify_transcriptions(rows: DataFrame, norm) -> DataFrame:
    """Altered wording kept as written (exact), or the original word restored (corrected).

    ``rows``: (model, altered, original_word, inserted_word, got); ``norm``: text column -> normal form.
    """
    got, words = norm(F.col("got")), F.split(norm(F.col("got")), " ")
    exact = got.contains(norm(F.col("altered")))
    corrected = F.array_contains(words, norm(F.col("original_word"))) & ~F.array_contains(words, norm(F.col("inserted_word")))
    return rows.withColumn("exact", exact).withColumn("corrected", F.coalesce(corrected, F.lit(False)))


def stratified(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """First n rows of every category by plan. ``plan``: (category, want), one row per category."""
    w = W.partitionBy("category").orderBy("id")
    return rows.withColumn("rn", F.row_number().over(w)).join(F.broadcast(plan), "category").filter(F.col("rn") <= F.col("want")).drop("rn", "want")


def default_plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.PLAN_CATEGORIES.items()), "category string, want int")


def round_robin(rows: DataFrame, n: int = 15, low: int = 30, high: int = 220, keep=None) -> DataFrame:
    """``n`` rows taken in turn over the categories, message-sized; ``keep``: further predicate column."""
    ok = F.length("input_text").between(low, high)
    fit = rows.filter(ok if keep is None else ok & keep)
    w = W.partitionBy("category").orderBy("id")
    turn = fit.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)
    first = W.partitionBy("category")
    turn = turn.withColumn("first_id", F.min("id").over(first))
    return turn.orderBy("turn", "first_id").limit(n).select("id", "category", "input_text", "turn")
