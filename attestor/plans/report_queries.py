"""Reports, evaluation, generated rows and the batch forms of the streams."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import grades as GR
from ..functions import text as X
from ..operators import evaluate as EV
from ..operators import generate as GN
from ..operators import grams as G
from ..operators import lookup as L
from ..operators import match as M
from ..operators import report as RP
from ..operators import retrieve as RT
from ..session import new_folder
from ..streaming import streams as ST
from .common import *  # noqa: F403
from .common import Registry
from .scan_queries import BM, RETRIEVAL, SEEDS, STATS, TERMS, _FUZZY, canon, span_sql
from .text_queries import LATIN_STOP, STOP_SQL

R = Registry()
_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in V.STATES)
_CITED = ", ".join(f"count(*) FILTER (NOT is_question AND state = '{s}') AS {s}" for s in V.STATES)


@R("agg_4_counts_by_state", f"WITH {VERDICTS} SELECT doc_id, count(*) AS total, {_COUNTS} FROM verdicts GROUP BY doc_id")
def _(spark, sf):
    return RP.counts_by_state(verdict_rows(spark, sf))


@R("agg_4_summary", f"WITH {VERDICTS}, s AS (SELECT doc_id, lang, round(sum(start) / 10.0::DOUBLE, 2) AS x FROM verdicts GROUP BY ALL), f AS (SELECT doc_id, source, min(start) AS n FROM verdicts GROUP BY ALL) SELECT doc_id, count(*) AS total, (SELECT x FROM s WHERE s.doc_id = v.doc_id AND lang = 'en') AS en_seconds, (SELECT string_agg(source, ',' ORDER BY n, source) FROM f WHERE f.doc_id = v.doc_id) AS warnings FROM verdicts v GROUP BY doc_id")
def _(spark, sf):
    v = verdict_rows(spark, sf)
    s = RP.summary(v, v.select("doc_id", F.col("lang").alias("stage"), (F.col("start") / 10.0).alias("seconds")), v.select("doc_id", F.col("start").alias("n"), F.col("source").alias("warning")))
    return s.select("doc_id", "total", F.try_element_at("stage_seconds", F.lit("en")).alias("en_seconds"), F.array_join("warnings", ",").alias("warnings"))


@R("agg_5_tally", f"WITH {VERDICTS} SELECT doc_id, count(*) FILTER (NOT is_question) AS citations, count(*) FILTER (is_question) AS questions, {_CITED} FROM verdicts GROUP BY doc_id")
def _(spark, sf):
    return RP.tally(verdict_rows(spark, sf))


@R(
    "agg_6_usage_rollup",
    f"WITH {CALLS}, d AS (SELECT DISTINCT day FROM calls ORDER BY day DESC LIMIT 7) SELECT day, task, model, count(*) AS calls, count(*) FILTER (ok) AS ok, count(*) FILTER (k > 90) AS fallback_calls, CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(sum(k + 1) AS BIGINT) AS completion_tokens, 0 AS cached_tokens, round(sum(cost_usd), 6) AS cost_usd, CAST(floor(avg(k * 10)) AS BIGINT) AS avg_latency_ms FROM calls WHERE day IN (SELECT day FROM d) GROUP BY ALL",
)
def _(spark, sf):
    return RP.usage_rollup(calls(spark, sf))


@R("agg_7_spent_today", f"WITH {CALLS} SELECT round(sum(cost_usd), 6) AS spent, 100.0::DOUBLE AS daily_limit, round(sum(cost_usd), 6) >= 100 AS guard_active FROM calls WHERE day = '2024-01-15'")
def _(spark, sf):
    return RP.spent_on(calls(spark, sf), F.lit("2024-01-15"), 100.0)


# predictions: the labelled documents judged three times by a rule on their length
TEST = (
    f"{GRADED}, ts AS (SELECT CAST(key AS VARCHAR) AS id, CASE grade_class WHEN 'accepted' THEN 'supported' WHEN 'weak' THEN 'needs_review' WHEN 'fabricated' THEN 'contradicted' ELSE 'not_found' END AS expected_state, "
    "CASE WHEN key % 4 = 0 THEN 'canon:' || (key % 5 + 1) || ':' || (key % 8 + 1) ELSE 'graded:' || key END AS expected_ref, CASE WHEN grade_class = 'mixed' THEN 'no_source' ELSE lang END AS category, length(text) AS n, key FROM graded), "
    "pd AS (SELECT id, CAST(r AS INT) AS run, 'rule' AS system, CASE (n + r) % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'contradicted' WHEN 3 THEN 'supported' ELSE 'supported_with_note' END AS state, "
    "CASE WHEN key % 3 = 0 THEN expected_ref ELSE 'canon:1:1' END AS ref, key % 6 <> 0 AS has_source, n / 1000.0::DOUBLE AS seconds FROM ts, range(3) t(r)), "
    "jd AS (SELECT ts.*, run, system, state, ref, has_source, seconds, state = expected_state AS correct, state IN ('supported', 'supported_with_note') AS up, category = 'no_source' AS ab FROM ts JOIN pd USING (id)), "
    "jj AS (SELECT *, up AND (NOT has_source OR ab OR (expected_ref LIKE 'canon:%' AND ref <> expected_ref)) AS fabricated, up AND expected_state NOT IN ('supported', 'supported_with_note') AS endorsed FROM jd)"
)


def labelled(spark, sf):
    k, g = F.col("key"), F.col("grade_class")
    exp = F.when(g == "accepted", "supported").when(g == "weak", "needs_review").when(g == "fabricated", "contradicted").otherwise("not_found")
    ref = F.when(k % 4 == 0, F.concat_ws(":", F.lit("canon"), k % 5 + 1, k % 8 + 1)).otherwise(F.concat(F.lit("graded:"), k))
    return graded(spark, sf).select(k.cast("string").alias("id"), F.col("text").alias("input_text"), exp.alias("expected_state"), ref.alias("expected_ref"), F.when(g == "mixed", "no_source").otherwise(F.col("lang")).alias("category"), k)


def predicted(spark, sf):
    n = F.length("input_text")
    r = labelled(spark, sf).withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    i = (n + F.col("run")) % 5
    state = F.when(i == 0, "not_found").when(i == 1, "needs_review").when(i == 2, "contradicted").when(i == 3, "supported").otherwise("supported_with_note")
    return r.select("id", "run", F.lit("rule").alias("system"), state.alias("state"), F.when(F.col("key") % 3 == 0, F.col("expected_ref")).otherwise("canon:1:1").alias("ref"), (F.col("key") % 6 != 0).alias("has_source"), (n / 1000.0).alias("seconds"), F.lit("").alias("detail"))


def judged(spark, sf):
    return EV.judge(labelled(spark, sf).drop("key", "input_text"), predicted(spark, sf))


@R("joi_26_rows_and_predictions", f"WITH {TEST} SELECT id, run, state, expected_state, correct, fabricated, endorsed FROM jj")
def _(spark, sf):
    return judged(spark, sf).select("id", "run", "state", "expected_state", "correct", "fabricated", "endorsed")


@R(
    "agg_8_per_state",
    f"WITH {TEST}, s AS (SELECT unnest([{','.join(repr(x) for x in V.STATES)}]) AS st), c AS (SELECT system, run, st AS state, count(*) FILTER (jj.state = st) AS p, count(*) FILTER (expected_state = st) AS e, count(*) FILTER (jj.state = st AND correct) AS tp FROM jj, s GROUP BY ALL) SELECT system, run, state, CASE WHEN p > 0 THEN round(tp / p, 4) END AS precision, CASE WHEN e > 0 THEN round(tp / e, 4) END AS recall, e AS support FROM c WHERE p + e > 0",
)
def _(spark, sf):
    return EV.per_state(judged(spark, sf))


@R("agg_9_per_category", f"WITH {TEST} SELECT system, run, category, count(*) AS n, count(*) FILTER (correct) AS correct, round(avg(CAST(correct AS INT)), 3) AS accuracy FROM jj GROUP BY ALL")
def _(spark, sf):
    return EV.per_category(judged(spark, sf))


@R(
    "agg_10_rates",
    f"WITH {TEST} SELECT system, run, count(*) AS n, round(avg(CAST(correct AS INT)), 4) AS accuracy, round(avg(CAST(fabricated AS INT)), 4) AS fabricated_rate, coalesce(string_agg(id, ',' ORDER BY id) FILTER (fabricated), '') AS fabricated_ids, round(avg(CAST(endorsed AS INT)), 4) AS endorsed_rate, coalesce(string_agg(id, ',' ORDER BY id) FILTER (endorsed), '') AS endorsed_ids, "
    "round(count(*) FILTER (ab AND state = 'not_found' AND NOT has_source) / count(*) FILTER (ab), 4) AS abstention_rate, 0 AS no_output, round(avg(seconds), 3) AS seconds_per_claim FROM jj GROUP BY system, run",
)
def _(spark, sf):
    return EV.accuracy(judged(spark, sf))


@R("agg_11_over_runs", f"WITH {TEST}, a AS (SELECT system, run, round(avg(CAST(correct AS INT)), 4) AS v FROM jj GROUP BY ALL) SELECT system, 'accuracy' AS metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM a GROUP BY system")
def _(spark, sf):
    return EV.over_runs(EV.accuracy(judged(spark, sf)), ["accuracy"])


@R(
    "agg_12_model_comparison",
    f"""WITH {CALLS}, i AS (SELECT model AS label, count(*) AS n, avg(CAST(k > 20 AS INT)) AS sa, avg(CAST(k > 30 AS INT)) AS ta, avg(CASE WHEN k > 5 THEN CAST(k > 40 AS INT) END) AS la, count(*) FILTER (k < 3) AS lo, avg(k / 10.0::DOUBLE) AS spi FROM calls GROUP BY model),
    c AS (SELECT model AS label, count(*) AS calls, count(*) FILTER (NOT ok AND k % 3 = 0) AS invalid, count(*) FILTER (NOT ok AND k % 3 = 1) AS refused, count(*) FILTER (NOT ok AND k % 3 = 2) AS truncated, sum(cost_usd) AS ct, avg(CAST(k % 2 = 0 AS INT)) AS eq FROM calls GROUP BY model)
    SELECT label, round(sa, 6) AS state_accuracy, round(la, 6) AS level_accuracy, round(eq, 6) AS exact_quote_rate, invalid, refused, truncated, round(ct / n, 6) AS cost_per_item, CAST(row_number() OVER (ORDER BY CASE WHEN refused > 0 OR lo > 0 THEN 1 ELSE 0 END, sa DESC, coalesce(la, 0) DESC, ct / n, label) AS INT) AS place FROM i JOIN c USING (label)""",
)
def _(spark, sf):
    c = calls(spark, sf).withColumn("label", F.col("model"))
    k = F.col("prompt_tokens")
    items = c.select("label", (k > 20).alias("state_ok"), (k > 30).alias("type_ok"), F.when(k > 5, k > 40).alias("level_ok"), F.when(k < 3, "lexical_only").otherwise("full").alias("mode"), (k / 10.0).alias("seconds"))
    err = F.when(~F.col("ok"), F.element_at(F.array(F.lit("validation failed"), F.lit("HTTP 402"), F.lit("truncated")), k % 3 + 1))
    out = EV.compare_models(items, c.select("label", "ok", err.alias("error"), F.col("cost_usd").alias("cost")), c.select("label", (k % 2 == 0).alias("exact")))
    r = lambda x: F.round(x, 6).alias(x)
    return out.select("label", r("state_accuracy"), r("level_accuracy"), r("exact_quote_rate"), "invalid", "refused", "truncated", r("cost_per_item"), "place")


_TR = f"b AS (SELECT item_id, {tokens_sql('text')} AS w FROM benchmark), x AS (SELECT item_id, w, w[3] AS o, list_transform(w, lambda t, i: CASE WHEN i = 3 THEN 'inserted' ELSE t END) AS alt FROM b), m AS (SELECT item_id, CASE item_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS model, o, array_to_string(alt, ' ') AS altered, CASE item_id % 3 WHEN 0 THEN array_to_string(alt, ' ') WHEN 1 THEN array_to_string(w, ' ') ELSE '' END AS got FROM x)"


def transcriptions(spark, sf):
    w = G.once(table(spark, sf, "benchmark"), "w", X.tokens(F.col("text"), SCRIPT))
    alt = F.array_join(F.transform("w", lambda t, i: F.when(i == 2, "inserted").otherwise(t)), " ")
    k = F.col("item_id")
    r = w.select("item_id", F.when(k % 2 == 0, "a").otherwise("b").alias("model"), alt.alias("altered"), F.col("w")[2].alias("original_word"), F.lit("inserted").alias("inserted_word"), F.when(k % 3 == 0, alt).when(k % 3 == 1, F.array_join("w", " ")).otherwise("").alias("got"))
    return EV.classify_transcriptions(r, lambda c: X.normalize(c, SCRIPT))


@R("gen_10_transcription_classes", f"WITH {_TR} SELECT item_id, contains(got, altered) AS exact, list_contains(string_split(got, ' '), o) AND NOT list_contains(string_split(got, ' '), 'inserted') AS corrected FROM m")
def _(spark, sf):
    return transcriptions(spark, sf).select("item_id", "exact", "corrected")


@R("agg_13_transcription_comparison", f"WITH {_TR} SELECT model, count(*) AS n, count(*) FILTER (contains(got, altered)) AS exact, count(*) FILTER (list_contains(string_split(got, ' '), o) AND NOT list_contains(string_split(got, ' '), 'inserted')) AS corrected, count(*) FILTER (got = '') AS failed_calls, round(avg(CASE WHEN got <> '' THEN levenshtein(altered, got)::DOUBLE / greatest(1, length(altered)) END), 6) AS mean_cer FROM m GROUP BY model")
def _(spark, sf):
    t = transcriptions(spark, sf).withColumn("failed", F.col("got") == "").withColumn("cer", F.levenshtein("altered", "got") / F.greatest(F.lit(1), F.length("altered"))).withColumn("cost", F.lit(0.0))
    return EV.compare_transcriptions(t).select("model", "n", "exact", "corrected", "failed_calls", F.round("mean_cer", 6).alias("mean_cer"))


@R("agg_14_sources_used", f"WITH {VERDICTS} SELECT doc_id, source AS name, CAST(arg_min(claim_id, start * 10 + idx) AS VARCHAR) AS url FROM verdicts GROUP BY ALL")
def _(spark, sf):
    v = verdict_rows(spark, sf).withColumn("sources", F.array(F.struct(F.col("source").alias("name"), F.col("claim_id").cast("string").alias("url")))).withColumn("start", F.col("start") * 10 + F.col("index"))
    return RP.sources_used(v)


@R("agg_14_distinct_gradings", f"WITH {VERDICTS}, f AS (SELECT doc_id, state, min(start * 10 + idx) AS n FROM verdicts GROUP BY ALL) SELECT doc_id AS claim_id, string_agg(state, ',' ORDER BY n) AS gradings FROM f GROUP BY doc_id")
def _(spark, sf):
    g = verdict_rows(spark, sf).select(F.col("doc_id").alias("claim_id"), (F.col("start") * 10 + F.col("index")).alias("n"), F.concat(F.lit(" "), "state", F.lit("  ")).alias("text"))
    return RP.distinct_grade_rows(g).select("claim_id", F.array_join("gradings", ",").alias("gradings"))


@R("agg_15_traces", f"WITH {VERDICTS} SELECT count(*) FILTER (lang = 'en') AS canon_hits, count(*) FILTER (lang = 'fr') AS record_hits, count(*) FILTER (lang NOT IN ('en', 'fr')) AS markers, (SELECT count(*) FROM benchmark) AS canon_size, (SELECT count(*) FROM documents) AS records_size FROM verdicts")
def _(spark, sf):
    v = verdict_rows(spark, sf)
    c = v.select(F.when(F.col("lang") == "en", "ayah").otherwise("hadith").alias("type"), F.when(F.col("lang").isin("en", "fr"), "x_scan").otherwise("marker").alias("origin"))
    return RP.scan_trace({"canon": table(spark, sf, "benchmark"), "records": table(spark, sf, "documents")}, c)


@R("agg_16_rows_per_category", f"WITH {TEST} SELECT category, count(*) AS n FROM ts GROUP BY category")
def _(spark, sf):
    return EV.rows_per_category(labelled(spark, sf))


@R("win_8_stratified_pick", f"WITH {TEST} SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM ts) WHERE rn <= CASE category WHEN 'en' THEN 5 WHEN 'fr' THEN 3 WHEN 'no_source' THEN 2 ELSE 0 END")
def _(spark, sf):
    plan = spark.createDataFrame([("en", 5), ("fr", 3), ("no_source", 2)], "category string, want int")
    return EV.stratified(labelled(spark, sf), plan).select("id", "category")


@R(
    "win_9_round_robin",
    f"WITH {TEST}, f AS (SELECT ts.id, category, row_number() OVER (PARTITION BY category ORDER BY ts.id) AS turn, min(ts.id) OVER (PARTITION BY category) AS f FROM ts WHERE n BETWEEN 30 AND 900) SELECT id, category, CAST(turn AS INT) AS turn FROM f ORDER BY turn, f LIMIT 15",
)
def _(spark, sf):
    return EV.round_robin(labelled(spark, sf), 15, 30, 900).select("id", "category", "turn")


@R(
    "win_10_attention_order",
    f"WITH {VERDICTS} SELECT claim_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['contradicted', 'not_found', 'needs_review', 'supported_with_note', 'supported'], state), start, idx) AS INT) AS attention_rank, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, idx) AS INT) AS text_rank FROM verdicts",
)
def _(spark, sf):
    return RP.by_attention(verdict_rows(spark, sf)).select("claim_id", "attention_rank", "text_rank")


@R("win_11_grades_cap", f"WITH {VERDICTS} SELECT claim_id FROM (SELECT claim_id, row_number() OVER (PARTITION BY doc_id ORDER BY start * 10 + idx) AS rn FROM verdicts) WHERE rn <= 2")
def _(spark, sf):
    g = verdict_rows(spark, sf).select(F.col("doc_id").alias("claim_id"), (F.col("start") * 10 + F.col("index")).alias("n"), F.col("claim_id").alias("c"))
    return RP.cap_grades(g, 2).select(F.col("c").alias("claim_id"))


@R("joi_25_same_reference", f"WITH {TEST}, {CANON}, u AS (SELECT 'canon:' || group_no || ':' || unit_no AS r, {norm_sql('text')} AS t FROM cu), p AS (SELECT id, expected_ref, ref FROM jj WHERE run = 0) SELECT id, coalesce(ref = expected_ref OR (expected_ref LIKE 'canon:%' AND (contains(g.t, e.t) OR contains(e.t, g.t))) OR (expected_ref LIKE 'graded:%' AND ref LIKE 'graded:%'), FALSE) AS same_ref FROM p LEFT JOIN u e ON e.r = expected_ref LEFT JOIN u g ON g.r = ref")
def _(spark, sf):
    return L.same_reference(predicted(spark, sf).filter("run = 0"), labelled(spark, sf), canon_units(spark, sf), SCRIPT)


@R(
    "joi_27_keyword_baseline",
    f"""WITH {RETRIEVAL}, {CANON}, {IDF}, ks AS (SELECT claim_id, list_distinct(list_filter({tokens_sql('quote')}, lambda x: length(x) >= 2 AND NOT list_contains({STOP_SQL}, x))) AS k FROM qs), kw AS (SELECT claim_id, unnest(k) AS word FROM ks),
    uu AS (SELECT DISTINCT 'canon:' || group_no || ':' || unit_no AS ref, word FROM ct), us AS (SELECT claim_id, ref, sum(idf) AS s FROM kw JOIN idf USING (word) JOIN uu USING (word) GROUP BY ALL),
    u5 AS (SELECT claim_id, ref, row_number() OVER (PARTITION BY claim_id ORDER BY round(s, 9) DESC, ref) AS rn FROM us QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY round(s, 9) DESC, ref) <= 5),
    cc AS (SELECT claim_id, ref, rn, len(list_intersect(k, {tokens_sql('text')})) / len(k) AS c FROM u5 JOIN ks USING (claim_id) JOIN cu ON 'canon:' || group_no || ':' || unit_no = ref
      UNION ALL SELECT claim_id, 'record:' || key, lexical_rank + 11, len(list_intersect(k, {tokens_sql('text')})) / len(k) FROM rk JOIN ks USING (claim_id) JOIN graded USING (key) WHERE lexical_rank < 5),
    b AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY round(c, 9) DESC, rn) = 1)
    SELECT claim_id AS id, CASE WHEN c >= 0.6 THEN 'supported' ELSE 'not_found' END AS state, CASE WHEN c >= 0.6 THEN ref END AS ref, round(c, 6) AS containment FROM b""",
)
def _(spark, sf):
    units = canon_units(spark, sf).select(F.concat_ws(":", F.lit("canon"), "group_no", "unit_no").alias("ref"), "text_match")
    rows = passage_claims(spark, sf).select(F.col("claim_id").alias("id"), F.col("quote").alias("input_text"))
    return RT.keyword_baseline(rows, units, graded(spark, sf), SCRIPT, LATIN_STOP).withColumn("containment", F.round("containment", 6))


# --------------------------------------------------------------------------- generated rows


def _h(*parts):
    return "CAST(('0x' || substr(md5('1448:' || " + " || ':' || ".join(parts) + "), 1, 8)) AS BIGINT)"


def unit_words(spark, sf):
    return G.once(table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), "text"), "words", X.words(F.col("text"), SCRIPT))


_UW = f"uw AS (SELECT item_id AS key, text, {words_sql('text')} AS words FROM benchmark)"
_OTHER = f"{_UW}, ot AS (SELECT *, coalesce(lead(words) OVER z, first_value(words) OVER z) AS other FROM uw WINDOW z AS (PARTITION BY key // 1000 ORDER BY key))"
_SIM = "1.0::DOUBLE - CAST(levenshtein(array_to_string(altered, ' '), array_to_string(words, ' ')) AS DOUBLE) / greatest(length(array_to_string(altered, ' ')), length(array_to_string(words, ' ')))"


@R("gen_1_quoted_rows", f"SELECT item_id AS key, {_h('item_id')} % 2 = 0 AS marked, CASE WHEN {_h('item_id')} % 2 = 0 THEN 'As said: ' ELSE '' END || '«' || text || '»' AS input_text FROM (SELECT item_id, text FROM benchmark ORDER BY {_h('item_id')}, item_id LIMIT 20)")
def _(spark, sf):
    u = GN.sample(table(spark, sf, "benchmark").withColumnRenamed("item_id", "key"), 20)
    return GN.quoted_rows(u, "As said: ", "«", "»")


@R(
    "gen_2_replace_one",
    f"WITH {_OTHER}, d AS (SELECT *, list_filter(other, lambda x: length(x) >= 4 AND NOT list_contains(words, x))[1] AS donor, CAST({_h('key')} % (len(words) - 4) + 2 AS INT) AS pos FROM ot WHERE len(words) >= 5), a AS (SELECT key, pos, donor, words, list_transform(words, lambda x, i: CASE WHEN i = pos + 1 THEN donor ELSE x END) AS altered FROM d WHERE donor IS NOT NULL) SELECT key, pos, donor, array_to_string(altered, ' ') AS altered, round({_SIM}, 6) AS similarity FROM a WHERE {_SIM} >= 0.86",
)
def _(spark, sf):
    return GN.replace_one(unit_words(spark, sf)).select("key", "pos", "donor", F.array_join("altered", " ").alias("altered"), F.round("similarity", 6).alias("similarity"))


@R(
    "gen_3_replace_quarter",
    f"""WITH {_OTHER}, dd AS (SELECT key, words, unnest(other) AS x, generate_subscripts(other, 1) AS k FROM ot WHERE len(words) >= 5), d1 AS (SELECT key, x, min(k) AS k FROM dd WHERE length(x) >= 4 AND NOT list_contains(words, x) GROUP BY ALL), d2 AS (SELECT key, list(x ORDER BY k) AS donors FROM d1 GROUP BY key),
    ps AS (SELECT key, i, row_number() OVER (PARTITION BY key ORDER BY {_h('key', 'i')}, i) AS r, greatest(3, len(words) // 4) AS k FROM (SELECT key, words, unnest(range(1, len(words) - 1)) AS i FROM ot WHERE len(words) >= 5)),
    w AS (SELECT key, unnest(words) AS x, generate_subscripts(words, 1) - 1 AS i FROM ot WHERE len(words) >= 5), j AS (SELECT w.key, w.i, CASE WHEN r <= k THEN donors[CAST((r - 1) % len(donors) + 1 AS BIGINT)] ELSE x END AS x FROM w JOIN d2 USING (key) LEFT JOIN ps ON ps.key = w.key AND ps.i = w.i),
    a AS (SELECT j.key, list(x ORDER BY i) AS altered, any_value(words) AS words FROM j JOIN ot USING (key) GROUP BY j.key) SELECT key, array_to_string(altered, ' ') AS altered, round({_SIM}, 6) AS similarity FROM a WHERE {_SIM} BETWEEN 0.62 AND 0.83""",
)
def _(spark, sf):
    return GN.replace_quarter(unit_words(spark, sf)).select("key", F.array_join("altered", " ").alias("altered"), F.round("similarity", 6).alias("similarity"))


@R("gen_4_drop_sevenths", f"WITH {_UW}, a AS (SELECT key, words, list_filter(words, lambda x, i: i % 7 <> 0) AS altered FROM uw) SELECT key, array_to_string(altered, ' ') AS altered, round({_SIM}, 6) AS similarity FROM a WHERE {_SIM} BETWEEN 0.82 AND 0.93")
def _(spark, sf):
    return GN.drop_sevenths(unit_words(spark, sf)).select("key", F.array_join("altered", " ").alias("altered"), F.round("similarity", 6).alias("similarity"))


_MIX = f"{_UW}, g0 AS (SELECT key, words, row_number() OVER (PARTITION BY key // 1000 ORDER BY {_h('key')}, key) - 1 AS rn, key // 1000 AS rng FROM uw), g1 AS (SELECT *, rn // 4 AS grp FROM g0), g2 AS (SELECT rng, grp, count(*) AS c, string_agg(key, ',' ORDER BY rn) AS keys FROM g1 GROUP BY ALL), gw AS (SELECT rng, grp, key, unnest(words) AS t, generate_subscripts(words, 1) - 1 AS i FROM g1), gr AS (SELECT rng, grp, t, row_number() OVER (PARTITION BY rng, grp ORDER BY {_h('key', 'i')}, key, i) AS r FROM gw)"


@R("gen_5_mixed_records", f"WITH {_MIX} SELECT keys, string_agg(t, ' ' ORDER BY r) AS text FROM gr JOIN g2 USING (rng, grp) WHERE c = 4 AND r <= 14 GROUP BY keys")
def _(spark, sf):
    return GN.mix_four(unit_words(spark, sf)).select(F.array_join("keys", ",").alias("keys"), "text")


@R("gen_6_misattributed", "SELECT item_id AS key, 'Someone said: «' || text || '»' AS input_text, 'attributed_quote' AS claim_type, 'contradicted' AS expected_state FROM benchmark")
def _(spark, sf):
    return GN.misattributed(table(spark, sf, "benchmark").withColumnRenamed("item_id", "key"), "Someone said")


@R("gen_6_alternate_language", "SELECT item_id AS key, 'The Prophet (peace be upon him) said: \"' || text || '\"' AS input_text FROM benchmark")
def _(spark, sf):
    g = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.struct(F.concat(F.lit("He said: "), "text").alias("hadeeth")).alias("en"))
    return GN.alternate_rows(g)


_BEST = (
    f"rec AS (SELECT item_id AS key, {words_sql('text')} AS w FROM benchmark), {STATS}, qs AS (SELECT key AS claim_id, w AS q FROM lf JOIN gw USING (key)), {TERMS}, {BM}, "
    f"pairs AS (SELECT claim_id, key, q, w AS s FROM rk JOIN qs USING (claim_id) JOIN rec USING (key) WHERE lexical_rank < 40), {span_sql('pairs', 'claim_id,key')}"
)


@R(
    "gen_7_rejected_everywhere",
    f"""WITH {GRADED}, gw AS (SELECT key, grade_class, {words_sql('text')} AS w FROM graded), ws AS (SELECT key, grade_class, len(w) AS words, list_distinct(w) AS d FROM gw WHERE len(w) > 0),
    tk AS (SELECT key, grade_class, words, len(d) AS n, unnest(d) AS t FROM ws), sh AS (SELECT a.key, b.key AS other, any_value(a.grade_class) AS own, any_value(b.grade_class) AS cl, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
      FROM tk a JOIN tk b USING (t) WHERE a.grade_class IN ('weak', 'fabricated') AND a.words >= 8 GROUP BY a.key, b.key), nr AS (SELECT * FROM sh WHERE 9 * c >= 4 * (n + m)),
    lf AS (SELECT key, any_value(own) AS grade_class, count(*) AS copies FROM nr GROUP BY key HAVING bool_and(cl IN ('weak', 'fabricated', 'unknown')) AND NOT (any_value(own) = 'weak' AND bool_or(cl = 'fabricated'))),
    {_BEST}, bs AS (SELECT claim_id AS key, max(round(score, 4)) AS best FROM sp GROUP BY claim_id)
    SELECT key, grade_class, copies, coalesce(best, 0) AS best FROM lf LEFT JOIN bs USING (key) WHERE coalesce(best, 0) < 0.6""",
)
def _(spark, sf):
    g = graded(spark, sf).select("key", "text", "grade_class")
    corpus = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), "text")
    return GN.rejected_everywhere(g, corpus, SCRIPT, longest=2**31 - 1)


@R("gen_8_composite_documents", "WITH l AS (SELECT item_id + 1 AS n, item_id AS id, text FROM benchmark), s AS (SELECT page_id + 1 AS n, page_id AS id, url FROM pages), c AS (SELECT count(*) AS k FROM s) SELECT l.n AS doc_id, 'Opening.' || chr(10) || l.text || CASE WHEN s.id IS NULL THEN '' ELSE chr(10) || 'Then:' || chr(10) || s.url END || chr(10) || 'Closing.' AS text, CASE WHEN s.id IS NULL THEN 1 ELSE 2 END AS rows FROM l JOIN c ON TRUE LEFT JOIN s ON l.n % 2 = 0 AND s.n = (l.n // 2 - 1) % k + 1")
def _(spark, sf):
    lead = table(spark, sf, "benchmark").select((F.col("item_id") + 1).alias("n"), F.col("item_id").cast("string").alias("id"), F.col("text").alias("input_text"), F.lit("supported").alias("expected_state"))
    sup = table(spark, sf, "pages").select((F.col("page_id") + 1).alias("n"), F.col("page_id").cast("string").alias("id"), F.col("url").alias("input_text"), F.lit("supported").alias("expected_state"))
    return GN.compose_documents(lead, sup, "Opening.", "Then:", "Closing.").select("doc_id", "text", F.size("expected").alias("rows"))


@R(
    "gen_9_chance_level",
    f"""WITH {CANON}, {_MIX.replace('uw AS', 'ux AS').replace('FROM uw', 'FROM ux')}, mx AS (SELECT keys, list(t ORDER BY r) AS w FROM gr JOIN g2 USING (rng, grp) WHERE c = 4 AND r <= 18 GROUP BY keys), qc AS (SELECT keys || '#' || n AS claim_id, w[1:n] AS q FROM mx, (SELECT unnest([6, 10, 18]) AS n)), {SEEDS}, {_FUZZY}, {span_sql('wp', 'claim_id,seed_rank')},
    b AS (SELECT claim_id, max(score) AS s FROM sp GROUP BY claim_id) SELECT CAST(len(q) AS INT) AS words, count(*) AS n, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.99), 6) AS p99, round(max(s), 6) AS max FROM b JOIN qc USING (claim_id) GROUP BY len(q)""",
)
def _(spark, sf):
    c = canon(spark, sf)
    m = GN.mix_four(unit_words(spark, sf), 18).withColumn("n", F.explode(F.array(F.lit(6), F.lit(10), F.lit(18))))
    q = m.select(F.concat_ws("#", F.array_join("keys", ","), "n").alias("claim_id"), F.slice("words", F.lit(1), F.col("n")).alias("q"))
    f = M.fuzzy_spans(q, c.tokens, c.positions, c.small).groupBy("claim_id").agg(F.max("score").alias("similarity"))
    r = GN.chance_level(f.select(F.split_part("claim_id", F.lit("#"), F.lit(2)).cast("int").alias("words"), "similarity"))
    return r.select("words", "n", *[F.round(x, 6).alias(x) for x in ("median", "p99", "max")])


# --------------------------------------------------------------------------- streams, batch forms


@R(
    "str_2_request_limit",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f(user_id, n, event_id, denied, acc) AS (
      SELECT user_id, n, event_id, FALSE, [s] FROM e WHERE n = 1 UNION ALL SELECT user_id, n, event_id, is_full, CASE WHEN is_full THEN live ELSE list_append(live, s) END FROM (SELECT e.*, list_filter(f.acc, lambda x: e.s - x <= 43200) AS live, len(list_filter(f.acc, lambda x: e.s - x <= 43200))   >= 2 AS is_full FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
    SELECT event_id, user_id, denied FROM f""",
)
def _(spark, sf):
    return ST.limit_requests(table(spark, sf, "events").select("event_id", "user_id", "ts"), 2, 43200.0).select("event_id", "user_id", "denied")


@R(
    "str_3_spend_guard",
    f"WITH {CALLS}, r AS (SELECT call_id, round(coalesce(sum(cost_usd) OVER (PARTITION BY day ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before FROM calls) SELECT call_id, round(spent_before, 4) AS spent_before, spent_before >= 500 AS guard_active FROM r",
)
def _(spark, sf):
    return RP.spend_guard(calls(spark, sf), 500.0).select("call_id", F.round("spent_before", 4).alias("spent_before"), "guard_active")


@R(
    "str_3_spend_guard_stream",
    f"""WITH {CALLS}, r AS (SELECT call_id, ts, round(coalesce(sum(cost_usd) OVER (PARTITION BY day ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before FROM calls)
    SELECT call_id, round(spent_before, 4) AS spent_before, spent_before >= 500 AS guard_active FROM r WHERE ts < (SELECT date_trunc('minute', max(ts) - INTERVAL 1 HOUR) FROM events)""",
)
def _(spark, sf):
    """The guard on the stream of calls: what the watermark has passed when the stream has been read."""
    schema = table(spark, sf, "events").schema
    arriving = call_rows(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = new_folder(spark, "guard")
    guarded = ST.spend_guard_stream(arriving, 500.0)
    sink = guarded.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
    ST.run_available(sink)
    rows = spark.read.schema(guarded.schema).parquet(f"{out}/rows")
    return rows.select("call_id", F.round("spent_before", 4).alias("spent_before"), "guard_active")


@R("str_4_reused_answers", """WITH RECURSIVE e AS (SELECT event_type || '-' || user_id AS k, epoch_us(ts) / 1e6 AS s, event_id, row_number() OVER (PARTITION BY event_type || '-' || user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT k, n, s AS last, event_id, TRUE AS counts FROM e WHERE n = 1
      UNION ALL SELECT e.k, e.n, CASE WHEN e.s - f.last > 432000 THEN e.s ELSE f.last END, e.event_id, e.s - f.last > 432000 FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS period, event_id AS v FROM f WHERE counts""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws("-", "event_type", "user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("v"))
    return ST.reuse_answers(e, 5).select("k", "period", "v")


@R("str_5_activity", "WITH e AS (SELECT DISTINCT user_id, ts, (epoch(TIMESTAMP '2024-01-28') - epoch_us(ts) / 1e6) / 86400 AS age FROM events) SELECT user_id, count(*) FILTER (age < 7) AS this_week, count(*) AS remembered FROM e WHERE age >= 0 AND age <= 35 GROUP BY user_id")
def _(spark, sf):
    return ST.activity(table(spark, sf, "events"), F.lit("2024-01-28 00:00:00").cast("timestamp"))


@R("str_5_activity_windows", "WITH e AS (SELECT user_id, date_trunc('day', ts) - INTERVAL 1 DAY * k AS from_ts FROM events, range(7) t(k)) SELECT user_id, strftime(from_ts, '%Y-%m-%d') AS from_day, count(*) AS n FROM e GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ST.activity_windows(e).select("user_id", F.date_format("from_ts", "yyyy-MM-dd").alias("from_day"), "n")


@R("str_6_progress", f"WITH {VERDICTS} SELECT doc_id, lang AS stage, count(*) FILTER (state <> 'needs_review') AS done, count(*) AS total FROM verdicts GROUP BY ALL")
def _(spark, sf):
    return ST.progress(verdict_rows(spark, sf).select("doc_id", F.col("lang").alias("stage"), (F.col("state") != "needs_review").alias("is_done")))


@R(
    "str_7_timed_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER z < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW z AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n, round(epoch_us(min(ts)) / 1e6, 3) AS from_s FROM s GROUP BY user_id, k",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ST.timed_sessions(e, "2 hours", "user_id").select("user_id", "n", F.round(F.col("from_ts").cast("double"), 3).alias("from_s"))
