"""Shared inputs of the registered queries and the SQL fragments that mirror them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grams as G

SCRIPT = "latin_ascii"  # accents folded, so that edit distances agree in every engine

# A letter-for-letter rendering of Latin text in Arabic script, to exercise the Arabic forms.
LATIN = "aeioudnthrslcpvmzbfgqxjkwy"
ARABIC = "أإىةؤءنتهرسلدبوميفصعقحجکٱش"


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf, *cols) -> DataFrame:
    return G.spread(table(spark, sf, "documents").select("doc_id", "text", *cols))


def canon_units(spark, sf) -> DataFrame:
    """The benchmark passages as a canon: eight units to a group."""
    b = table(spark, sf, "benchmark")
    return b.select(
        (F.floor(F.col("item_id") / 8) + 1).cast("int").alias("group_no"), (F.col("item_id") % 8 + 1).cast("int").alias("unit_no"),
        F.col("text").alias("text_display"), F.col("text").alias("text_match"),
    )


def graded(spark, sf) -> DataFrame:
    """Labelled documents as the graded corpus: (key, text, attribution, grade, grade_class, intro, url, lang)."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    cls = F.when(good & ~toxic, "accepted").when(~good & ~toxic, "weak").when(~good & toxic, "fabricated").otherwise("mixed")
    text = F.when(good & ~toxic, "صحيح").when(~good & ~toxic, "ضعيف").when(~good & toxic, "موضوع").otherwise("صحيح وقيل ضعيف")
    return G.spread(
        d.join(l, "doc_id").select(
            F.col("doc_id").alias("key"), "text", F.col("source").alias("attribution"), text.alias("grade"), cls.alias("grade_class"), F.lit("").alias("intro"),
            F.concat(F.lit("doc:"), "doc_id").alias("url"), "lang",
        )
    )


def passage_claims(spark, sf) -> DataFrame:
    """Every benchmark passage as a quotation to look up."""
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("claim_id"), F.col("text").alias("quote"))


def verdict_rows(spark, sf) -> DataFrame:
    """Labelled documents as decided rows, five to a document."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    state = F.when(good & ~toxic, "supported").when(~good & ~toxic, "needs_review").when(~good & toxic, "contradicted").otherwise("supported_with_note")
    j = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return j.select(
        F.floor(F.col("doc_id") / 5).alias("doc_id"), F.col("doc_id").alias("claim_id"), state.alias("state"), F.col("n_chars").cast("int").alias("start"),
        (F.col("doc_id") % 5).cast("int").alias("index"), (F.col("lang") == "de").alias("is_question"), "source", "lang",
    )


def calls(spark, sf) -> DataFrame:
    """Events as a call log."""
    return call_rows(table(spark, sf, "events"))


def call_rows(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("call_id"), F.col("ts"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("user_id") % 2 == 0, "extract").otherwise("judge").alias("task"),
        F.col("event_type").alias("model"), k.alias("prompt_tokens"), (k + 1).alias("completion_tokens"), F.lit(0).alias("cached_tokens"), F.col("value").alias("cost_usd"),
        (k * 10).alias("latency_ms"), (F.col("event_type") != "error").alias("ok"), (k > 90).alias("fallback"),
    )


# --------------------------------------------------------------------------- SQL fragments

SQL_BREAKS = r"[\s\pZ\x{060C}\x{061B}\x{061F}.,;:!?()\[\]{}\x{00AB}\x{00BB}\"''\x{201C}\x{201D}\x{2018}\x{2019}\x{FD3F}\x{FD3E}\-\x{2013}\x{2014}\x{0640}\x{2026}/\\|*]"
SQL_PIECE = SQL_BREAKS.replace("[", "[^", 1)
FOLD_FROM, FOLD_TO = "äçèéêíñóöüßàâáëïîôúùûœ", "aceeeinoousaaaeiiouuuo"


def rx(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def fold(text: str) -> str:
    return f"translate(lower({text}), '{FOLD_FROM}', '{FOLD_TO}')"


def norm_sql(text: str, ascii_fold: bool = True) -> str:
    base = fold(text) if ascii_fold else f"lower({text})"
    return f"trim({rx(rx(base, '[^' + chr(92) + 'pL' + chr(92) + 'pN_' + chr(92) + 's]', ' '), '[' + chr(92) + 's' + chr(92) + 'pZ]+', ' ')})"


def word_norm_sql(text: str, ascii_fold: bool = True) -> str:
    base = fold(text) if ascii_fold else f"lower({text})"
    return f"trim({rx(rx(rx(base, SQL_BREAKS + '+', ' '), '[^' + chr(92) + 'pL' + chr(92) + 'pN_ ]', ''), ' +', ' ')})"


def words_sql(text: str, ascii_fold: bool = True) -> str:
    n = word_norm_sql(text, ascii_fold)
    return f"(CASE WHEN {n} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({n}, ' ') END)"


def tokens_sql(text: str, ascii_fold: bool = True) -> str:
    n = norm_sql(text, ascii_fold)
    return f"(CASE WHEN {n} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({n}, ' ') END)"


def arabic_sql(text: str) -> str:
    """The letter-for-letter rendering."""
    return f"translate(lower({text}), '{LATIN}', '{ARABIC}')"


def arabic_text(col):
    return F.translate(F.lower(col), LATIN, ARABIC)


AR_FROM = "أإآٱٲٳؤئىیېةکۀەء"
AR_TO = "ااااااوييييهكهه"
AR_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}\x{0640}\x{08D3}-\x{08FF}]"
AR_CONTROLS = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"


def norm_ar_sql(text: str) -> str:
    marks = rx(rx(text, AR_CONTROLS, ""), AR_MARKS, "")
    return f"trim({rx(rx(f'translate({marks}, ' + repr(AR_FROM) + ', ' + repr(AR_TO) + ')', '[^' + chr(92) + 'x{0621}-' + chr(92) + 'x{064A}' + chr(92) + 's]', ' '), chr(92) + 's+', ' ')})"


def split_sql(norm: str) -> str:
    return f"(CASE WHEN {norm} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({norm}, ' ') END)"


DOC_WORDS = f"dw AS (SELECT doc_id, {words_sql('text')} AS w FROM documents)"
DOC_TOKENS = "dt AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM dw)"
CANON = (
    f"cu AS (SELECT CAST(item_id // 8 + 1 AS INT) AS group_no, CAST(item_id % 8 + 1 AS INT) AS unit_no, text, {words_sql('text')} AS w FROM benchmark), "
    "ct AS (SELECT group_no, unit_no, word, row_number() OVER (ORDER BY group_no, unit_no, k) - 1 AS pos FROM "
    "(SELECT group_no, unit_no, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM cu))"
)
IDF = (
    "cn AS (SELECT count(*) AS n FROM cu), "
    "idf AS (SELECT word, count(*) AS df, ln(1 + any_value(n) / count(*)) AS idf FROM (SELECT DISTINCT group_no, unit_no, word FROM ct), cn GROUP BY word)"
)
GRADED = (
    "graded AS (SELECT doc_id AS key, text, source AS attribution, lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN quality = 0 AND toxic = 0 THEN 'weak' "
    "WHEN quality = 0 AND toxic = 1 THEN 'fabricated' ELSE 'mixed' END AS grade_class FROM documents JOIN labels USING (doc_id))"
)
VERDICTS = (
    "verdicts AS (SELECT doc_id // 5 AS doc_id, doc_id AS claim_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'supported' WHEN quality = 0 AND toxic = 0 THEN 'needs_review' "
    "WHEN quality = 0 AND toxic = 1 THEN 'contradicted' ELSE 'supported_with_note' END AS state, CAST(n_chars AS INT) AS start, CAST(doc_id % 5 AS INT) AS idx, "
    "lang = 'de' AS is_question, source, lang FROM documents JOIN labels USING (doc_id))"
)
CALLS = (
    "calls AS (SELECT event_id AS call_id, ts, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 2 = 0 THEN 'extract' ELSE 'judge' END AS task, event_type AS model, "
    "CAST(json_extract(props, '$.k') AS INT) AS k, value AS cost_usd, event_type <> 'error' AS ok FROM events)"
)
QUOTES = f"qs AS (SELECT CAST(item_id AS VARCHAR) AS claim_id, text AS quote, {words_sql('text')} AS q FROM benchmark)"
