"""Registered queries of this subpackage and their SQL equivalents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, divergence, fingerprints, language, licenses, mixing, negatives, ngram_jaccard, page_text, pseudonyms, quality, simhash, toxicity

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark, sf: str) -> DataFrame:
    out = ngram_jaccard.jaccard_components(table(spark, sf, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, w, len(w) AS n FROM (SELECT doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, len(w) AS n FROM (SELECT item_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT *, least(n, 10) AS k, unnest(range(1, greatest(n - 9, 1) + 1)) AS i FROM b WHERE n > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dg AS (SELECT rid, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT d.*, k, unnest(range(1, n - k + 2)) AS i FROM d, sizes WHERE n >= k)),
hit AS (SELECT rid, i, dg.k, item_id FROM dg JOIN win USING (k, g)),
words AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM (SELECT rid, i, unnest(range(0, k)) AS o FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""".replace("\\\\", "\\")


@query("op2_benchmark_decontamination", OP2_SQL)
def op2(spark, sf: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op10_language_id")
def op10(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(language.learned(docs)))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~language.learned(docs)).alias("held_out"), "lang_pred", "score")


@query("op9_document_fingerprints")
def op9(spark, sf: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf, "documents"))


@query("op3_toxicity")
def op3(spark, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    net = toxicity.fit(docs, labels.filter(toxicity.learned(labels)))
    out = toxicity.scored(docs, net)
    return out.select("doc_id", (~toxicity.learned(out)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_pfair_mixing")
def op4(spark, sf: str) -> DataFrame:
    """Square-root weights of the sources' sizes: small sources come more often than their share, the hot one less."""
    return mixing.mixed(table(spark, sf, "documents").select("doc_id", "source"))


@query("op5_pii_pseudonyms")
def op5(spark, sf: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf, "documents").select("doc_id", "text"), count="n_replaced")


@query("op7_html_main_text")
def op7(spark, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return page_text.extracted(pages, page_text.fit(pages))


@query("op6_quality_cotraining")
def op6(spark, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels.filter(quality.learned(labels)))
    out = quality.scored(docs, model)
    return out.select("doc_id", (~quality.learned(out)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_license_scan")
def op8(spark, sf: str) -> DataFrame:
    out = licenses.scanned(table(spark, sf, "documents"))
    best = F.array_max(F.transform("matches", lambda m: m["coverage"]))
    return out.select("doc_id", F.size("matches").alias("n_matches"), F.array_join(F.array_distinct(F.transform("matches", lambda m: m["license"])), ",").alias("licenses"), best.alias("coverage"), "matches")


@query("op12_simhash_near_duplicates")
def op12(spark, sf: str) -> DataFrame:
    out = simhash.components(table(spark, sf, "documents"))
    return simhash.with_hex(out).select("doc_id", "fingerprint", "component_id")


OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id, s.b) AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(negatives.prepared(table(spark, sf, "embeddings"), moved), F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source)::HUGEINT + v) AS p
      FROM g JOIN kept USING (lang) JOIN vs USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + v) AS q
      FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term) JOIN vs USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence_audit", OP11_SQL)
def op11(spark, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))
