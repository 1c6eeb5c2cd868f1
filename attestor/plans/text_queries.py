"""Projections and scalar functions over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import grams as G
from ..operators import rules as RU
from ..sources import segments as SEG
from .common import *  # noqa: F403
from .common import Registry

R = Registry()
LATIN_STOP = ["the", "and", "of", "la", "le", "de", "der", "die", "und", "el"]
STOP_SQL = "[" + ",".join(f"'{w}'" for w in LATIN_STOP) + "]"


@R("prj_1_normalize_arabic", f"SELECT doc_id, {norm_ar_sql(arabic_sql('text'))} AS norm FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", X.normalize_arabic(arabic_text(F.col("text"))).alias("norm"))


@R("prj_2_normalize_latin", f"SELECT doc_id, {norm_sql('text', False)} AS norm FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", X.normalize_latin(F.col("text")).alias("norm"))


MIXED = "translate(text, 'aeiou', 'أإىةؤ')"
LETTERS = rf"regexp_replace({MIXED}, '[^\pL]', '', 'g')"


@R(
    "prj_3_script_share",
    rf"SELECT doc_id, CASE WHEN length({LETTERS}) = 0 THEN 0.0 ELSE round(length(regexp_replace({LETTERS}, '[^\x{{0600}}-\x{{06FF}}]', '', 'g')) / length({LETTERS}), 6) END AS ratio FROM documents",
)
def _(spark, sf):
    mixed = F.translate("text", "aeiou", "أإىةؤ")
    return documents(spark, sf).select("doc_id", F.round(X.arabic_ratio(mixed), 6).alias("ratio"))


@R(
    "prj_4_words_with_offsets",
    f"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '{SQL_PIECE}+') AS ps, regexp_extract_all(text, '{SQL_BREAKS}+') AS gs,
      CASE WHEN regexp_matches(text, '^{SQL_BREAKS}') THEN 1 ELSE 0 END AS lead FROM documents),
    u AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k, gs, lead FROM p),
    o AS (SELECT doc_id, piece, k, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + coalesce(sum(CASE WHEN k - 1 + lead >= 1 THEN length(gs[k - 1 + lead]) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k), 0) AS s FROM u)
    SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(s + length(piece) AS BIGINT) AS "end", piece AS original, {word_norm_sql('piece')} AS norm FROM o WHERE {word_norm_sql('piece')} <> ''""",
)
def _(spark, sf):
    return X.words_with_offsets(documents(spark, sf), SCRIPT).drop("k")


@R(
    "prj_5_aligned_words",
    f"WITH t AS (SELECT doc_id, {norm_ar_sql(arabic_sql(rx('text', SQL_BREAKS + '+', ' ')))} AS n FROM documents) SELECT doc_id, n AS norm, CAST(len({split_sql('n')}) AS INT) AS n_words, CAST(len({split_sql('n')}) AS INT) AS n_orig FROM t",
)
def _(spark, sf):
    # a formula of respect is put after the text and must disappear again, with its originals
    spaced = F.regexp_replace("text", f"[{V.WORD_BREAKS}]+", " ")
    ar = F.regexp_replace(arabic_text(spaced), r"[^ء-يٱک ]", " ")
    d = documents(spark, sf).select("doc_id", F.concat(ar, F.lit(" صلى الله عليه وسلم")).alias("t"))
    a = G.once(d, "a", X.aligned_words(F.col("t"), "arabic", drop_honorifics=True))
    return a.select("doc_id", F.array_join("a.norm", " ").alias("norm"), F.size("a.norm").alias("n_words"), F.size("a.orig").alias("n_orig"))


@R("prj_6_content_words", f"SELECT doc_id, CAST(len(list_distinct(list_filter({tokens_sql('text')}, lambda x: length(x) >= 2 AND NOT list_contains({STOP_SQL}, x)))) AS INT) AS n FROM documents")
def _(spark, sf):
    w = G.once(documents(spark, sf), "w", X.tokens(F.col("text"), SCRIPT))
    return w.select("doc_id", X.content_words(F.col("w"), LATIN_STOP).alias("n"))


@R(
    "prj_7_query_terms",
    f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM t),
    f AS (SELECT doc_id, x, min(k) AS k, NOT list_contains({STOP_SQL}, x) AS strict FROM u WHERE length(x) >= 2 GROUP BY ALL),
    c AS (SELECT doc_id, count(*) FILTER (strict) AS ns FROM f GROUP BY doc_id),
    r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rn FROM f JOIN c USING (doc_id) WHERE strict OR ns < 2)
    SELECT t.doc_id, coalesce(string_agg(x, ' ' ORDER BY rn), '') AS terms FROM t LEFT JOIN r USING (doc_id) GROUP BY t.doc_id""",
)
def _(spark, sf):
    w = G.once(documents(spark, sf), "w", X.tokens(F.col("text"), SCRIPT))
    return w.select("doc_id", F.array_join(X.query_terms(F.col("w"), stop=LATIN_STOP), " ").alias("terms"))


_STRIP = "CASE " + " ".join(f"WHEN starts_with(x, '{p}') AND length(x) - {len(p)} >= 3 THEN substr(x, {len(p) + 1})" for p in V.STEM_PREFIXES) + " ELSE x END"
_STOPS = "[" + ",".join(f"'{w}'" for w in V.STEM_STOP) + "]"
_TSTOPS = "[" + ",".join(f"'{w}'" for w in V.TITLE_STOP) + "]"


def _stem_sql(stops: str, again: bool) -> str:
    n = norm_ar_sql(arabic_sql("text"))
    recheck = f"WHERE NOT list_contains({stops}, s)" if again else ""
    return (
        f"WITH t AS (SELECT doc_id, unnest({split_sql(n)}) AS x FROM documents), k AS (SELECT doc_id, {_STRIP} AS s FROM t WHERE length(x) >= 3 AND NOT list_contains({stops}, x)) "
        f"SELECT DISTINCT doc_id, substr(s, 1, 5) AS stem FROM k {recheck}"
    )


@R("prj_8_stems", _stem_sql(_STOPS, False))
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(X.stems(arabic_text(F.col("text")))).alias("stem"))


@R("prj_8_title_stems", _stem_sql(_TSTOPS, True))
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(X.stems(arabic_text(F.col("text")), titles=True)).alias("stem"))


@R(
    "prj_9_position_grams",
    f"""WITH {DOC_WORDS}, {DOC_TOKENS}, g AS (SELECT word AS a, lead(word, 1) OVER z AS b, lead(word, 2) OVER z AS c, lead(word, 3) OVER z AS d FROM dt WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
    x AS (SELECT 2 AS n, a || ' ' || b AS gram FROM g WHERE b IS NOT NULL UNION ALL SELECT 3, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL UNION ALL SELECT 4, a || ' ' || b || ' ' || c || ' ' || d FROM g WHERE d IS NOT NULL)
    SELECT CAST(n AS INT) AS n, gram, count(*) AS cnt FROM x GROUP BY n, gram HAVING count(*) >= 2""",
)
def _(spark, sf):
    g = G.position_grams(G.doc_words(documents(spark, sf), SCRIPT))
    return g.groupBy("n", "gram").agg(F.count("*").alias("cnt")).filter("cnt >= 2")


_MARKS = ["!", "?", "؟", ".", "،", ",", "~", "*", "_", "=", "-", "–", "—", "•", "·"]


def _noise_sql() -> str:
    line = "raw"
    for m in _MARKS:
        line = f"regexp_replace({line}, '[{'-' if m == '-' else m}]{{3,}}', '{m}', 'g')"
    line = rf"regexp_replace(regexp_replace({line}, '[ \t]{{2,}}', ' ', 'g'), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
    foot = r"^(forwarded|forwarded many times|share (this|it)( .*)?|pass it on|please share)$"
    return rf"""WITH t AS (SELECT doc_id, string_split(text || chr(10) || 'Share this' || chr(10) || '12:30 pm' || chr(10) || '*****', chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS k FROM t), c AS (SELECT doc_id, k, raw, {line} AS line FROM l),
    f AS (SELECT doc_id, k, raw, line, line <> '' AND (regexp_matches(line, '(?i)^[^\pL\pN_]*[0-9]{{1,2}}:[0-9]{{2}}\s*(?:ص|م|am|pm)?[^\pL\pN_]*$') OR regexp_matches(line, '^[^\pL\pN]+$') AND NOT contains(line, '[?]')
      OR FALSE) AS gone FROM c),
    a AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept, coalesce(string_agg(regexp_replace(raw, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '|' ORDER BY k) FILTER (gone), '') AS removed FROM f GROUP BY doc_id)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(kept, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '') AS kept, removed FROM a"""


@R("prj_10_strip_noise", _noise_sql())
def _(spark, sf):
    d = documents(spark, sf).select("doc_id", F.concat("text", F.lit("\nShare this\n12:30 pm\n*****")).alias("text"))
    return SEG.strip_noise(d).select("doc_id", "kept", F.array_join("removed", "|").alias("removed"))


@R(
    "prj_11_clean_display",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(text, 'zk', chr(8203) || chr(8206)), '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '[\s\pZ]+', ' ', 'g')) AS shown, "
    r"length(regexp_replace(translate(text, 'zk', chr(8203) || chr(8206)), '[\x{200B}\x{2060}\x{FEFF}\x{180E}]', ' ', 'g')) AS pasted_len FROM documents",
)
def _(spark, sf):
    t = F.translate("text", "zk", "​‎")
    return documents(spark, sf).select("doc_id", X.clean_display(t).alias("shown"), F.length(X.clean_pasted(t)).cast("bigint").alias("pasted_len"))


def rfind_sql(s: str, what: str) -> str:
    """0-based index of the last ``what`` in ``s`` (-1: none)."""
    back = what[::-1].replace("'", "''")
    return f"(CASE WHEN strpos(reverse({s}), '{back}') = 0 THEN -1 ELSE length({s}) - strpos(reverse({s}), '{back}') - {len(what) - 1} END)"


_W = "substr(text, off + 1, 2000)"
_CUT = f"greatest(length({_W}) - CASE WHEN strpos(reverse({_W}), chr(10)) = 0 THEN length({_W}) + 1 ELSE strpos(reverse({_W}), chr(10)) END, {rfind_sql(_W, '. ')}, {rfind_sql(_W, '؟')})"


@R(
    "prj_12_chunks",
    f"""WITH RECURSIVE c(doc_id, text, off, n, chunk_no) AS (
      SELECT doc_id, text, 0, CASE WHEN length(text) <= 2000 THEN length(text) ELSE (SELECT CASE WHEN k > 1000 THEN k + 1 ELSE 2000 END FROM (SELECT {_CUT.replace('off', '0')} AS k)) END, 0 FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, text, off2, CASE WHEN length(text) - off2 <= 2000 THEN length(text) - off2 ELSE (CASE WHEN k > 1000 THEN k + 1 ELSE 2000 END) END, chunk_no + 1
      FROM (SELECT doc_id, text, off2, chunk_no, {_CUT.replace('off', 'off2')} AS k FROM (SELECT doc_id, text, off + n AS off2, chunk_no FROM c WHERE off + n < length(text))))
    SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(off AS INT) AS "offset", substr(text, off + 1, n) AS text FROM c""",
)
def _(spark, sf):
    return SEG.chunks(documents(spark, sf), 2000)


@R(
    "prj_13_copy_text",
    f"WITH {GRADED} SELECT key, CASE WHEN grade_class = 'weak' THEN NULL ELSE trim(text, ' ') || chr(10) || attribution || chr(10) || 'Grading: ' || grade_class || ' — ' || lang || ' (' || attribution || ')' || chr(10) || 'doc:' || key END AS copy FROM "
    "(SELECT key, regexp_replace(trim(text, ' '), '\\n+', chr(10), 'g') AS text, attribution, grade_class, lang FROM graded)",
)
def _(spark, sf):
    g = graded(spark, sf)
    grades = F.array(F.struct(F.col("grade_class").alias("text"), F.col("lang").alias("scholar"), F.lit(None).cast("string").alias("book"), F.col("attribution").alias("source_name")))
    rule = F.when(F.col("grade_class") == "weak", "hadith.partial+level_c").otherwise("hadith.accepted_near")
    return g.select("key", RU.copy_text(F.lit("record"), rule, F.col("text"), F.col("attribution"), F.col("url"), grades, F.lit(False)).alias("copy"))


@R(
    "prj_15_narration_wording",
    r"SELECT item_id, trim(string_split(string_split(trim(' «' || text || '» tail', ' «.:' || chr(10)), '»')[1], chr(10))[1], ' «».:') AS wording FROM benchmark",
)
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    text = F.concat(F.lit("Reported by them: «"), "text", F.lit("» tail"))
    return b.select("item_id", X.narration_wording(text, F.lit("Reported by them:")).alias("wording"))


@R("aln_1_similarity", f"SELECT a.item_id AS a, b.item_id AS b, round(1.0 - CAST(levenshtein({fold('a.text')}, {fold('b.text')}) AS DOUBLE) / greatest(length(a.text), length(b.text)), 6) AS sim FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def _(spark, sf):
    t = table(spark, sf, "benchmark").withColumn("t", F.translate(F.lower("text"), V.LATIN_FROM, V.LATIN_TO))
    a, b = t.select(F.col("item_id").alias("a"), F.col("t").alias("ta")), t.select(F.col("item_id").alias("b"), (F.col("item_id") - 1).alias("a"), F.col("t").alias("tb"))
    return a.join(b, "a").select("a", "b", F.round(A.similarity(F.col("ta"), F.col("tb")), 6).alias("sim"))


@R("aln_9_error_rate", f"SELECT a.item_id AS item_id, round(CAST(levenshtein({norm_sql('a.text')}, {norm_sql('b.text')}) AS DOUBLE) / greatest(1, length({norm_sql('a.text')})), 6) AS cer FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def _(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", X.normalize(F.col("text"), SCRIPT).alias("t"))
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("got"))
    return t.join(nxt, "item_id").select("item_id", F.round(A.character_error_rate(F.col("t"), F.col("got")), 6).alias("cer"))
