"""Claim extraction and the interval joins that merge claim sets."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import tags as T
from ..functions import text as X
from ..operators import claims as C
from ..operators import flows as FL
from ..operators import grams as G
from ..operators import lookup as L
from ..session import cut_lineage
from ..sources import segments as SEG
from .common import *  # noqa: F403
from .common import Registry
from .scan_queries import CANON_SCAN, _offset_sql, PIECES, canon

R = Registry()

# Markers of the Latin-script tables.
MARKERS = [
    C.Marker("said", r"(?i)\bthat\s+", "hadith", "A"),
    C.Marker("wrote", r"(?i)\b(?:las|des|und)\s+", "attributed_quote", "B", min_words=4),
    C.Marker("asks", r"(?i)\b(?:the|con)\s+[^.!\n]{0,40}", "fact", "A", "whole", attributed=False),
]


def _hits(pattern: str, name: str) -> str:
    return (
        f"{name}0 AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS hs, regexp_split_to_array(text, '{pattern}') AS bs FROM documents WHERE regexp_matches(text, '{pattern}')), "
        f"{name} AS (SELECT doc_id, text, hs[k] AS hit, list_sum(list_transform(bs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:k - 1], lambda x: length(x))), 0) AS ms FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS k FROM {name}0))"
    )


def _after(name: str) -> str:
    """Sentence after the marker, without the marks that may open it (an opener that closes delimits the quotation)."""
    skip = rf"length(regexp_extract(substr(text, CAST(ms + length(hit) + 1 AS BIGINT)), '^[ \t:،,]*'))"
    return (
        f"{name}1 AS (SELECT doc_id, text, ms + length(hit) + {skip} AS p FROM {name}), "
        f"{name}2 AS (SELECT doc_id, text, p, substr(text, CAST(p + 1 AS BIGINT), 1) AS o FROM {name}1), "
        "".rstrip()
        + f"{name}3 AS (SELECT *, CASE o WHEN '(' THEN ')' WHEN '\"' THEN '\"' WHEN chr(39) THEN chr(39) WHEN '[' THEN ']' WHEN '{{' THEN '}}' END AS c FROM {name}2), "
        f"{name}4 AS (SELECT *, CASE WHEN c IS NULL THEN 0 ELSE strpos(substr(text, CAST(p + 2 AS BIGINT)), c) END AS x FROM {name}3), "
        f"{name}5 AS (SELECT *, CASE WHEN c IS NOT NULL AND NOT x > 1 THEN p + 1 ELSE p END AS q FROM {name}4), "
        rf"{name}6 AS (SELECT doc_id, text, CASE WHEN x > 1 THEN p + 1 ELSE q END AS s, CASE WHEN x > 1 THEN p + x ELSE q + length(regexp_extract(substr(text, CAST(q + 1 AS BIGINT)), '^[^.؟!\n…]*')) END AS e, x > 1 AS closed FROM {name}5)"
    )


_TRIMQ = r"regexp_replace(raw, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"


def _quoted(name: str, src: str, type_: str, min_words: int) -> str:
    return (
        f"{name} AS (SELECT doc_id, '{type_}' AS type, {_TRIMQ} AS quote, CAST(s + length(regexp_extract(raw, '^[\\s\\pZ]*')) AS BIGINT) AS start, closed FROM (SELECT doc_id, s, closed, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS raw FROM {src} WHERE e > s) "
        rf"WHERE len(list_filter(regexp_split_to_array({_TRIMQ}, '\s+'), lambda w: w <> '')) >= {min_words})"
    )


MARKED = (
    f"{_hits(chr(40) + '?i)' + chr(92) + 'bthat' + chr(92) + 's+', 'ma')}, {_after('ma')}, {_quoted('mq', 'ma6', 'hadith', 2)}, "
    f"{_hits(chr(40) + '?i)' + chr(92) + 'b(?:las|des|und)' + chr(92) + 's+', 'mb')}, {_after('mb')}, {_quoted('mr', 'mb6', 'attributed_quote', 4)}, "
    f"{_hits(chr(40) + '?i)' + chr(92) + 'b(?:the|con)' + chr(92) + 's+[^.!' + chr(92) + 'n]{0,40}', 'mc')}, mc6 AS (SELECT doc_id, text, ms AS s, ms + length(hit) AS e, FALSE AS closed FROM mc), {_quoted('mw', 'mc6', 'fact', 2)}, "
    "mk AS (SELECT *, start + length(quote) AS e, type || '-' || doc_id || '-' || start AS cid FROM (SELECT * FROM mq UNION ALL SELECT * FROM mr UNION ALL SELECT * FROM mw))"
)


def marked(spark, sf, *types):
    m = C.extract_by_markers(documents(spark, sf), MARKERS).drop("rule").withColumn("claim_id", F.concat_ws("-", "type", "doc_id", "start"))
    return m.filter(F.col("type").isin(*types)) if types else m


@R("flt_1_marked_quotations", f'WITH {MARKED} SELECT doc_id, type, quote, start, closed FROM mk')
def _(spark, sf):
    return marked(spark, sf).select("doc_id", "type", "quote", F.col("start").cast("bigint").alias("start"), "closed")


@R("flt_2_folded_offsets", None)
def _(spark, sf):
    # each fifth letter is followed by a mark; the offsets of every folded word start must lead back to that word
    marked_text = F.regexp_replace("text", "(n)", "$1ً")
    d = documents(spark, sf).select("doc_id", marked_text.alias("t"))
    d = G.once(d, "m", X.matches_with_offsets(X.fold_for_markers(F.col("t")), r"(?i)\bthat\b"))
    at = d.select("doc_id", "t", F.explode("m").alias("m")).withColumn("o", X.original_offset(F.col("t"), F.col("m.start")))
    return at.select("doc_id", F.col("m.start").alias("folded"), F.col("o").alias("original"), F.substr("t", F.col("o") + 1, F.lit(2)).alias("found"))


@R("flt_3_sentence_tags", "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in T.LATIN_TAGS.items()) + " FROM documents")
def _(spark, sf):
    return T.tag_by_catalogue(documents(spark, sf), T.LATIN_TAGS).drop("text")


@R("flt_3_builtin_tags", None)
def _(spark, sf):
    return T.tag_texts(documents(spark, sf)).drop("text")


_LEAD = "substr(text, CAST(greatest(0, start - 90) + 1 AS BIGINT), CAST(start - greatest(0, start - 90) AS BIGINT))"


@R(
    "flt_4_marker_before",
    rf"""WITH {MARKED}, j AS (SELECT mk.cid, {_LEAD} AS lead FROM mk JOIN documents USING (doc_id)), h AS (SELECT cid, lead, regexp_extract_all(lead, '(?i)\bthat\s+') AS hs, regexp_split_to_array(lead, '(?i)\bthat\s+') AS bs FROM j)
    SELECT cid AS claim_id, coalesce(len(hs) > 0 AND length(list_last(bs)) <= 6, FALSE) AS before FROM h""",
)
def _(spark, sf):
    before = C.markers_before(marked(spark, sf).select("claim_id", "doc_id", "start"), documents(spark, sf), r"(?i)\bthat\s+", 6)
    return before.select("claim_id", "before")


@R("flt_6_literal_place", f"WITH {MARKED} SELECT cid AS claim_id, CASE WHEN strpos(text, quote) > 0 THEN strpos(text, quote) - 1 END AS start, 'exact' AS how FROM mk JOIN documents USING (doc_id) WHERE type = 'hadith'")
def _(spark, sf):
    p = marked(spark, sf, "hadith").select("claim_id", "doc_id", "quote")
    return C.locate_proposals(p, documents(spark, sf), SCRIPT).select("claim_id", F.col("start").cast("bigint").alias("start"), "how")


@R(
    "flt_7_formulas_and_short_runs",
    f"WITH {MARKED} SELECT cid AS claim_id FROM mk WHERE NOT (type = 'fact' AND {word_norm_sql('quote')} IN (SELECT {word_norm_sql('text')} FROM benchmark)) AND len({words_sql('quote')}) >= 6 AND len(list_distinct(list_filter({words_sql('quote')}, lambda x: length(x) >= 2))) >= 4",
)
def _(spark, sf):
    kept = C.drop_formulas(marked(spark, sf), table(spark, sf, "benchmark").select("text"), SCRIPT)
    return C.long_enough(kept, SCRIPT).select("claim_id")


SENT = (
    r"se0 AS (SELECT doc_id, text, regexp_extract_all(text, '[^.؟!\n؛]+') AS hs, regexp_split_to_array(text, '[^.؟!\n؛]+') AS bs FROM documents), "
    "se1 AS (SELECT doc_id, hs[k] AS hit, k - 1 AS n, list_sum(list_transform(bs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:k - 1], lambda x: length(x))), 0) AS ms FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS k FROM se0)), "
    r"se2 AS (SELECT doc_id, n, regexp_replace(hit, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS quote, ms + length(regexp_extract(hit, '^[\s\pZ]*')) AS start FROM se1), "
    rf"se AS (SELECT doc_id, n, quote, start, start + length(quote) AS e FROM se2 WHERE len(regexp_split_to_array(quote, '\s+')) >= 6 AND len(list_distinct(list_filter({tokens_sql('quote')}, lambda x: length(x) >= 2))) >= 4)"
)


@R("flt_9_free_sentences", f"WITH {MARKED}, {SENT} SELECT doc_id, CAST(n AS INT) AS n, quote, CAST(start AS BIGINT) AS start FROM se WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.doc_id = se.doc_id AND mk.start < se.e AND se.start < mk.e)")
def _(spark, sf):
    s = cut_lineage(C.sentences(documents(spark, sf), script=SCRIPT))
    return C.outside(s, marked(spark, sf)).select("doc_id", "n", "quote", F.col("start").cast("bigint").alias("start"))


@R(
    "flt_9_near_verbatim",
    rf"""WITH {MARKED}, {SENT}, fr AS (SELECT doc_id, n, quote, start, {word_norm_sql('quote')} AS t FROM se WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.doc_id = se.doc_id AND mk.start < se.e AND se.start < mk.e)),
    rs0 AS (SELECT doc_id AS key, unnest(regexp_extract_all(text, '[^.؟!\n؛]+')) AS s FROM documents JOIN labels USING (doc_id)), rs AS (SELECT DISTINCT key, {word_norm_sql('s')} AS t FROM rs0),
    a AS MATERIALIZED (SELECT DISTINCT t, length(t) AS m FROM fr), b AS MATERIALIZED (SELECT DISTINCT t, length(t) AS m FROM rs WHERE t <> ''),
    p AS MATERIALIZED (SELECT a.t AS qt, b.t AS rt, round(1.0 - levenshtein(a.t, b.t) / greatest(a.m, b.m), 9) AS similarity FROM a JOIN b ON 22 * a.m <= 25 * b.m AND 22 * b.m <= 25 * a.m WHERE 25 * levenshtein(a.t, b.t) <= 3 * greatest(a.m, b.m))
    SELECT doc_id, CAST(n AS INT) AS n, quote, CAST(start AS BIGINT) AS start, key, similarity FROM fr JOIN p ON fr.t = qt JOIN rs ON rs.t = rt AND key <> doc_id QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY similarity DESC, key) = 1""",
)
def _(spark, sf):
    free = C.outside(cut_lineage(C.sentences(documents(spark, sf), script=SCRIPT)), marked(spark, sf)).select("doc_id", "n", "quote", F.col("start").cast("bigint").alias("start"))
    return C.near_verbatim(free, graded(spark, sf).select("key", "text"), SCRIPT, own=True)


@R(
    "flt_10_own_statements",
    rf"WITH {VERDICTS}, v AS (SELECT claim_id, state, is_question, v.lang, regexp_matches(text, '(?i)\b(?:in|according to) (?:the|a) (?:hadith|sunnah|qur''?an)\b') AS attr FROM verdicts v JOIN documents d ON d.doc_id = v.claim_id) SELECT claim_id FROM v WHERE NOT (lang IN ('en', 'de') AND NOT is_question AND NOT attr) OR state = 'supported'",
)
def _(spark, sf):
    v = verdict_rows(spark, sf).join(documents(spark, sf).select(F.col("doc_id").alias("claim_id"), F.col("text").alias("quote")), "claim_id")
    v = v.withColumn("type", F.when(F.col("lang").isin("en", "de"), "fact").otherwise("hadith")).withColumn("level", F.lit("A"))
    return C.hide_own_statements(v).select("claim_id")


# --------------------------------------------------------------------------- interval joins on marker claims and sentences


def sentence_claims(spark, sf):
    s = C.sentences(documents(spark, sf), script=SCRIPT)
    return s.select(
        F.concat_ws("-", F.lit("s"), "doc_id", "n").alias("claim_id"), "doc_id", F.lit("hadith").alias("type"), "quote", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.lit(None).cast("string").alias("attributed_to"), F.lit(False).alias("explicit_attribution"), F.lit("A").alias("level"), F.lit("not_applicable").alias("certainty"),
        F.lit("proposed").alias("origin"), F.lit(False).alias("closed"), F.lit(False).alias("is_question"),
    )


SCL = f"sc AS (SELECT 's-' || doc_id || '-' || n AS cid, doc_id, start, e, quote FROM se)"
_OV = "greatest(0, least(a.e, b.e) - greatest(a.start, b.start))"
HM = "hm AS (SELECT * FROM mk WHERE type = 'hadith')"


@R(
    "joi_11_absorb_quotations",
    f"""WITH {MARKED}, {SENT}, {SCL}, {HM}, cc AS (SELECT DISTINCT a.doc_id, a.cid FROM hm a JOIN hm b ON a.doc_id = b.doc_id AND a.cid <> b.cid AND b.start <= a.start AND a.e <= b.e AND (a.start <> b.start OR a.e <> b.e)),
    pc AS (SELECT a.doc_id, a.cid AS p, b.cid AS c, a.start AS ps, a.e AS pe, a.quote AS pq, b.start AS cs, b.e AS ce, b.quote AS cq, {_OV} AS ov, cc.cid IS NOT NULL AS nested, regexp_matches(substr(d.text, CAST(b.e + 1 AS BIGINT), CAST(greatest(0, a.e - b.e) AS BIGINT)), '[«“﴿]') AS runs_on
      FROM sc a JOIN hm b ON a.doc_id = b.doc_id AND a.start < b.e AND b.start < a.e JOIN documents d ON d.doc_id = a.doc_id LEFT JOIN cc ON cc.cid = b.cid),
    gone AS (SELECT DISTINCT p FROM pc WHERE ps < cs AND cs < pe AND NOT nested AND (pe <= ce OR runs_on)), ins AS (SELECT *, count(*) OVER (PARTITION BY c) AS n FROM pc WHERE p NOT IN (SELECT p FROM gone) AND ov >= 0.9 * (pe - ps)),
    fit AS (SELECT * FROM ins WHERE n = 1 AND pe - ps >= 0.9 * (ce - cs)), ad AS (SELECT p, arg_max(cs, ce - cs) AS s, arg_max(ce, ce - cs) AS e FROM fit GROUP BY p)
    SELECT cid AS claim_id, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM sc WHERE cid NOT IN (SELECT p FROM gone) AND cid NOT IN (SELECT p FROM ins)
    UNION ALL SELECT p, CAST(s AS BIGINT), CAST(e AS BIGINT) FROM ad UNION ALL SELECT cid, CAST(start AS BIGINT), CAST(e AS BIGINT) FROM hm WHERE cid NOT IN (SELECT cid FROM cc) AND cid NOT IN (SELECT c FROM fit)""",
)
def _(spark, sf):
    a = C.absorb_closed(cut_lineage(sentence_claims(spark, sf)), cut_lineage(marked(spark, sf, "hadith")), documents(spark, sf), SCRIPT)
    return a.select("claim_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@R(
    "joi_12_merge_claims",
    f"""WITH RECURSIVE {MARKED}, {SENT}, {SCL}, x AS (SELECT cid, doc_id, start, e, row_number() OVER (PARTITION BY doc_id ORDER BY start, e, type, cid) AS n FROM mk WHERE type = 'hadith'),
    f(doc_id, n, cid, start, e, kept, acc) AS (SELECT doc_id, 0, NULL::VARCHAR, 0, 0, FALSE, coalesce(list({{'s': start, 'e': e}}) FILTER (start IS NOT NULL), list_filter([{{'s': 0, 'e': 0}}], lambda p: FALSE)) FROM (SELECT doc_id, start, e FROM sc UNION ALL SELECT DISTINCT doc_id, NULL, NULL FROM x) GROUP BY doc_id
      UNION ALL SELECT doc_id, n, cid, start, e, keep, CASE WHEN keep THEN list_append(acc, {{'s': start, 'e': e}}) ELSE acc END FROM (
        SELECT x.*, f.acc, NOT (cov > 0 AND cov >= 0.6 * (x.e - x.start)) AS keep FROM f JOIN x ON x.doc_id = f.doc_id AND x.n = f.n + 1, LATERAL (SELECT coalesce(list_sum(list_transform(f.acc, lambda p: greatest(0, least(p.e, x.e) - greatest(p.s, x.start)))), 0) AS cov)))
    SELECT cid AS claim_id FROM sc UNION ALL SELECT cid FROM f WHERE kept""",
)
def _(spark, sf):
    return C.merge_claims(sentence_claims(spark, sf), marked(spark, sf, "hadith")).select("claim_id")


@R(
    "joi_13_widen_narrations",
    f"""WITH {MARKED}, {SENT}, {SCL}, {HM}, i AS (SELECT a.cid AS p, b.cid AS c, a.e - a.start AS pl, b.e - b.start AS cl FROM hm a JOIN sc b ON a.doc_id = b.doc_id AND {_OV} > 0 AND {_OV} >= 0.9 * (a.e - a.start)),
    w AS (SELECT c FROM i JOIN hm ON hm.cid = i.p GROUP BY c, cl HAVING cl >= 1.2 * max(pl) AND NOT bool_or(closed)), g AS (SELECT DISTINCT p FROM i WHERE c IN (SELECT c FROM w))
    SELECT cid AS claim_id, 'kept' AS part FROM hm WHERE cid NOT IN (SELECT p FROM g) UNION ALL SELECT c, 'kept' FROM w UNION ALL SELECT cid, 'left' FROM sc WHERE cid NOT IN (SELECT c FROM w)""",
)
def _(spark, sf):
    kept, left = C.widen_narrations(cut_lineage(marked(spark, sf, "hadith")), cut_lineage(sentence_claims(spark, sf)))
    return kept.select("claim_id", F.lit("kept").alias("part")).unionByName(left.select("claim_id", F.lit("left").alias("part")))


@R(
    "joi_14_join_pieces",
    f"""WITH {MARKED}, {SENT}, {SCL}, {HM}, i AS (SELECT a.cid AS p, a.start AS ps, b.cid AS q, b.start AS qs, b.e AS qe, count(*) OVER (PARTITION BY b.cid) AS n FROM hm a JOIN sc b ON a.doc_id = b.doc_id AND b.start <= a.start AND a.e <= b.e),
    f AS (SELECT arg_min(p, ps * 1000000 + 0) AS p, any_value(qs) AS qs, any_value(qe) AS qe FROM i WHERE n >= 2 GROUP BY q)
    SELECT cid AS claim_id, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM hm WHERE cid NOT IN (SELECT p FROM i WHERE n >= 2) UNION ALL SELECT p, CAST(qs AS BIGINT), CAST(qe AS BIGINT) FROM f""",
)
def _(spark, sf):
    j = C.join_split_quotations(cut_lineage(marked(spark, sf, "hadith")), cut_lineage(sentence_claims(spark, sf)))
    return j.select("claim_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


AQ = "aq AS (SELECT * FROM mk WHERE type = 'attributed_quote')"


@R("joi_15_prefer_sayings", f"WITH {MARKED}, {SENT}, {SCL}, {AQ} SELECT cid AS claim_id FROM sc a WHERE NOT EXISTS (SELECT 1 FROM aq b WHERE a.doc_id = b.doc_id AND {_OV} >= 0.6 * (a.e - a.start) AND {_OV} >= 0.8 * (b.e - b.start))")
def _(spark, sf):
    return C.prefer_sayings(sentence_claims(spark, sf), marked(spark, sf, "attributed_quote")).select("claim_id")


@R(
    "joi_16_personal_levels",
    f"""WITH {MARKED}, {SENT}, {SCL}, {AQ}, h AS (SELECT a.cid AS c, b.cid AS m FROM sc a JOIN aq b ON a.doc_id = b.doc_id AND {_OV} > 0 AND {_OV} >= 0.5 * least(a.e - a.start, b.e - b.start))
    SELECT cid AS claim_id, CASE WHEN cid IN (SELECT c FROM h) THEN 'D' ELSE 'A' END AS level FROM sc UNION ALL SELECT cid, 'D' FROM aq WHERE cid NOT IN (SELECT m FROM h)""",
)
def _(spark, sf):
    facts = cut_lineage(sentence_claims(spark, sf)).withColumn("type", F.lit("fact"))
    return C.keep_personal_cases(facts, cut_lineage(marked(spark, sf, "attributed_quote")).withColumn("level", F.lit("D"))).select("claim_id", "level")


@R("joi_16_question_levels", None)
def _(spark, sf):
    facts = cut_lineage(sentence_claims(spark, sf)).withColumn("type", F.lit("fact"))
    return C.keep_questions(facts, cut_lineage(marked(spark, sf, "attributed_quote")).withColumn("is_question", F.lit(True))).select("claim_id", "type", "is_question", "level")


_PLAIN = rx(rx("lower(quote)", r"[^\pL\pN\s]", " "), r"[\s\pZ]+", " ")


@R(
    "joi_17_repeated_quotations",
    f"""WITH {MARKED}, {HM}, r AS (SELECT doc_id, cid, start, trim({_PLAIN}) AS plain FROM hm), t AS (SELECT * FROM r WHERE len(string_split(plain, ' ')) >= 3)
    SELECT DISTINCT a.cid AS claim_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.cid <> b.cid AND ((length(b.plain) > length(a.plain) AND contains(' ' || b.plain || ' ', ' ' || a.plain || ' ')) OR (a.plain = b.plain AND b.start < a.start))""",
)
def _(spark, sf):
    return C.repeated_quotations(cut_lineage(marked(spark, sf, "hadith"))).select("claim_id")


@R(
    "joi_17_drop_noise",
    f"""WITH {MARKED}, {HM}, r AS (SELECT doc_id, cid, start, trim({_PLAIN}) AS plain FROM hm), t AS (SELECT * FROM r WHERE len(string_split(plain, ' ')) >= 3),
    rep AS (SELECT DISTINCT a.cid FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.cid <> b.cid AND ((length(b.plain) > length(a.plain) AND contains(' ' || b.plain || ' ', ' ' || a.plain || ' ')) OR (a.plain = b.plain AND b.start < a.start))),
    sh AS (SELECT cid FROM (SELECT cid, trim({_PLAIN}) AS plain FROM mk WHERE type = 'attributed_quote') WHERE len(list_filter(string_split(plain, ' '), lambda w: w <> '')) < 3),
    ct AS (SELECT DISTINCT a.cid FROM mk a JOIN hm b ON a.type = 'fact' AND a.doc_id = b.doc_id AND {_OV} > 0 AND {_OV} >= 0.9 * (b.e - b.start))
    SELECT cid AS claim_id FROM mk WHERE cid NOT IN (SELECT cid FROM rep) AND cid NOT IN (SELECT cid FROM sh) AND cid NOT IN (SELECT cid FROM ct)""",
)
def _(spark, sf):
    return C.drop_noise(cut_lineage(marked(spark, sf))).select("claim_id")


@R(
    "joi_19_words_outside",
    f"""WITH {MARKED}, {SENT}, {DOC_WORDS}, {DOC_TOKENS}, r AS (SELECT doc_id, seg, a, least(a + 30, n) AS b FROM (SELECT doc_id, unnest(range(0, len(w), 30)) AS a, len(w) AS n FROM dw), LATERAL (SELECT doc_id || '-' || a AS seg)),
    o AS (SELECT seg, dt.doc_id, word FROM r JOIN dt ON dt.doc_id = r.doc_id AND i >= a AND i < b WHERE i % 100 >= 40)
    SELECT doc_id, seg AS run_id, count(*) AS n_outside FROM o GROUP BY ALL HAVING count(*) >= 6 AND len(list_distinct(list_filter(list(word), lambda x: length(x) >= 2))) >= 4""",
)
def _(spark, sf):
    w = G.doc_words(documents(spark, sf), SCRIPT)
    runs = w.filter(F.size("words") > 0).select("doc_id", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(30))).alias("start_w"))
    runs = runs.select("doc_id", F.concat_ws("-", "doc_id", "start_w").alias("run_id"), "start_w", F.least(F.col("start_w") + 30, F.col("n")).alias("end_w"))
    spans = w.filter(F.size("words") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(100))).alias("start")).withColumn("end", F.col("start") + 40)
    return C.count_outside(runs, w, spans).select("doc_id", "run_id", "n_outside")


@R("set_2_prioritised_union", None)
def _(spark, sf):
    m = cut_lineage(marked(spark, sf))
    quick = cut_lineage(C.prefer_sayings(cut_lineage(sentence_claims(spark, sf)), m.filter("type = 'attributed_quote'")))
    return C.drop_noise(cut_lineage(C.merge_claims(quick, m))).select("claim_id", "type", "start", "end")


@R("set_5_new_claims", f"WITH {MARKED} SELECT cid AS claim_id FROM mk WHERE type <> 'hadith'")
def _(spark, sf):
    return C.new_claims(marked(spark, sf), marked(spark, sf, "hadith")).select("claim_id")


@R("set_4_ordered_distinct", f"WITH t AS (SELECT doc_id, unnest({tokens_sql('text')}) AS x, generate_subscripts({tokens_sql('text')}, 1) AS k FROM documents), f AS (SELECT doc_id, x, min(k) AS k FROM t GROUP BY ALL) SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS words FROM f GROUP BY doc_id")
def _(spark, sf):
    w = G.once(documents(spark, sf), "w", X.tokens(F.col("text"), SCRIPT)).filter(F.size("w") > 0)
    return w.select("doc_id", F.array_join(F.array_distinct("w"), " ").alias("words"))


@R("set_3_token_intersection", f"SELECT a.doc_id, len(list_intersect(list_distinct({tokens_sql('a.text')}), list_distinct({tokens_sql('b.text')}))) AS shared FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def _(spark, sf):
    w = G.once(documents(spark, sf), "w", X.tokens(F.col("text"), SCRIPT)).select("doc_id", "w")
    nxt = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(nxt, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("bigint").alias("shared"))


@R(
    "win_11_claims_cap",
    f"WITH {MARKED} SELECT claim_id, CAST(n AS INT) AS n FROM (SELECT cid AS claim_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, cid) AS n FROM mk) WHERE n <= 10",
)
def _(spark, sf):
    return C.cap_claims(marked(spark, sf), 10).select("claim_id", F.col("index").alias("n"))


# --------------------------------------------------------------------------- offsets and segments

_SEG2 = (
    f"sg0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), sg1 AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS seg_id FROM sg0), "
    "sg AS (SELECT doc_id, seg_id, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM sg1)"
)


def line_segments(spark, sf):
    s = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_id", "text"))
    s = s.withColumn("start_s", F.col("seg_id") * 4.0).withColumn("end_s", F.col("seg_id") * 4.0 + 4.0)
    return SEG.with_abs_start(s)


@R(
    "joi_18_locate",
    f"""WITH {MARKED}, {_SEG2}, j AS (SELECT cid, sg.*, mk.start, mk.e FROM mk JOIN sg ON sg.doc_id = mk.doc_id AND sg.a <= mk.start QUALIFY row_number() OVER (PARTITION BY cid ORDER BY sg.a DESC, seg_id DESC) = 1),
    k AS (SELECT *, greatest(0, start - a) AS x, least(length(text), e - a) AS y FROM j) SELECT cid AS claim_id, CAST(seg_id AS INT) AS seg_id, CAST(x AS BIGINT) AS seg_start, CAST(CASE WHEN y <= x THEN length(text) ELSE y END AS BIGINT) AS seg_end, round(seg_id * 4.0::DOUBLE + x / greatest(1, length(text)) * 4.0::DOUBLE, 1) AS at_s FROM k""",
)
def _(spark, sf):
    loc = SEG.locate(marked(spark, sf), line_segments(spark, sf))
    return loc.select("claim_id", "seg_id", F.col("seg_start").cast("bigint").alias("seg_start"), F.col("seg_end").cast("bigint").alias("seg_end"), "at_s")


@R(
    "joi_18_locate_all",
    f"""WITH {MARKED}, {_SEG2} SELECT cid AS claim_id, CAST(seg_id AS INT) AS seg_id, CAST(greatest(mk.start, a) - a AS BIGINT) AS seg_start, CAST(least(mk.e, a + length(sg.text)) - a AS BIGINT) AS seg_end FROM mk JOIN sg ON sg.doc_id = mk.doc_id AND a < mk.e AND mk.start < a + length(sg.text)
    WHERE trim(substr(sg.text, CAST(greatest(mk.start, a) - a + 1 AS BIGINT), CAST(least(mk.e, a + length(sg.text)) - greatest(mk.start, a) AS BIGINT)), ' ') <> ''""",
)
def _(spark, sf):
    loc = SEG.locate_all(marked(spark, sf), line_segments(spark, sf))
    return loc.select("claim_id", "seg_id", F.col("seg_start").cast("bigint").alias("seg_start"), F.col("seg_end").cast("bigint").alias("seg_end"))


# --------------------------------------------------------------------------- fragments


@R("aln_7_extend_fragments", None)
def _(spark, sf):
    """Passages whose middle word was changed: the scan sees two pieces, the extension brings them together."""
    c = canon(spark, sf)
    b = G.once(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "src", X.words(F.col("text"), SCRIPT))
    changed = F.transform("src", lambda w, i: F.when(i == F.floor(F.size("src") / 2), F.lit("changed")).otherwise(w))
    docs = b.select("doc_id", F.array_join(changed, " ").alias("text"))
    runs = FL.scan_canon(docs, c).withColumn("run_id", F.concat_ws("-", "doc_id", "start_w")).withColumn("at", F.col("start_w"))
    wide = L.extend_fragments(
        runs.select("run_id", "doc_id", "start_w", "end_w", "at"), G.doc_words(docs, SCRIPT), L.gap_breaks(docs, SCRIPT), runs.select("run_id", "doc_id").join(b.select("doc_id", "src"), "doc_id").select("run_id", "src")
    )
    return L.join_adjoining(wide.withColumn("group_no", F.lit(1))).select("doc_id", "lo", "hi")
