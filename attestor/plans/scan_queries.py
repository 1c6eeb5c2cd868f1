"""Scans, canon matching, ranked retrieval and candidate orders."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import text as X
from ..operators import flows as FL
from ..operators import generate as GN
from ..operators import grams as G
from ..operators import match as M
from ..operators import retrieve as RT
from ..operators import scan as S
from ..session import fits_broadcast
from .common import *  # noqa: F403
from .common import Registry
from .text_queries import LATIN_STOP, STOP_SQL

R = Registry()


def canon(spark, sf) -> FL.Canon:
    return FL.Canon.build(canon_units(spark, sf), SCRIPT)


# --------------------------------------------------------------------------- statistics


@R("agg_1_word_idf", f"WITH {CANON}, {IDF} SELECT word, df, round(idf, 6) AS idf FROM idf")
def _(spark, sf):
    return canon(spark, sf).idf.select("word", "df", F.round("idf", 6).alias("idf"))


TITLES = (
    r"tp AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages), "
    f"ts AS (SELECT page_id, title, url, list_distinct(list_filter({tokens_sql('title')}, lambda x: length(x) > 3)) AS stems FROM tp), tf AS (SELECT * FROM ts WHERE len(stems) > 0), "
    "tn AS (SELECT greatest(count(*), 1) AS n FROM tf), ti AS (SELECT stem, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 0.5)) AS idf FROM (SELECT unnest(stems) AS stem FROM tf), tn GROUP BY stem)"
)


def title_pages(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return RT.page_stems(G.spread(p), SCRIPT)


@R("agg_2_title_idf", f"WITH {TITLES} SELECT stem, df, round(idf, 6) AS idf FROM ti")
def _(spark, sf):
    return G.title_idf(title_pages(spark, sf)).select("stem", "df", F.round("idf", 6).alias("idf"))


REC = f"rec AS (SELECT key, {words_sql('text')} AS w FROM graded)"
STATS = "rt AS (SELECT key, len(w) AS dl, unnest(w) AS term FROM rec), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM rec), po AS (SELECT term, key, dl, count(*) AS tf FROM rt GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY term)"


@R("agg_3_corpus_stats", f"WITH {GRADED}, {REC}, {STATS} SELECT term, df, n, round(avgdl, 6) AS avgdl, ttf FROM df, st, LATERAL (SELECT CAST(sum(tf) AS BIGINT) AS ttf FROM po WHERE po.term = df.term)")
def _(spark, sf):
    rw = RT.record_words(graded(spark, sf), SCRIPT)
    st = G.corpus_stats(rw)
    t = G.postings(rw).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
    return t.select("term", "df", st.select("n").scalar().alias("n"), F.round(st.select("avgdl").scalar(), 6).alias("avgdl"), "ttf")


# --------------------------------------------------------------------------- canon scan

PAIRS = (
    "dg AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER z || ' ' || lead(word, 2) OVER z || ' ' || lead(word, 3) OVER z AS g FROM dt WINDOW z AS (PARTITION BY doc_id ORDER BY i)), "
    "cg AS (SELECT pos, word || ' ' || lead(word, 1) OVER z || ' ' || lead(word, 2) OVER z || ' ' || lead(word, 3) OVER z AS g FROM ct WINDOW z AS (ORDER BY pos)), "
    "pr AS (SELECT doc_id, i, pos AS p FROM dg JOIN cg USING (g)), "
    "isl AS (SELECT doc_id, i, p, p - i AS diag, i - row_number() OVER (PARTITION BY doc_id, p - i ORDER BY i) AS isle FROM pr), "
    "rn AS (SELECT doc_id, i, p, min(i) OVER (PARTITION BY doc_id, diag, isle) AS rs, max(i) OVER (PARTITION BY doc_id, diag, isle) + 4 AS re FROM isl)"
)
GREEDY = (
    "ca AS (SELECT doc_id, i, re - i AS len, p FROM rn QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY re - i DESC, p) = 1), "
    "wt AS (SELECT pos, coalesce(idf, 6.0) AS x FROM ct LEFT JOIN idf USING (word)), wg AS (SELECT pos, sum(x) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS weight FROM wt), "
    "ql AS (SELECT ca.* FROM ca JOIN wg ON wg.pos = ca.p WHERE len >= 5 OR weight >= 12), "
    "nx AS (SELECT a.*, (SELECT min(b.i) FROM ql b WHERE b.doc_id = a.doc_id AND b.i >= a.i + a.len) AS ni FROM ql a), "
    "gr(doc_id, i, len, p, ni) AS (SELECT * FROM nx QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 UNION ALL SELECT n.* FROM gr JOIN nx n ON n.doc_id = gr.doc_id AND n.i = gr.ni)"
)
CANON_SCAN = f"{DOC_WORDS}, {DOC_TOKENS}, {CANON}, {IDF}, {PAIRS}, {GREEDY}"


def _offset_sql(word_index: str, end: bool) -> str:
    """Character offset of a word from the pieces and gaps of its text (columns ps, gs, lead, kept)."""
    k = f"kept[{word_index} + 1]"
    return f"(coalesce(list_sum(list_transform(ps[1:{k}{'' if end else ' - 1'}], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gs[1:{k} - 1 + lead], lambda x: length(x))), 0))"


PIECES = (
    f"pc AS (SELECT doc_id, text, regexp_extract_all(text, '{SQL_PIECE}+') AS ps, regexp_extract_all(text, '{SQL_BREAKS}+') AS gs, CASE WHEN regexp_matches(text, '^{SQL_BREAKS}') THEN 1 ELSE 0 END AS lead FROM documents), "
    r"pk AS (SELECT *, list_filter(list_transform(ps, lambda x, i: CASE WHEN regexp_matches(x, '[\pL\pN_]') THEN i END), lambda y: y IS NOT NULL) AS kept FROM pc)"
)


@R(
    "joi_1_canon_scan",
    f"""WITH RECURSIVE {CANON_SCAN}, {PIECES}, o AS (SELECT gr.doc_id, i, len, p, text, {_offset_sql('i', False)} AS s, {_offset_sql('(i + len - 1)', True)} AS e FROM gr JOIN pk USING (doc_id))
    SELECT doc_id, CAST(i AS INT) AS start_w, CAST(i + len AS INT) AS end_w, p, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS quote FROM o""",
)
def canon_scan(spark, sf):
    return FL.scan_canon(documents(spark, sf), canon(spark, sf)).drop("spelling")


@R("win_1_equal_runs", f"WITH {DOC_WORDS}, {DOC_TOKENS}, {CANON}, {PAIRS} SELECT DISTINCT doc_id, CAST(rs AS INT) AS start_w, CAST(re AS INT) AS end_w, p - i + rs AS src_start FROM rn")
def _(spark, sf):
    c = canon(spark, sf)
    src = G.hashed(G.stream_grams(c.tokens, 4)).select(F.lit(0).cast("bigint").alias("src"), F.col("pos").alias("p"), "h", "h2")
    return S.runs_only(S.gram_pairs(G.explode_grams(G.doc_words(documents(spark, sf), SCRIPT), 4), src, S.HOT, c.small)).select("doc_id", "start_w", "end_w", "src_start")


@R("win_2_leftmost_choice", f"WITH RECURSIVE {CANON_SCAN} SELECT doc_id, count(*) AS runs, CAST(sum(len) AS BIGINT) AS words FROM gr GROUP BY doc_id")
def _(spark, sf):
    c = canon(spark, sf)
    runs = S.canon_scan(G.doc_words(documents(spark, sf), SCRIPT), c.tokens, c.idf, c.small)
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.col("end_w") - F.col("start_w")).alias("words"))


@R("flt_8_distinctive_runs", f"WITH {CANON_SCAN[: CANON_SCAN.index('nx AS')].rstrip(', ')} SELECT doc_id, CAST(i AS INT) AS i, CAST(len AS INT) AS len, p FROM ql")
def _(spark, sf):
    c = canon(spark, sf)
    best = S.longest_at(G.doc_words(documents(spark, sf), SCRIPT), c.tokens, c.small)
    return S.distinctive(best, c.tokens, c.idf, c.small)


@R("joi_1_filtered_scan", f"WITH {CANON_SCAN[: CANON_SCAN.index('wt AS')].rstrip(', ')} SELECT doc_id, CAST(i AS INT) AS i, CAST(len AS INT) AS len, p FROM ca")
def _(spark, sf):
    """The scan as it runs on a corpus too large to be broadcast: document grams pass the filter, the rest are shuffled."""
    return S.longest_at(G.doc_words(documents(spark, sf), SCRIPT), canon(spark, sf).tokens, False)


@R(
    "prj_14_unit_ranges",
    f"""WITH RECURSIVE {CANON_SCAN}, cl AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS n, doc_id || '-' || i AS claim_id, p, len FROM gr),
    h AS (SELECT claim_id, ct.group_no, ct.unit_no, min(pos) AS pos FROM cl JOIN ct ON ct.pos >= p AND ct.pos < p + len GROUP BY ALL), f AS (SELECT claim_id, arg_min(group_no, pos) AS g FROM h GROUP BY claim_id),
    k AS (SELECT h.* FROM h JOIN f ON f.claim_id = h.claim_id AND f.g = h.group_no)
    SELECT k.claim_id, k.group_no, min(k.unit_no) AS unit_start, max(k.unit_no) AS unit_end, string_agg(cu.text, ' ۝ ' ORDER BY k.unit_no) AS source_text,
      'Group ' || k.group_no || ' ' || k.group_no || ':' || CASE WHEN min(k.unit_no) = max(k.unit_no) THEN CAST(min(k.unit_no) AS VARCHAR) ELSE min(k.unit_no) || '–' || max(k.unit_no) END AS ref,
      'canon/' || k.group_no || '/' || min(k.unit_no) AS url FROM k JOIN cu ON cu.group_no = k.group_no AND cu.unit_no = k.unit_no GROUP BY k.claim_id, k.group_no""",
)
def _(spark, sf):
    c = canon(spark, sf)
    runs = S.canon_scan(G.doc_words(documents(spark, sf), SCRIPT), c.tokens, c.idf, c.small)
    claims = runs.select(F.concat_ws("-", "doc_id", "start_w").alias("claim_id"), "p", (F.col("end_w") - F.col("start_w")).alias("n_words"))
    groups = c.units.select("group_no", F.concat(F.lit("Group "), "group_no").alias("name")).distinct()
    return S.reference_strings(S.covered_units(claims, c.units, c.positions), groups, "canon").drop("name")


@R(
    "flt_11_unit_edges",
    f"""WITH RECURSIVE {CANON_SCAN}, f AS (SELECT doc_id, i, p, p + len - 1 AS q FROM gr)
    SELECT doc_id || '-' || i AS claim_id, a.word = list_first(ua.w) AS starts_at_unit_start, CASE WHEN a.group_no = b.group_no THEN b.word = list_last(ub.w) ELSE NULL END AS ends_at_unit_end
    FROM f JOIN ct a ON a.pos = f.p JOIN ct b ON b.pos = f.q JOIN cu ua ON ua.group_no = a.group_no AND ua.unit_no = a.unit_no JOIN cu ub ON ub.group_no = b.group_no AND ub.unit_no = b.unit_no""",
)
def _(spark, sf):
    c = canon(spark, sf)
    runs = S.canon_scan(G.doc_words(documents(spark, sf), SCRIPT), c.tokens, c.idf, c.small)
    cl = runs.select(F.concat_ws("-", "doc_id", "start_w").alias("claim_id"), "p", (F.col("end_w") - F.col("start_w")).alias("n_words"))
    at = lambda pos, name: c.tokens.select(F.col("pos").alias(pos), F.col("word").alias(name), F.col("group_no").alias(name + "_g"))
    ends = cl.withColumn("a", F.col("p")).withColumn("b", F.col("p") + F.col("n_words") - 1).join(at("a", "first_word"), "a").join(at("b", "last_word"), "b")
    e = S.unit_edges(ends.select("claim_id", "first_word", "last_word"), S.covered_units(cl, c.units, c.positions), S.unit_edge_words(c.units, SCRIPT))
    same = ends.select("claim_id", (F.col("first_word_g") == F.col("last_word_g")).alias("one_group"))
    return e.join(same, "claim_id").select("claim_id", "starts_at_unit_start", F.when(F.col("one_group"), F.col("ends_at_unit_end")).alias("ends_at_unit_end"))


# --------------------------------------------------------------------------- record scan

_RPAIRS = (
    f"{GRADED}, {REC}, {DOC_WORDS}, {DOC_TOKENS}, rk AS (SELECT key AS src, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM rec), "
    "dg AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER z || ' ' || lead(word, 2) OVER z || ' ' || lead(word, 3) OVER z AS g FROM dt WINDOW z AS (PARTITION BY doc_id ORDER BY i)), "
    "rg AS (SELECT src, p, word || ' ' || lead(word, 1) OVER z || ' ' || lead(word, 2) OVER z || ' ' || lead(word, 3) OVER z AS g FROM rk WINDOW z AS (PARTITION BY src ORDER BY p)), "
    "pr AS (SELECT doc_id, src, i, p FROM dg JOIN rg USING (g)), "
    "isl AS (SELECT *, p - i AS diag, i - row_number() OVER (PARTITION BY doc_id, src, p - i ORDER BY i) AS isle FROM pr), "
    "rn AS (SELECT doc_id, src, i, p, max(i) OVER (PARTITION BY doc_id, src, diag, isle) + 4 AS re FROM isl), "
    "ca AS (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY re DESC, src, p) = 1), "
    "nx AS (SELECT a.*, (SELECT min(b.i) FROM ca b WHERE b.doc_id = a.doc_id AND b.i >= a.re) AS ni FROM ca a), "
    "pk(doc_id, s, e, src, ss, se, ni) AS (SELECT doc_id, i, re, src, p, p + re - i, ni FROM nx QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 "
    "UNION ALL SELECT n.doc_id, n.i, n.re, n.src, n.p, n.p + n.re - n.i, n.ni FROM pk JOIN nx n ON n.doc_id = pk.doc_id AND n.i = pk.ni)"
)
_MERGED = (
    "nw AS (SELECT *, CASE WHEN lag(src) OVER z = src AND s - lag(e) OVER z <= 6 AND ss >= lag(se) OVER z - 2 THEN 0 ELSE 1 END AS b FROM pk WINDOW z AS (PARTITION BY doc_id ORDER BY s)), "
    "pt AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM nw), mg AS (SELECT doc_id, src, min(s) AS start_w, max(e) AS end_w FROM pt GROUP BY doc_id, src, part)"
)


@R(
    "joi_2_record_scan",
    f"""WITH RECURSIVE {_RPAIRS}, {_MERGED} SELECT mg.doc_id, src, CAST(start_w AS INT) AS start_w, CAST(end_w AS INT) AS end_w FROM mg JOIN dw USING (doc_id)
    WHERE end_w - start_w >= 6 AND len(list_distinct(list_filter(w[start_w + 1:end_w], lambda x: length(x) >= 2))) >= 4""",
)
def record_scan(spark, sf):
    g = graded(spark, sf)
    rec = RT.record_words(g, SCRIPT).select(F.col("key").alias("src"), "words")
    return S.record_scan(G.doc_words(documents(spark, sf), SCRIPT), rec, fits_broadcast(g, F.col("text")), script=SCRIPT)


@R("win_3_merged_runs", f"WITH RECURSIVE {_RPAIRS}, {_MERGED} SELECT doc_id, src, CAST(start_w AS INT) AS start_w, CAST(end_w AS INT) AS end_w FROM mg")
def _(spark, sf):
    g = graded(spark, sf)
    rec = RT.record_words(g, SCRIPT).select(F.col("key").alias("src"), "words")
    return S.merge_neighbours(S.record_runs(G.doc_words(documents(spark, sf), SCRIPT), rec, fits_broadcast(g, F.col("text"))))


@R("flt_5_frequency_caps", f"WITH {CANON}, b AS (SELECT pos, word || ' ' || lead(word) OVER (ORDER BY pos) AS g FROM ct), c AS (SELECT g, count(*) AS cnt FROM b WHERE g IS NOT NULL GROUP BY g) SELECT pos AS p, cnt FROM b JOIN c USING (g) WHERE cnt <= 3")
def _(spark, sf):
    g2 = G.hashed(G.stream_grams(canon(spark, sf).tokens, 2)).select(F.col("pos").alias("p"), "h", "h2")
    return G.capped(g2, ["h", "h2"], 3).select("p", "cnt")


# --------------------------------------------------------------------------- one quotation against the canon


def run_claims(spark, sf, c):
    """Located passages and passages with one word changed, as quotations."""
    exact = S.canon_scan(G.doc_words(documents(spark, sf), SCRIPT), c.tokens, c.idf, c.small)
    words = G.doc_words(documents(spark, sf), SCRIPT)
    q = exact.join(words, "doc_id").select(F.concat_ws("-", "doc_id", "start_w").alias("claim_id"), F.slice("words", F.col("start_w") + 1, F.col("end_w") - F.col("start_w")).alias("q"))
    return q


_RUN_CLAIMS = "qc AS (SELECT gr.doc_id || '-' || i AS claim_id, w[i + 1:i + len] AS q FROM gr JOIN dw USING (doc_id))"
_PLACES = (
    "qt AS (SELECT claim_id, len(q) AS n, unnest(q) AS word, generate_subscripts(q, 1) - 1 AS k FROM qc WHERE len(q) >= 3), "
    "mt AS (SELECT claim_id, n, ct.pos - k AS p, count(*) AS c FROM qt JOIN ct USING (word) GROUP BY ALL), pl AS (SELECT claim_id, CAST(n AS INT) AS n_words, p FROM mt WHERE c = n)"
)


@R("joi_3_exact_places", f"WITH RECURSIVE {CANON_SCAN}, {_RUN_CLAIMS}, {_PLACES} SELECT claim_id, p, n_words FROM pl")
def _(spark, sf):
    c = canon(spark, sf)
    return M.exact_places(run_claims(spark, sf, c), c.tokens, c.small)


@R("joi_3_short_units", f"WITH {CANON}, u AS (SELECT word, count(*) OVER (PARTITION BY word) AS n FROM ct) SELECT DISTINCT word AS claim_id FROM u WHERE false")
def _(spark, sf):
    # one-word quotations: none of the units is that short, so nothing may match
    c = canon(spark, sf)
    q = c.tokens.select("word").distinct().select(F.col("word").alias("claim_id"), F.array("word").alias("q"))
    return M.exact_units(q, c.positions).select("claim_id")


_SHORT = f"{CANON}, sg AS (SELECT pos, [word, lead(word, 1) OVER z, lead(word, 2) OVER z] AS q, group_no, unit_no FROM ct WINDOW z AS (ORDER BY pos)), sq AS (SELECT array_to_string(q, ' ') AS claim_id, pos, group_no, unit_no FROM sg WHERE q[3] IS NOT NULL)"


@R(
    "joi_4_other_places",
    f"""WITH {_SHORT}, f AS (SELECT claim_id, min(pos) AS p0 FROM sq GROUP BY claim_id), o AS (SELECT claim_id, group_no, unit_no, min(pos) AS p FROM sq JOIN f USING (claim_id) WHERE pos <> p0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY p) AS rn FROM o) SELECT claim_id, string_agg(group_no || ':' || unit_no, ' ' ORDER BY rn) AS others FROM r WHERE rn <= 8 GROUP BY claim_id""",
)
def _(spark, sf):
    c = canon(spark, sf)
    q = G.stream_grams(c.tokens, 3).select(F.array_join("words", " ").alias("claim_id"), F.col("words").alias("q")).dropDuplicates(["claim_id"])
    o = M.other_places(M.exact_places(q, c.tokens, c.small), c.tokens)
    return o.select("claim_id", F.array_join(F.transform("others", lambda x: F.concat_ws(":", x["group_no"], x["unit_no"])), " ").alias("others"))


def altered_claims(spark, sf):
    """Every passage with each seventh word left out, as a quotation to find."""
    b = table(spark, sf, "benchmark")
    w = G.once(b.select(F.col("item_id").cast("string").alias("claim_id"), "text"), "w", X.words(F.col("text"), SCRIPT))
    return w.select("claim_id", F.filter("w", lambda x, i: (i + 1) % 7 != 0).alias("q"))


ALTERED = f"qc AS (SELECT CAST(item_id AS VARCHAR) AS claim_id, list_filter({words_sql('text')}, lambda x, i: i % 7 <> 0) AS q FROM benchmark)"
SEEDS = (
    "qb AS (SELECT claim_id, unnest(q) AS word, generate_subscripts(q, 1) - 1 AS i FROM qc), q2 AS (SELECT claim_id, i, word || ' ' || lead(word) OVER (PARTITION BY claim_id ORDER BY i) AS g FROM qb), "
    "c2 AS (SELECT pos, word || ' ' || lead(word) OVER (ORDER BY pos) AS g FROM ct), n2 AS (SELECT g, count(*) AS cnt FROM c2 WHERE g IS NOT NULL GROUP BY g), "
    "h2 AS (SELECT claim_id, CAST(floor((pos - i) / 4) AS BIGINT) AS bucket, CASE WHEN cnt < 10 THEN 2 ELSE 1 END AS vote FROM q2 JOIN c2 USING (g) JOIN n2 USING (g)), "
    "up AS (SELECT group_no, unit_no, min(pos) AS pos0 FROM ct GROUP BY ALL), uw AS (SELECT DISTINCT pos0, word FROM ct JOIN up USING (group_no, unit_no)), "
    "us AS (SELECT DISTINCT claim_id, pos0 FROM (SELECT DISTINCT claim_id, word FROM qb) JOIN uw USING (word)), "
    "vt AS (SELECT claim_id, bucket, sum(vote) AS votes FROM (SELECT * FROM h2 UNION ALL SELECT claim_id, CAST(floor(pos0 / 4) AS BIGINT), 1 FROM us) GROUP BY ALL), "
    "sb AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY votes DESC, bucket) AS seed_rank FROM vt)"
)


@R("joi_5_seed_windows", f"WITH {CANON}, {ALTERED}, {SEEDS} SELECT claim_id, bucket, CAST(votes AS BIGINT) AS votes, CAST(seed_rank AS INT) AS seed_rank FROM sb")
def _(spark, sf):
    c = canon(spark, sf)
    return M.seed_windows(altered_claims(spark, sf), c.tokens, c.positions, c.small)


def span_sql(pairs: str, keys: str) -> str:
    """CTEs that find the best span of ``s`` for ``q`` in every row of ``pairs`` (columns keys, q, s)."""
    k = ", ".join(f"{x}" for x in keys.split(","))
    return (
        f"pq AS (SELECT {k}, unnest(q) AS word, generate_subscripts(q, 1) - 1 AS i FROM {pairs}), ps AS (SELECT {k}, unnest(s) AS word, generate_subscripts(s, 1) - 1 AS j FROM {pairs}), "
        f"pd AS (SELECT {k}, j - i AS d, count(*) AS c FROM pq JOIN ps USING ({k}, word) GROUP BY ALL), pv AS (SELECT {', '.join('a.' + x for x in keys.split(','))}, a.d, sum(b.c) AS votes FROM pd a JOIN pd b ON {' AND '.join(f'a.{x} = b.{x}' for x in keys.split(','))} AND abs(a.d - b.d) <= 2 GROUP BY ALL), "
        f"p0 AS (SELECT {k}, d FROM pv QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY votes DESC, d) = 1), "
        f"pe AS (SELECT {k}, q, s, len(q) AS n, len(s) AS m, coalesce(d, 0) AS d FROM {pairs} LEFT JOIN p0 USING ({k})), "
        f"pa AS (SELECT *, greatest(0, least(d, m - 1)) AS a0 FROM pe), pb AS (SELECT *, greatest(a0 + 1, least(d + n, m)) AS b0, greatest(4, n // 2) AS gate FROM pa), "
        f"pw AS (SELECT {k}, q, s, a0 + x AS a, b0 + y AS b FROM pb, range(-3, 4) t(x), range(-3, 4) u(y) WHERE m > n AND a0 + x BETWEEN 0 AND m - 1 AND b0 + y BETWEEN a0 + x + 1 AND m AND (abs(b0 + y - a0 - x - n) <= gate OR (x = 0 AND y = 0)) "
        f"UNION ALL SELECT {k}, q, s, 0, m FROM pb WHERE m <= n), "
        f"px AS (SELECT {k}, a, b, array_to_string(q, ' ') AS qt, array_to_string(s[a + 1:b], ' ') AS st FROM pw), "
        f"py AS (SELECT {k}, a, b, 1.0::DOUBLE - CAST(levenshtein(qt, st) AS DOUBLE) / greatest(length(qt), length(st)) AS score FROM px), "
        f"sp AS (SELECT * FROM py QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY score DESC, a, b) = 1)"
    )


_FUZZY = (
    "wn AS (SELECT claim_id, q, seed_rank, greatest(0, bucket * 4 - greatest(4, len(q) // 3)) AS lo, bucket * 4 + len(q) + greatest(4, len(q) // 3) + 4 AS hi FROM sb JOIN qc USING (claim_id)), "
    "wp AS (SELECT claim_id, seed_rank, any_value(lo) AS lo, any_value(q) AS q, list(word ORDER BY pos) AS s FROM wn JOIN ct ON pos >= lo AND pos < hi GROUP BY claim_id, seed_rank)"
)


@R(
    "joi_5_fuzzy_windows",
    f"""WITH {CANON}, {ALTERED}, {SEEDS}, {_FUZZY}, {span_sql('wp', 'claim_id,seed_rank')}, r AS (SELECT claim_id, seed_rank, lo + a AS p, b - a AS n_words, score FROM sp JOIN wn USING (claim_id, seed_rank)),
    un AS (SELECT claim_id, max(round(score, 9)) AS s FROM r JOIN ct ON ct.pos = r.p GROUP BY claim_id, group_no, unit_no), kt AS (SELECT claim_id, s FROM un QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY s DESC) = 5)
    SELECT claim_id, CAST(seed_rank AS INT) AS seed_rank, p, CAST(n_words AS INT) AS n_words, round(score, 6) AS score FROM r LEFT JOIN kt USING (claim_id) WHERE s IS NULL OR round(score, 9) >= s""",
)
def _(spark, sf):
    c = canon(spark, sf)
    f = M.fuzzy_spans(altered_claims(spark, sf), c.tokens, c.positions, c.small, 5)
    return f.select("claim_id", "seed_rank", "p", "n_words", F.round("score", 6).alias("score"))


@R(
    "rul_16_canon_match",
    f"""WITH {CANON}, {ALTERED}, {SEEDS}, {_FUZZY}, {span_sql('wp', 'claim_id,seed_rank')}, r AS (SELECT claim_id, seed_rank, lo + a AS p, b - a AS n_words, score FROM sp JOIN wn USING (claim_id, seed_rank) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 9) DESC, seed_rank) = 1)
    SELECT claim_id, CASE WHEN score >= 0.999 THEN 'exact' ELSE 'fuzzy' END AS kind, round(score, 4) AS similarity, p, CAST(n_words AS INT) AS n_words FROM r""",
)
def _(spark, sf):
    c = canon(spark, sf)
    return M.match_canon(altered_claims(spark, sf), c.tokens, c.positions, c.small)


@R(
    "win_5_best_per_place",
    f"""WITH {CANON}, {ALTERED}, {SEEDS}, {_FUZZY}, {span_sql('wp', 'claim_id,seed_rank')}, r AS (SELECT claim_id, lo + a AS p, round(score, 4) AS similarity FROM sp JOIN wn USING (claim_id, seed_rank)),
    u AS (SELECT claim_id, p, similarity, group_no, unit_no AS unit_start FROM r JOIN ct ON ct.pos = r.p), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY claim_id, group_no, unit_start ORDER BY similarity DESC, p) = 1)
    SELECT claim_id, group_no, unit_start, similarity, CAST(row_number() OVER z AS INT) AS rank FROM b WINDOW z AS (PARTITION BY claim_id ORDER BY similarity DESC, group_no, unit_start) QUALIFY row_number() OVER z <= 5""",
)
def _(spark, sf):
    c = canon(spark, sf)
    f = M.fuzzy_spans(altered_claims(spark, sf), c.tokens, c.positions, c.small, 5)
    at = f.join(c.tokens.select(F.col("pos").alias("p"), "group_no", F.col("unit_no").alias("unit_start")), "p").withColumn("similarity", F.round("score", 4))
    return RT.best_per_place(at).select("claim_id", "group_no", "unit_start", "similarity", "rank")


# --------------------------------------------------------------------------- ranked retrieval

TERMS = (
    "qu AS (SELECT claim_id, unnest(q) AS x, generate_subscripts(q, 1) AS k FROM qs), qf AS (SELECT claim_id, x, min(k) AS k FROM qu WHERE length(x) >= 2 GROUP BY ALL), "
    "qterm AS (SELECT claim_id, x AS term FROM qf)"
)
BM = (
    "sc AS (SELECT claim_id, key, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qterm JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 9) DESC, key) - 1 AS lexical_rank FROM sc)"
)
RETRIEVAL = f"{GRADED}, {REC}, {STATS}, {QUOTES}, {TERMS}, {BM}"


@R("joi_6_bm25", f"WITH {RETRIEVAL} SELECT claim_id, key, round(score, 6) AS score, CAST(lexical_rank AS INT) AS lexical_rank FROM rk WHERE lexical_rank < 40")
def bm25(spark, sf):
    q = RT.query_claims(passage_claims(spark, sf), SCRIPT)
    return RT.bm25(q, RT.record_words(graded(spark, sf), SCRIPT)).withColumn("score", F.round("score", 6))


@R("joi_6_topic_search", f"WITH {RETRIEVAL} SELECT claim_id, key, grade_class FROM rk JOIN graded USING (key) WHERE lexical_rank < 5")
def _(spark, sf):
    g = graded(spark, sf)
    hits = RT.bm25(RT.query_claims(passage_claims(spark, sf), SCRIPT), RT.record_words(g, SCRIPT), 5)
    return hits.join(g, "key").select("claim_id", "key", "grade_class")


_ALT = (
    f"{GRADED.replace('FROM documents JOIN labels USING (doc_id)', 'FROM documents JOIN labels USING (doc_id)')}, rec AS (SELECT key, {words_sql('text', False)} AS w FROM graded WHERE lang = 'en'), {STATS}, "
    f"q0 AS (SELECT CAST(item_id AS VARCHAR) AS claim_id, list_filter({tokens_sql('text', False)}, lambda x: length(x) > 2) AS q FROM benchmark), qterm AS (SELECT DISTINCT claim_id, unnest(q) AS term FROM q0 WHERE len(q) >= 2), {BM}"
)


@R("joi_7_alternate_language", f"WITH {_ALT} SELECT claim_id, key, round(score, 6) AS score, CAST(lexical_rank AS INT) AS lexical_rank FROM rk WHERE lexical_rank < 40")
def _(spark, sf):
    en = graded(spark, sf).filter("lang = 'en'")
    return RT.bm25(RT.query_alternate(passage_claims(spark, sf)), RT.record_words(en, "latin")).withColumn("score", F.round("score", 6))


@R(
    "joi_8_describe",
    f"WITH {RETRIEVAL} SELECT claim_id, key, attribution, grade_class, g.lang AS book, 'Book ' || g.lang AS name, g.lang = 'en' AS trusted FROM rk JOIN graded g USING (key) WHERE lexical_rank < 10",
)
def _(spark, sf):
    g = graded(spark, sf).withColumnRenamed("lang", "book")
    books = g.select("book").distinct().select("book", F.concat(F.lit("Book "), "book").alias("name"), (F.col("book") == "en").alias("trusted"))
    hits = RT.bm25(RT.query_claims(passage_claims(spark, sf), SCRIPT), RT.record_words(g, SCRIPT), 10)
    return RT.describe_candidates(hits, g, books).select("claim_id", "key", "attribution", "grade_class", "book", "name", "trusted")


_ALIGNED = f"{RETRIEVAL}, pairs AS (SELECT claim_id, key, q, w AS s FROM rk JOIN qs USING (claim_id) JOIN rec USING (key) WHERE lexical_rank < 40), {span_sql('pairs', 'claim_id,key')}"


def aligned(spark, sf, pool=40):
    cl = passage_claims(spark, sf)
    rw, cw = RT.record_words(graded(spark, sf), SCRIPT), RT.claim_words(cl, SCRIPT)
    return RT.align(RT.bm25(RT.query_claims(cl, SCRIPT), rw, pool), cw, rw)


@R("aln_2_best_span", f"WITH {_ALIGNED} SELECT claim_id, key, CAST(a AS INT) AS span_start, CAST(b AS INT) AS span_end, round(sp.score, 4) AS similarity, round((b - a) / greatest(1, len(s)), 6) AS coverage FROM sp JOIN pairs USING (claim_id, key)")
def _(spark, sf):
    return aligned(spark, sf).select("claim_id", "key", "span_start", "span_end", "similarity", F.round("coverage", 6).alias("coverage"))


@R(
    "win_4_candidate_order",
    f"""WITH {_ALIGNED}, o AS (SELECT sp.claim_id, sp.key, round(sp.score, 4) AS similarity, lexical_rank FROM sp JOIN rk USING (claim_id, key))
    SELECT claim_id, key, similarity, CAST(row_number() OVER z AS INT) AS rank FROM o WINDOW z AS (PARTITION BY claim_id ORDER BY similarity DESC, lexical_rank, key) QUALIFY row_number() OVER z <= 10""",
)
def _(spark, sf):
    return RT.rank_candidates(RT.union_corpora(("graded", aligned(spark, sf))), 10).select("claim_id", "key", "similarity", "rank")


@R(
    "win_6_primary_source",
    f"""WITH {_ALIGNED}, o AS (SELECT sp.claim_id, sp.key, round(sp.score, 4) AS similarity, lexical_rank, CASE WHEN g.lang = 'en' THEN 'graded' ELSE 'books' END AS corpus, attribution, g.lang = 'fr' AS trusted FROM sp JOIN rk USING (claim_id, key) JOIN graded g USING (key)),
    r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, CASE WHEN corpus = 'graded' THEN 0 ELSE 1 END, lexical_rank, key) AS rank, max(similarity) OVER (PARTITION BY claim_id) AS top FROM o)
    SELECT claim_id, key, corpus, similarity FROM r WHERE similarity >= top - 0.03 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN corpus = 'graded' THEN 0 WHEN trusted THEN 1 ELSE 2 END,
      CASE WHEN corpus = 'graded' THEN CASE WHEN length(attribution) > 40 THEN 1 ELSE 0 END END, CASE WHEN corpus = 'graded' THEN -similarity END, CASE WHEN corpus = 'graded' THEN length(attribution) END, rank) = 1""",
)
def _(spark, sf):
    g = graded(spark, sf).select("key", F.when(F.col("lang") == "en", "graded").otherwise("books").alias("corpus"), "attribution", (F.col("lang") == "fr").alias("trusted"))
    ranked = RT.rank_candidates(aligned(spark, sf).join(g, "key"), 40)
    return RT.pick_primary(ranked).select("claim_id", "key", "corpus", "similarity")


@R(
    "win_7_one_per_book",
    f"""WITH {_ALIGNED}, o AS (SELECT sp.claim_id, sp.key, g.lang AS book, row_number() OVER (PARTITION BY sp.claim_id ORDER BY round(sp.score, 4) DESC, lexical_rank, sp.key) AS rank FROM sp JOIN rk USING (claim_id, key) JOIN graded g USING (key)),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY claim_id, book ORDER BY rank) = 1) SELECT claim_id, key, book, CAST(row_number() OVER z AS INT) AS place FROM f WINDOW z AS (PARTITION BY claim_id ORDER BY rank) QUALIFY row_number() OVER z <= 3""",
)
def _(spark, sf):
    g = graded(spark, sf).select("key", F.col("lang").alias("book"))
    ranked = RT.rank_candidates(RT.union_corpora(("graded", aligned(spark, sf))), 40).join(g, "key")
    return RT.one_per_book(ranked, 3).select("claim_id", "key", "book", "place")


@R("set_1_union_of_candidates", f"WITH {RETRIEVAL} SELECT claim_id, CAST(key AS VARCHAR) AS key, 'graded' AS corpus FROM rk WHERE lexical_rank < 5 UNION ALL SELECT claim_id, CAST(key AS VARCHAR), 'again' FROM rk WHERE lexical_rank < 3")
def _(spark, sf):
    hits = bm25(spark, sf).select("claim_id", F.col("key").cast("string").alias("key"), "lexical_rank")
    return RT.union_corpora(("graded", hits.filter("lexical_rank < 5")), ("again", hits.filter("lexical_rank < 3"))).select("claim_id", "key", "corpus")
