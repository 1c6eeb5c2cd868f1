"""Sources and sinks over the driver's tables."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as SC
from ..functions import text as X
from ..operators import grams as G
from ..session import new_folder
from ..sources import corpora as CO
from ..sources import segments as SEG
from ..sources import stores as ST
from .common import *  # noqa: F403
from .common import Registry
from .text_queries import rfind_sql

R = Registry()


@R(
    "src_1_canon_load",
    r"SELECT CAST(item_id // 8 + 1 AS INT) AS group_no, CAST(item_id % 8 + 1 AS INT) AS unit_no, CASE WHEN item_id % 8 = 0 AND item_id // 8 + 1 NOT IN (1, 9) THEN trim(regexp_replace(text, '[\s\pZ]+', ' ', 'g')) ELSE trim(text) END AS text_match FROM benchmark",
)
def _(spark, sf):
    u = canon_units(spark, sf)
    formula = u.filter("group_no = 1 and unit_no = 1").select("text_match").scalar()
    opened = F.when((F.col("unit_no") == 1) & ~F.col("group_no").isin(1, 9), F.concat_ws(" ", formula, "text_match")).otherwise(F.col("text_match"))
    lines = u.select(F.concat_ws("|", "group_no", "unit_no", opened).alias("value"))
    noise = lines.limit(1).select(F.explode(F.array(F.lit("# header"), F.lit("  "))).alias("value"))
    rows = CO.pipe_rows(lines.unionByName(noise))
    return CO.canon_from_rows(rows, rows, SCRIPT).select("group_no", "unit_no", "text_match")


def _ungraded(spark, sf):
    d = documents(spark, sf, "lang")
    num = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("n"), "doc_id")).otherwise(F.concat(F.lit(" "), "doc_id"))
    return CO.ungraded_rows(d.select(F.col("lang").alias("book"), num.alias("num_text"), "text"), SCRIPT)


@R("src_2_ungraded_load", f"SELECT lang AS book, CAST(doc_id AS INT) AS num, {norm_sql('text')} AS norm FROM documents WHERE doc_id % 7 <> 0 AND {norm_sql('text')} <> ''")
def _(spark, sf):
    return _ungraded(spark, sf).select("book", "num", "norm")


@R("src_2_count_per_book", f"SELECT lang AS book, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 AND {norm_sql('text')} <> '' GROUP BY lang")
def _(spark, sf):
    return CO.count_per_book(_ungraded(spark, sf))


@R("src_3_graded_load", f"WITH {GRADED} SELECT CAST(key AS VARCHAR) AS key, grade_class AS grade, attribution AS ref, length(text) AS n, CASE WHEN lang = 'en' THEN length(text) END AS n_en FROM graded")
def _(spark, sf):
    g = graded(spark, sf)
    en = F.when(F.col("lang") == "en", F.struct(F.col("text").alias("hadeeth")))
    rec = F.struct(F.col("key").cast("string").alias("id"), F.col("text").alias("hadeeth"), "attribution", F.concat(F.lit(" "), "grade_class").alias("grade"), en.alias("en"))
    raw = g.select(F.to_json(F.struct(F.array(rec).alias("hadeeths"))).alias("json")).select(F.from_json("json", SC.GRADED_FILE).alias("j")).select("j.*")
    return CO.graded_rows(raw).select("key", "grade", "ref", F.length("text").cast("bigint").alias("n"), F.length("en.hadeeth").cast("bigint").alias("n_en"))


@R(
    "src_4_titled_pages",
    r"""WITH p AS (SELECT page_id AS pos, trim(url) AS url, regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/([^/?#]+)', 2) AS lang,
      regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/([^/?#]+)', 3) AS id FROM pages),
    r AS (SELECT lang AS collection, host || ' ' || lang AS title, lang || '-' || substr(id, 1, 2) AS uid, url, row_number() OVER (PARTITION BY lang || '-' || substr(id, 1, 2) ORDER BY pos) AS rn FROM p WHERE length(host || ' ' || lang) >= 8)
    SELECT collection, title, uid, url FROM r WHERE rn = 1""",
)
def _(spark, sf):
    part = lambda i: F.regexp_extract("url", CO.SITE_PAGE, i)
    urls = table(spark, sf, "pages").select("url", F.col("page_id").alias("pos"))
    return CO.titled_pages(urls, part(2), F.concat_ws(" ", part(1), part(2)), F.concat_ws("-", part(2), F.substr(part(3), F.lit(1), F.lit(2))))


_S = "left(rest, 900)"
_BEST = f"greatest({rfind_sql(_S, '. ')}, {rfind_sql(_S, '؟ ')}, {rfind_sql(_S, '! ')})"
_LEN = f"CASE WHEN length(rest) <= 900 THEN length(rest) WHEN {_BEST} > 300 THEN {_BEST} + 1 WHEN {rfind_sql(_S, ' ')} > 0 THEN {rfind_sql(_S, ' ')} ELSE 900 END"
_TRIM = r"'^[\s\pZ]+|[\s\pZ]+$', '', 'g'"
SEGMENTS_SQL = f"""l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM l0),
    l2 AS (SELECT doc_id, k, regexp_replace(line, {_TRIM}) AS rest FROM l1),
    cut(doc_id, k, m, piece, rest) AS (SELECT doc_id, k, 0, left(rest, {_LEN}), substr(rest, {_LEN} + 1) FROM l2 WHERE rest <> ''
      UNION ALL SELECT doc_id, k, m + 1, left(rest, {_LEN}), substr(rest, {_LEN} + 1) FROM (SELECT doc_id, k, m, regexp_replace(rest, {_TRIM}) AS rest FROM cut) WHERE rest <> ''),
    segs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, m) - 1 AS seg_id, regexp_replace(piece, {_TRIM}) AS text FROM cut)"""


@R("src_5_segments", f"WITH RECURSIVE {SEGMENTS_SQL} SELECT doc_id, CAST(seg_id AS INT) AS seg_id, text FROM segs")
def _(spark, sf):
    return SEG.segments_from_text(documents(spark, sf))


@R("src_5_refused_inputs", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty_input' ELSE 'input_too_long' END AS error FROM documents WHERE trim(text) = '' OR length(text) > 5000")
def _(spark, sf):
    return SEG.refuse(documents(spark, sf), 5000)[1].select("doc_id", "error")


def _page_sql() -> str:
    body = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in SEG.DROPPED_ELEMENTS + ["head"]:
        body = rf"regexp_replace({body}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    body = rf"regexp_replace(regexp_replace({body}, '{SEG.BLOCK_ENDS}', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"
    ent = lambda c: "".join("replace(" for _ in SEG.ENTITIES) + c + "".join(f", '{a}', {'chr(39)' if b == chr(39) else repr(b)})".replace("'\"'", "chr(34)") for a, b in SEG.ENTITIES)
    body = rf"regexp_replace(regexp_replace({ent(body)}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    title = ent(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    return rf"""WITH p AS (SELECT page_id AS doc_id, url, trim(regexp_replace({title}, '[\s\pZ]+', ' ', 'g')) AS title, regexp_replace({body}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS text FROM pages)
    SELECT doc_id, url, title, text FROM p WHERE length(text) >= 80"""


@R("src_6_page_text", _page_sql())
def _(spark, sf):
    return SEG.page_text(G.spread(table(spark, sf, "pages")))


@R(
    "src_7_caption_segments",
    rf"""WITH c AS (SELECT conv_id AS doc_id, turn, regexp_replace(replace(text, chr(10), ' '), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS text, turn * 3.0 AS s, turn * 3.0 + (2500 + length(text)) / 1000.0 AS e FROM conversations WHERE turn % 5 <> 4)
    SELECT doc_id, CAST(row_number() OVER z - 1 AS INT) AS seg_id, text, CAST(s AS DOUBLE) AS start_s, CAST(least(e, coalesce(lead(s) OVER z, e)) AS DOUBLE) AS end_s FROM c WHERE text <> '' WINDOW z AS (PARTITION BY doc_id ORDER BY turn)""",
)
def _(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    segs = F.array(F.struct(F.substr("text", F.lit(1), half).alias("utf8")), F.struct(F.substr("text", half + 1).alias("utf8")))
    ev = F.struct(
        (F.col("turn") * 3000).alias("tStartMs"), (2500 + F.length("text")).cast("bigint").alias("dDurationMs"), F.when(F.col("turn") % 5 == 4, 1).alias("aAppend"), segs.alias("segs"), "turn"
    )
    files = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(ev), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("events"))
    return SEG.caption_segments(files.select(F.col("conv_id").alias("doc_id"), F.to_json(F.struct("events")).alias("json")), SC.CAPTION_FILE)


def _lines(spark, sf):
    """Events as timed lines of one text per user, in minutes."""
    e = table(spark, sf, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    minutes = F.col("ts").cast("timestamp").cast("double") / 60
    return e.select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("seg_id"), F.col("event_type").alias("text"), minutes.alias("start_s"), (minutes + F.col("value")).alias("end_s"))


LINES = "tl AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_id, event_type AS text, epoch_us(ts) / 1e6 / 60 AS s, epoch_us(ts) / 1e6 / 60 + value AS e FROM events)"


@R(
    "src_8_merge_segments",
    f"""WITH RECURSIVE {LINES}, m(doc_id, seg_id, text, s, e, grp) AS (SELECT doc_id, seg_id, text, s, e, 0 FROM tl WHERE seg_id = 0
      UNION ALL SELECT doc_id, seg_id, CASE WHEN fits THEN mt || ' ' || text ELSE text END, CASE WHEN fits THEN ms ELSE s END, e, CASE WHEN fits THEN grp ELSE grp + 1 END
      FROM (SELECT t.*, m.text AS mt, m.s AS ms, m.grp, t.s - m.e <= 600 AND length(m.text) + length(t.text) + 1 <= 40 AND t.e - m.s <= 3000 AS fits FROM m JOIN tl t ON t.doc_id = m.doc_id AND t.seg_id = m.seg_id + 1)),
    o AS (SELECT doc_id, grp, max(seg_id) AS last, max_by(text, seg_id) AS text, max_by(s, seg_id) AS s, max_by(e, seg_id) AS e FROM m GROUP BY doc_id, grp)
    SELECT doc_id, CAST(grp AS INT) AS seg_id, text, round(s, 3) AS start_s, round(e, 3) AS end_s FROM o""",
)
def _(spark, sf):
    m = SEG.merge_segments(_lines(spark, sf), max_chars=40, max_seconds=3000.0, max_gap=600.0)
    return m.select("doc_id", "seg_id", "text", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


@R(
    "src_8_pause_groups",
    f"WITH {LINES}, g AS (SELECT *, CASE WHEN s - lag(e) OVER z <= 600 THEN 0 ELSE 1 END AS gap FROM tl WINDOW z AS (PARTITION BY doc_id ORDER BY seg_id)) "
    "SELECT doc_id, CAST(n AS BIGINT) AS gap_no, count(*) AS lines FROM (SELECT doc_id, sum(gap) OVER (PARTITION BY doc_id ORDER BY seg_id) AS n FROM g) GROUP BY doc_id, n",
)
def _(spark, sf):
    return SEG.gap_groups(_lines(spark, sf), 600.0).groupBy("doc_id", "gap_no").agg(F.count("*").alias("lines"))


@R(
    "src_9_clean_times",
    """WITH r AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_id, event_type AS text, CAST(json_extract(props, '$.k') AS DOUBLE) - 10 AS s, CAST(json_extract(props, '$.k') AS DOUBLE) - 10 + value AS e FROM events),
    c AS (SELECT *, least(greatest(0.0, s), 80.0) AS s0, greatest(least(greatest(0.0, s), 80.0), least(greatest(greatest(0.0, s), e), 80.0)) AS e0 FROM r),
    t AS (SELECT *, greatest(s0, coalesce(max(e0) OVER (PARTITION BY doc_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS s1 FROM c)
    SELECT doc_id, CAST(seg_id AS INT) AS seg_id, text, round(s1 + 5, 2) AS start_s, round(greatest(s1, e0) + 5, 2) AS end_s FROM t""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double") - 10
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("seg_id"), F.col("event_type").alias("text"), k.alias("start_s"), (k + F.col("value")).alias("end_s"))
    return SEG.clean_times(rows, offset=5.0, limit=80.0)


@R("src_10_label_lines", f"WITH {GRADED} SELECT CAST(key AS VARCHAR) AS id, grade_class AS category, length(text) AS n FROM graded")
def _(spark, sf):
    g = graded(spark, sf).select(F.col("key").cast("string").alias("id"), F.col("text").alias("input_text"), F.col("grade_class").alias("category"))
    lines = g.select(F.to_json(F.struct("*")).alias("line"))
    return lines.select(F.from_json("line", SC.TESTSET).alias("r")).select("r.id", "r.category", F.length("r.input_text").cast("bigint").alias("n"))


@R(
    "src_11_report",
    f"""WITH RECURSIVE {VERDICTS}, {SEGMENTS_SQL}, s AS (SELECT doc_id // 5 AS doc_id, count(*) AS n_segments FROM segs GROUP BY 1),
    v AS (SELECT doc_id, count(*) AS total, count(*) FILTER (state = 'supported') AS supported, arg_min(claim_id, start * 10 + idx) AS first_claim FROM verdicts GROUP BY doc_id)
    SELECT s.doc_id, n_segments, coalesce(total, 0) AS total, coalesce(supported, 0) AS supported, first_claim FROM s LEFT JOIN v USING (doc_id)""",
)
def _(spark, sf):
    segs = SEG.segments_from_text(documents(spark, sf)).withColumn("doc_id", F.floor(F.col("doc_id") / 5))
    r = ST.report(verdict_rows(spark, sf).select("doc_id", "start", "index", "claim_id", "state"), segs)
    return r.select(
        "doc_id", F.size("segments").cast("bigint").alias("n_segments"), "total", F.coalesce(F.try_element_at("by_state", F.lit("supported")), F.lit(0)).alias("supported"),
        F.get("verdicts", F.lit(0))["claim_id"].alias("first_claim"),
    )


@R("src_12_call_log_days", f"WITH {CALLS} SELECT day, count(*) AS n, round(sum(cost_usd), 4) AS cost FROM calls GROUP BY day")
def _(spark, sf):
    rows, path = calls(spark, sf), new_folder(spark, "calls")
    for part in (0, 1, 2, 1):  # three batches, one of them written again as after a failure
        ST.append_calls(rows.filter(F.col("call_id") % 3 == part), path, part)
    return ST.read_calls(spark, path, rows.schema).groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost"))


ENTRIES = "en AS (SELECT 'q:' || sha256(event_type || chr(31) || CAST(user_id AS VARCHAR)) AS k, CAST(event_id AS VARCHAR) AS v, epoch_us(ts) / 1e6 AS t FROM events)"


@R(
    "src_13_cache_upsert",
    f"WITH {ENTRIES}, m AS (SELECT k, arg_max(v, t) AS v, max(t) AS t FROM en GROUP BY k) SELECT k, v, round(t, 3) AS t FROM m WHERE 1706659200.0 - t <= 86400 * 3",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(ST.cache_key("q", F.col("event_type"), F.col("user_id").cast("string")).alias("k"), F.col("event_id").cast("string").alias("v"), F.col("ts").cast("timestamp").cast("double").alias("t"), "event_id")
    old, new = rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id")
    path = new_folder(spark, "cache")
    for batch in (old, new, old):  # written again, older values change nothing
        ST.upsert_stored(batch, path, 8)
    fresh = ST.read_fresh(ST.read_entries(spark, path), F.lit(1706659200.0), 86400 * 3)
    return fresh.select("k", "v", F.round("t", 3).alias("t"))


@R("src_14_snapshot", "SELECT strftime(max(ts), '%Y.%m.%d') || ' · benchmark ' || (SELECT count(*) FROM benchmark) || ' · documents ' || (SELECT count(*) FROM documents) AS data_version FROM events")
def _(spark, sf):
    newest = table(spark, sf, "events").agg(F.max("ts")).scalar()
    return CO.snapshot({"documents": table(spark, sf, "documents"), "benchmark": table(spark, sf, "benchmark")}, newest)


@R(
    "src_15_merge_results",
    "SELECT event_type || '-' || user_id AS label, CASE WHEN bool_or(event_id % 3 = 0) THEN 1 ELSE 0 END AS run, CASE WHEN bool_or(event_id % 3 = 0) THEN count(*) FILTER (event_id % 3 = 0) ELSE count(*) END AS n FROM events GROUP BY 1",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("label", F.concat_ws("-", "event_type", "user_id"))
    run = lambda df, n: df.groupBy("label").agg(F.count("*").alias("n")).withColumn("run", F.lit(n))
    return ST.merge_results(run(e.filter("event_id % 3 <> 0"), 0), run(e.filter("event_id % 3 = 0"), 1))


@R(
    "win_12_pick_tracks",
    """WITH t AS (SELECT user_id AS item, event_type AS lang, event_id % 2 = 0 AS manual, event_id, CASE WHEN user_id % 3 = 0 THEN 'view' ELSE 'click' END AS own FROM events),
    r AS (SELECT item, lang, manual, event_id, CASE WHEN lang = own THEN 0 WHEN lang = 'search' THEN 1 END AS lr FROM t),
    b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY manual DESC, lr, event_id) AS rn FROM r WHERE lr IS NOT NULL)
    SELECT item, CASE WHEN manual THEN 'captions' ELSE 'auto-captions' END AS origin, lr AS lang_rank FROM b WHERE rn = 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    lang = F.when(F.col("event_type") == "search", "ar").otherwise(F.col("event_type"))
    own = F.when(F.col("user_id") % 3 == 0, "view").otherwise("click")
    t = e.select(F.col("user_id").alias("item"), own.alias("language"), F.array(F.struct(lang.alias("lang"), (F.col("event_id") % 2 == 0).alias("manual"), F.lit("json3").alias("ext"), F.col("event_id").cast("string").alias("url"))).alias("tracks"))
    best = SEG.pick_tracks(t)
    return best.select("item", "origin", F.when(F.col("lang") == "ar", 1).otherwise(0).alias("lang_rank"))
