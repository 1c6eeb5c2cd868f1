"""Documents as ordered segments: text, web pages, captions, timed lines."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import grams as G
from ..operators.intervals import near_pairs

MAX_SEGMENT, CHUNK = 900, 7000

# --------------------------------------------------------------------------- plain text


def refuse(docs: DataFrame, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with an error code): empty inputs are refused, and over-long ones where a size is asked for."""
    code = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_input")
    if max_chars is not None:
        code = code.when(F.length("text") > max_chars, "input_too_long")
    marked = docs.withColumn("error", code)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


def long_line_pieces(line: Column, limit: int = MAX_SEGMENT) -> Column:
    """Pieces of a line of at most ``limit`` characters: cut after the last sentence end beyond a third of the
    limit, else at the last blank, else at the limit. Each piece is one match of the pattern, so any length works.
    """
    sentence = rf".{{{limit // 3 + 1},{limit - 2}}}[.؟!](?= )"
    blank = rf".{{1,{limit - 1}}}(?= )"
    pattern = rf"(?s)[\s\p{{Z}}]*+(.{{1,{limit}}}\z|{sentence}|{blank}|.{{{limit}}})"
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    trimmed = F.transform(found, lambda p: strip(p))
    return F.when(F.length(line) <= limit, F.array(line)).otherwise(F.filter(trimmed, lambda p: p != ""))


def segments_from_text(docs: DataFrame, limit: int = MAX_SEGMENT) -> DataFrame:
    """(doc_id, seg_id, text): lines of the text, long ones cut. One narrow pass."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(X.clean_pasted(F.col("text")), "\r\n", "\n"), "\n"), lambda x: strip(x)), lambda x: x != "")
    pieces = F.flatten(F.transform(lines, lambda x: long_line_pieces(x, limit)))
    return docs.select("doc_id", F.posexplode(pieces).alias("seg_id", "text"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def full_text(segments: DataFrame) -> DataFrame:
    """Segments of a document joined by line ends, in order: (doc_id, text)."""
    return segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("s")).select(
        "doc_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text")
    )


def with_abs_start(segments: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("seg_id").rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("abs_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int"))


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, chunk_no, offset, text): pieces of at most ``size`` characters, cut at the last line or sentence end
    beyond half of it. The pieces are successive matches of one pattern; offsets are their running length.
    """
    half = size // 2
    cut = rf".{{{size - 1}}}[\n؟]|.{{{half + 1},{size - 2}}}(?:[\n؟]|\.(?= ))"
    pattern = rf"(?s)(?:.{{1,{size}}}\z|{cut}|.{{{size}}})"
    parts = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    p = F.when(F.length("text") <= size, F.array("text")).otherwise(parts)
    rows = G.once(docs.select("doc_id", "text"), "p", p).select("doc_id", "p", F.posexplode("p").alias("chunk_no", "chunk"))
    before = F.aggregate(F.slice("p", F.lit(1), F.col("chunk_no")), F.lit(0), lambda a, x: a + F.length(x))
    return rows.select("doc_id", "chunk_no", before.alias("offset"), F.col("chunk").alias("text"))


def strip_noise(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, removed): decorative symbols, repeated marks, footers, clock and decoration lines taken out."""
    lines = F.split(F.regexp_replace("text", "\r\n|\r", "\n"), "\n")

    def one(raw: Column, i: Column) -> Column:
        emoji = F.array_join(F.regexp_extract_all(raw, F.lit(V.EMOJI), F.lit(0)), "")
        line = F.regexp_replace(F.regexp_replace(raw, V.EMOJI, " "), V.REPEATED_MARK, "$1")
        line = strip(F.regexp_replace(line, r"[ \t]{2,}", " "))
        return F.struct(i.alias("i"), raw.alias("raw"), emoji.alias("emoji"), line.alias("line"))

    rows = G.once(docs.select("doc_id", "text"), "l", F.transform(lines, one))

    def judged(x: Column) -> Column:
        plain = X.squeeze(F.regexp_replace(F.lower(X.normalize_arabic(x["line"])), r"[^\p{L}\p{N}\s]", " "))
        ends = lambda p: (p != "") & (F.size(F.split(p, " ")) <= 10) & p.rlike("|".join(f"(?:{f})" for f in V.FOOTERS))
        footer = X.let(plain, ends)
        decoration = x["line"].rlike(V.DECORATION_LINE) & ~x["line"].contains("[?]")
        drop = (x["line"] != "") & (footer | x["line"].rlike(V.CLOCK_LINE) | decoration)

        def parts(drop: Column) -> Column:
            gone = F.when(drop, strip(x["raw"])).when(x["emoji"] != "", x["emoji"])
            # an empty line is kept once between paragraphs, not where only symbols stood
            keep = F.when(drop, F.lit(None)).when((x["line"] == "") & (x["emoji"] != ""), F.lit(None)).otherwise(x["line"])
            return F.struct(keep.alias("keep"), gone.alias("gone"))

        return X.let(drop, parts)

    rows = G.once(rows, "j", F.transform("l", judged))
    kept = F.array_join(F.filter(F.transform("j", lambda x: x["keep"]), lambda x: x.isNotNull()), "\n")
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"^\n+", ""), r"\n+$", "")
    return rows.select("doc_id", kept.alias("kept"), F.filter(F.transform("j", lambda x: x["gone"]), lambda x: x.isNotNull()).alias("removed"))


# --------------------------------------------------------------------------- web pages

# Elements whose content is not article text, and the named entities replaced.
DROPPED_ELEMENTS = ["script", "style", "nav", "header", "footer", "aside", "form", "noscript", "table"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
BLOCK_ENDS = r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/article|/section)[^>]*>"


def _entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def page_text(pages: DataFrame, min_chars: int = 80, max_chars: int | None = None) -> DataFrame:
    """(doc_id, url, title, text) of pages with at least ``min_chars`` of text; the title is the <title> element."""
    body = F.regexp_replace("html", r"(?s)<!--.*?-->", " ")
    for tag in DROPPED_ELEMENTS:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    body = F.regexp_replace(body, r"(?is)<head\b[^>]*>.*?</head>", " ")
    body = F.regexp_replace(F.regexp_replace(body, BLOCK_ENDS, "\n"), r"(?s)<[^>]*>", " ")
    body = F.regexp_replace(F.regexp_replace(_entities(body), r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    title = X.squeeze(_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    out = pages.select(F.col("page_id").alias("doc_id"), "url", title.alias("title"), strip(body).alias("text"))
    kept = F.col("text") if max_chars is None else F.substr("text", F.lit(1), F.lit(max_chars))
    return out.filter(F.length("text") >= min_chars).withColumn("text", X.clean_pasted(kept))


# --------------------------------------------------------------------------- captions and timed lines


def pick_tracks(items: DataFrame) -> DataFrame:
    """Best caption track per item: manual before automatic, the item's language before the default, the original
    track first, then the shorter language code. ``items``: (item, language, tracks array<struct<lang,manual,ext,url>>).
    """
    t = items.select("item", F.split_part(F.coalesce("language", F.lit("")), F.lit("-"), F.lit(1)).alias("own"), F.explode("tracks").alias("t"))
    base = F.regexp_replace("t.lang", "-.*$", "")
    t = t.withColumn("lang_rank", F.when(~F.col("own").isin("", "ar") & (base == F.col("own")), 0).when(base == "ar", 1))
    t = t.filter(F.col("lang_rank").isNotNull() & (F.col("t.ext") == "json3") & F.col("t.url").isNotNull())
    w = W.partitionBy("item").orderBy(F.desc("t.manual"), "lang_rank", F.desc(F.col("t.lang").endswith("-orig").cast("int")), F.length("t.lang"), "t.lang")
    best = t.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return best.select("item", "t.lang", "t.url", F.when(F.col("t.manual"), "captions").otherwise("auto-captions").alias("origin"))


def caption_segments(files: DataFrame, schema) -> DataFrame:
    """(doc_id, seg_id, text, start_s, end_s) from caption JSON: appended events skipped, ends clamped to the next start."""
    ev = files.select("doc_id", F.from_json("json", schema).alias("j")).select("doc_id", F.posexplode("j.events").alias("n", "e"))
    ev = ev.filter((F.coalesce("e.aAppend", F.lit(0)) == 0) & F.col("e.segs").isNotNull())
    joined = F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    start = F.coalesce("e.tStartMs", F.lit(0)) / 1000.0
    rows = ev.select("doc_id", "n", strip(F.regexp_replace(joined, "\n", " ")).alias("text"), start.alias("start_s"), (start + F.coalesce("e.dDurationMs", F.lit(0)) / 1000.0).alias("raw_end")).filter("text != ''")
    w = W.partitionBy("doc_id").orderBy("n")
    return rows.select(
        "doc_id", (F.row_number().over(w) - 1).alias("seg_id"), "text", "start_s", F.coalesce(F.least("raw_end", F.lead("start_s").over(w)), F.col("raw_end")).alias("end_s")
    )


def clean_times(segments: DataFrame, offset: float = 0.0, limit: float | None = None) -> DataFrame:
    """Times made usable: shifted, ordered, clamped to the limit, not overlapping.

    Starting no earlier than every earlier end is a running maximum, so no row waits for its predecessor.
    """
    cap = (lambda c: F.least(c, F.lit(float(limit)))) if limit is not None else (lambda c: c)
    rows = segments.withColumn("text", X.squeeze(F.col("text"))).filter("text != ''")
    s0 = cap(F.greatest(F.lit(0.0), F.col("start_s").cast("double")))
    e0 = F.greatest(s0, cap(F.greatest(F.greatest(F.lit(0.0), F.col("start_s")), F.col("end_s")).cast("double")))
    w = W.partitionBy("doc_id").orderBy("seg_id").rowsBetween(W.unboundedPreceding, -1)
    timed = rows.withColumn("s0", s0).withColumn("e0", e0)
    begin = F.greatest(F.col("s0"), F.coalesce(F.max("e0").over(w), F.lit(0.0)))
    timed = timed.withColumn("s1", begin).withColumn("e1", F.greatest("s1", "e0"))
    return timed.select("doc_id", "seg_id", "text", F.round(F.col("s1") + offset, 2).alias("start_s"), F.round(F.col("e1") + offset, 2).alias("end_s"))


def gap_groups(segments: DataFrame, max_gap: float = 2.5) -> DataFrame:
    """Segments with the number of their group: a new group begins after a pause longer than ``max_gap`` seconds."""
    w = W.partitionBy("doc_id").orderBy("seg_id")
    pause = F.coalesce(F.col("start_s") - F.lag("end_s").over(w) > max_gap, F.lit(True))
    return segments.withColumn("gap", pause.cast("int")).withColumn("gap_no", F.sum("gap").over(w)).drop("gap")


def merge_segments(segments: DataFrame, max_chars: int = 320, max_seconds: float = 30.0, max_gap: float = 2.5) -> DataFrame:
    """Readable paragraphs: short timed lines joined greedily under the length, span and pause bounds.

    A long pause always ends a paragraph, so each pause-free stretch is folded by itself.
    """
    rows = segments.withColumn("text", X.squeeze(F.col("text"))).filter("text != ''")
    shape = "array<struct<text:string,start_s:double,end_s:double>>"
    item = F.struct("seg_id", "text", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (
            (x["start_s"] - last["end_s"] <= max_gap)
            & (F.length(last["text"]) + F.length(x["text"]) + 1 <= max_chars)
            & (F.coalesce(x["end_s"], x["start_s"]) - F.coalesce(last["start_s"], F.lit(0.0)) <= max_seconds)
        )
        joined = F.struct(F.concat_ws(" ", last["text"], x["text"]).alias("text"), last["start_s"].alias("start_s"), F.coalesce(x["end_s"], last["end_s"]).alias("end_s"))
        single = F.struct(x["text"].alias("text"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s"))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(single)))

    folded = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(shape), step)
    merged = gap_groups(rows, max_gap).groupBy("doc_id", "gap_no").agg(folded.alias("m")).select("doc_id", "gap_no", F.posexplode("m").alias("k", "s"))
    w = W.partitionBy("doc_id").orderBy("gap_no", "k")
    return merged.select("doc_id", (F.row_number().over(w) - 1).alias("seg_id"), "s.text", "s.start_s", "s.end_s")


# --------------------------------------------------------------------------- offsets -> segments


def locate(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment and time of each claim: the last segment that starts at or before the claim (an as-of join).

    ``claims``: (claim_id, doc_id, start, end); ``segments``: (doc_id, seg_id, text, abs_start[, start_s, end_s]).
    The two are interleaved by offset and the latest segment is carried forward, one sort per document.
    """
    seg = segments.select("doc_id", F.col("abs_start").alias("at"), F.lit(0).alias("is_claim"), F.struct("seg_id", "abs_start", F.length("text").alias("n"), "start_s", "end_s").alias("seg"))
    cl = claims.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("is_claim"), "claim_id", "start", "end")
    w = W.partitionBy("doc_id").orderBy("at", "is_claim").rowsBetween(W.unboundedPreceding, 0)
    both = seg.unionByName(cl, allowMissingColumns=True).withColumn("s", F.last("seg", ignorenulls=True).over(w)).filter("is_claim = 1 and s is not null")
    a = F.greatest(F.lit(0), F.col("start") - F.col("s.abs_start"))
    b = F.least(F.col("s.n"), F.col("end") - F.col("s.abs_start"))
    b = F.when(b <= a, F.col("s.n")).otherwise(b)
    seconds = F.col("s.start_s") + a / F.greatest(F.lit(1), F.col("s.n")) * F.greatest(F.lit(0.0), F.coalesce("s.end_s", "s.start_s") - F.col("s.start_s"))
    return both.select("claim_id", "doc_id", "s.seg_id", a.alias("seg_start"), b.alias("seg_end"), F.round(seconds, 1).alias("at_s"), F.col("s.end_s").alias("until_s"))


def locate_all(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Every segment a claim covers: (claim_id, doc_id, seg_id, seg_start, seg_end)."""
    seg = segments.select("doc_id", "seg_id", "text", F.col("abs_start").alias("start"), (F.col("abs_start") + F.length("text")).alias("end"))
    pairs = near_pairs(claims.select("doc_id", "claim_id", "start", "end"), seg.filter(F.length("text") > 0), left="c_", right="s_")
    a = F.greatest("c_start", "s_start") - F.col("s_start")
    b = F.least("c_end", "s_end") - F.col("s_start")
    covered = pairs.withColumn("a", a).withColumn("b", b).filter(F.trim(F.substr("s_text", F.col("a") + 1, F.col("b") - F.col("a"))) != "")
    return covered.select(F.col("c_claim_id").alias("claim_id"), "doc_id", F.col("s_seg_id").alias("seg_id"), F.col("a").alias("seg_start"), F.col("b").alias("seg_end"))
