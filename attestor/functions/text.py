"""Text normalisation, tokens, stems and cleaning as column expressions.

Three word scripts are used throughout: ``arabic`` (letter folds, marks removed), ``latin`` (lower case,
punctuation removed) and ``latin_ascii`` (``latin`` with accented letters folded to plain ones).
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V

_BREAK = f"[{V.WORD_BREAKS}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda would compute an outer expression once per element."""
    return F.transform(F.array(value), body)[0]


RUN = 128  # values per block of a running total, characters per block of a chunked text


def running_totals(ns: Column) -> Column:
    """Totals up to and including each value of an array of ints; blocks keep the work near linear in its length."""
    none = F.array().cast("array<int>")
    add = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))

    def joined(x: Column) -> Column:
        ends = F.aggregate(F.transform(x, lambda b: F.element_at(b, F.lit(-1))), none, add)
        return let(F.struct(x.alias("x"), ends.alias("e")), lambda y: F.flatten(F.transform(y["x"], lambda b, i: F.transform(b, lambda v: v + F.when(i > 0, F.get(y["e"], i - 1)).otherwise(0)))))

    def blocks(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), F.lit(RUN))
        return let(F.transform(starts, lambda i: F.aggregate(F.slice(x, i, F.lit(RUN)), none, add)), joined)

    return let(ns, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(none))


def chunked(text: Column) -> Column:
    """The text in blocks of ``RUN`` characters, so that a place in it is reached without a pass over what comes before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0))


def chars(chunks: Column, at: Column, n: Column) -> Column:
    """``n`` characters (none if negative) of a chunked text from the 0-based place ``at``."""
    first = F.floor(at / RUN).cast("int")
    count = F.greatest(F.lit(0), F.floor((at + n - 1) / RUN).cast("int") - first + 1)
    return F.substr(F.array_join(F.slice(chunks, first + 1, count), ""), at - first * RUN + 1, n)


def rest_from(chunks: Column, at: Column, near: int | None = None) -> Column:
    """A chunked text from the 0-based place ``at``: all of it, or ``near`` blocks after the one it stands in."""
    first = F.floor(at / RUN).cast("int")
    if near is None:
        text = F.array_join(F.slice(chunks, first + 1, F.greatest(F.lit(0), F.size(chunks) - first)), "")
    else:
        text = F.concat(*[F.coalesce(F.get(chunks, first + k), F.lit("")) for k in range(near + 1)])
    return F.substr(text, at - first * RUN + 1)


def leading(chunks: Column, at: Column, pattern: str, near: int = 2) -> Column:
    """Length of the match of ``pattern``, a run of single characters from the start, at the place ``at`` of a chunked text."""
    n = lambda t: F.length(F.regexp_extract(t, pattern, 0))
    reached = lambda k: F.floor(at / RUN) * RUN + (near + 1) * RUN - at <= k
    return let(n(rest_from(chunks, at, near)), lambda k: F.when(reached(k), n(rest_from(chunks, at))).otherwise(k))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility form. Spark has no built-in, so it is an optional step before the others."""
    for s in batches:
        yield s.str.normalize("NFKC")


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, V.CONTROLS, ""), V.DIACRITICS, "")


def normalize_arabic(text: Column, drop_honorifics: bool = False, compat: bool = False) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), V.LIGATURES, " ")
    if compat:
        out = nfkc(out)
    out = F.translate(strip_marks(out), V.ARABIC_FROM, V.ARABIC_TO)
    # the words are taken out, not the rest replaced: that is the shorter way on text in other letters
    out = F.array_join(F.regexp_extract_all(out, F.lit("[ء-ي]+"), F.lit(0)), " ")
    if drop_honorifics:
        out = squeeze(F.regexp_replace(out, V.HONORIFICS, " "))
    return out


def normalize_latin(text: Column, ascii_fold: bool = False, compat: bool = False) -> Column:
    text = F.coalesce(text, F.lit(""))
    out = F.lower(nfkc(text) if compat else text)
    if ascii_fold:
        out = F.translate(out, V.LATIN_FROM, V.LATIN_TO)
    return squeeze(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]+", " "))


def normalize(text: Column, script: str, drop_honorifics: bool = False) -> Column:
    if script == "arabic":
        return normalize_arabic(text, drop_honorifics)
    return normalize_latin(text, ascii_fold=script == "latin_ascii")


def tokens(text: Column, script: str, drop_honorifics: bool = False) -> Column:
    """Words of the normal form; an empty text has no words."""
    return F.array_remove(F.split(normalize(text, script, drop_honorifics), " "), "")


def arabic_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    arabic = F.regexp_count(text, F.lit(r"[\p{L}&&[؀-ۿ]]"))
    return F.when(letters > 0, arabic / letters).otherwise(F.lit(0.0))


def is_arabic(text: Column) -> Column:
    return arabic_ratio(text) >= 0.5


# --------------------------------------------------------------------------- words and offsets


def _piece_norm(text: Column, script: str) -> Column:
    """Whole-text form in which every break-delimited piece has become its own normal word."""
    if script == "arabic":
        out = F.regexp_replace(F.coalesce(text, F.lit("")), V.LIGATURES, "")
        out = F.translate(strip_marks(F.regexp_replace(out, f"{_BREAK}+", " ")), V.ARABIC_FROM, V.ARABIC_TO)
        return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^ء-ي ]+", ""), " +", " "))
    out = F.lower(F.coalesce(text, F.lit("")))
    if script == "latin_ascii":
        out = F.translate(out, V.LATIN_FROM, V.LATIN_TO)
    out = F.regexp_replace(F.regexp_replace(out, f"{_BREAK}+", " "), r"[^\p{L}\p{N}_ ]", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def _norm_of_pieces(text: Column, script: str) -> Column:
    """Normal form of every break-delimited piece, '' where nothing is left; the first is '' if the text begins with a break."""
    out = F.regexp_replace(text, f"{_BREAK}+", " ")
    if script == "arabic":
        return F.split(F.regexp_replace(F.translate(strip_marks(out), V.ARABIC_FROM, V.ARABIC_TO), r"[^ء-ي ]+", ""), " ")
    out = F.lower(out)
    if script == "latin_ascii":
        out = F.translate(out, V.LATIN_FROM, V.LATIN_TO)
    return F.split(F.regexp_replace(out, r"[^\p{L}\p{N}_ ]", ""), " ")


def words(text: Column, script: str) -> Column:
    """Normal words in text order; pieces without a letter are skipped. One pass over the whole text."""
    return F.array_remove(F.split(_piece_norm(text, script), " "), "")


def pieces(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{_BREAK}+", -1), "")


def _has_word(p: Column, script: str) -> Column:
    if script == "arabic":
        return F.regexp_replace(F.translate(strip_marks(p), V.ARABIC_FROM, V.ARABIC_TO), r"[^ء-ي]", "") != ""
    return p.rlike(r"[\p{L}\p{N}_]")


def _kept(text: Column, script: str) -> Column:
    """The pieces that carry a word, judged in one pass over the whole text."""
    text = F.coalesce(text, F.lit(""))
    parts = F.struct(pieces(text).alias("p"), _norm_of_pieces(text, "arabic" if script == "arabic" else "latin").alias("w"), F.when(text.rlike(f"^{_BREAK}"), 1).otherwise(0).alias("lead"))
    return let(parts, lambda x: F.filter(x["p"], lambda p, i: F.get(x["w"], i + x["lead"]) != ""))


def _kept_pieces(text: Column, script: str) -> Column:
    """1-based numbers of the pieces that carry a word."""
    flagged = F.transform(pieces(text), lambda p, i: F.when(_has_word(p, script), i + 1))
    return F.filter(flagged, lambda i: i.isNotNull())


def word_span_offsets(text: Column, first: Column, last: Column, script: str) -> Column:
    """struct(start, end): character offsets (0-based, end exclusive) of words ``first``..``last``.

    Called for located runs only, so its cost is one prefix sum per run, not per word of the corpus.
    """
    ps, gaps = pieces(text), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{_BREAK}+"), F.lit(0))
    lead = F.when(text.rlike(f"^{_BREAK}"), 1).otherwise(0)
    kept = _kept_pieces(text, script)

    def before(n: Column, also: Column) -> Column:
        """Characters up to the end of piece ``n`` (also=0) or to its start (also=1)."""
        total = lambda arr, k: F.aggregate(F.slice(arr, F.lit(1), F.greatest(k, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x))
        return total(ps, n - also) + total(gaps, n - 1 + lead)

    p1, p2 = F.element_at(kept, first.cast("int") + 1), F.element_at(kept, last.cast("int") + 1)
    return F.struct(before(p1, F.lit(1)).alias("start"), before(p2, F.lit(0)).alias("end"))


def words_with_offsets(docs: DataFrame, script: str) -> DataFrame:
    """(doc_id, k, start, end, original, norm): every word with its character offsets.

    Pieces and the gaps before them are laid side by side inside the row; the offset is their running length, and the
    normal forms are taken off the whole text, piece for piece.
    """
    gaps = F.regexp_extract_all(F.col("text"), F.lit(f"{_BREAK}+"), F.lit(0))
    led = F.col("text").rlike(f"^{_BREAK}")
    before = F.when(led, gaps).otherwise(F.concat(F.array(F.lit("")), gaps))
    parts = F.struct(pieces(F.col("text")).alias("p"), before.alias("g"), _norm_of_pieces(F.col("text"), script).alias("w"), F.when(led, 1).otherwise(0).alias("lead"))
    ends = lambda x: running_totals(F.transform(x["p"], lambda p, i: F.length(p) + F.length(F.get(x["g"], i))))

    def laid(x: Column) -> Column:
        return let(
            F.struct(x.alias("x"), ends(x).alias("e")),
            lambda y: F.transform(y["x"]["p"], lambda p, i: F.struct(p.alias("p"), (F.length(p) + F.length(F.get(y["x"]["g"], i))).alias("n"), F.get(y["e"], i).alias("end"), F.get(y["x"]["w"], i + y["x"]["lead"]).alias("norm"))),
        )

    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(let(parts, laid)).alias("k", "z"))
    at = lambda df, end: df.filter("z.norm != ''").select("doc_id", "k", (end - F.length("z.p")).alias("start"), end.alias("end"), F.col("z.p").alias("original"), F.col("z.norm").alias("norm"))
    # rows with one id are one document, their pieces in order of place
    again = docs.groupBy("doc_id").agg(F.count("*").alias("copies")).filter("copies > 1").select("doc_id")
    one = rows.join(again, rows["doc_id"].eqNullSafe(again["doc_id"]), "left_anti")
    more = rows.join(again, rows["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    run = F.sum("z.n").over(W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return at(one, F.col("z.end").cast("long")).unionByName(at(more.withColumn("total", run), F.col("total")))


def kept_positions(ws: Column) -> Column:
    """1-based positions of the words left after the formulas of respect are removed.

    The remaining text must be a subsequence of the words; where a formula cut into a word it is not, and all stay.
    """
    left = F.filter(F.split(normalize_arabic(F.array_join(ws, " "), drop_honorifics=True), " "), lambda w: w != "")

    def walk(x: Column) -> Column:
        # only words left out are noted, as many as are missing: with more of them the rest is no subsequence
        n_out = F.size(x["ws"]) - F.size(x["left"])
        out = F.aggregate(
            x["ws"],
            F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")),
            lambda a, w: F.when(F.get(x["left"], a["n"]) == w, F.struct((a["n"] + 1).alias("n"), a["out"].alias("out"))).when(
                F.size(a["out"]) <= n_out, F.struct(a["n"].alias("n"), F.concat(a["out"], F.array(a["n"] + F.size(a["out"]) + 1)).alias("out"))
            ).otherwise(a),
        )
        everything = F.when(F.size(x["ws"]) > 0, F.sequence(F.lit(1), F.size(x["ws"]))).otherwise(F.array().cast("array<int>"))
        fits = lambda k: (k["n"] == F.size(x["left"])) & (F.size(k["out"]) == n_out)
        return F.when(n_out == 0, everything).otherwise(let(out, lambda k: F.when(fits(k), F.array_except(everything, k["out"])).otherwise(everything)))

    return let(F.struct(ws.alias("ws"), left.alias("left")), walk)


def without_honorifics(ws: Column) -> Column:
    return let(ws, lambda x: F.transform(kept_positions(x), lambda i: F.element_at(x, i)))


# --------------------------------------------------------------------------- vocabulary


def _literal_array(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def content_word_set(ws: Column, stop: list[str] = V.RETRIEVAL_STOP) -> Column:
    bad = _literal_array(stop)
    return F.array_distinct(F.filter(ws, lambda w: (F.length(w) >= 2) & ~F.array_contains(bad, w)))


def content_words(ws: Column, stop: list[str] = V.RETRIEVAL_STOP) -> Column:
    return F.size(content_word_set(ws, stop))


def query_terms(ws: Column, limit: int | None = None, stop: list[str] = V.RETRIEVAL_STOP) -> Column:
    """Distinct non-stop words of two letters or more in text order; all such words when fewer than two are left."""
    strict = content_word_set(ws, stop)
    loose = F.array_distinct(F.filter(ws, lambda w: F.length(w) >= 2))
    terms = F.when(F.size(strict) >= 2, strict).otherwise(loose)
    return terms if limit is None else F.slice(terms, 1, limit)


def alternate_terms(text: Column, limit: int | None = None) -> Column:
    long = F.filter(tokens(text, "latin"), lambda w: F.length(w) > 2)
    return F.when(F.size(long) >= 2, F.array_distinct(long if limit is None else F.slice(long, 1, limit))).otherwise(F.array().cast("array<string>"))


def stems(text: Column, script: str = "arabic", titles: bool = False) -> Column:
    """Light stems as a set. Latin text, which has no prefixes to strip, uses its words of four letters or more."""
    if script != "arabic":
        return F.array_distinct(F.filter(tokens(text, script), lambda w: F.length(w) > 3))
    stop = _literal_array(V.TITLE_STOP if titles else V.STEM_STOP)
    long = F.filter(F.array_except(tokens(text, "arabic"), stop), lambda w: F.length(w) >= 3)
    # one pass over the words in a line: a prefix stands at the start of a word and leaves three letters
    line = F.regexp_replace(F.array_join(long, " "), "(?<![^ ])(?:" + "|".join(V.STEM_PREFIXES) + ")(?=[^ ]{3,})", "")
    bare = F.array_remove(F.split(line, " "), "")
    if titles:
        bare = F.array_except(bare, stop)
    return F.array_distinct(F.transform(bare, lambda w: F.substring(w, 1, 5)))


def shared_vocabulary(claim_stems: Column, source_stems: Column) -> Column:
    shared = F.size(F.array_intersect(claim_stems, source_stems))
    n = F.size(claim_stems)
    return F.struct(F.when(n > 0, shared).otherwise(0).alias("shared"), F.when(n > 0, shared / n).otherwise(0.0).alias("ratio"))


def referral_query(search_query: Column, quote: Column, is_question: Column) -> Column:
    """Up to six topic words: the supplied query, else a question's own words."""
    given = F.filter(F.split(squeeze(F.coalesce(search_query, F.lit(""))), " "), lambda w: w != "")
    own = F.filter(F.split(squeeze(F.regexp_replace(quote, r"[؟?!.،,:«»\"']", " ")), " "), lambda w: w != "")
    pick = F.when(F.size(given) > 0, given).when(is_question, own)
    out = F.array_join(F.slice(pick, 1, 6), " ")
    return F.when(out != "", out)


# --------------------------------------------------------------------------- display text


def clean_pasted(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), V.ZERO_WIDTH_SPACE, " ")


def clean_display(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, V.CONTROLS, ""))


def excerpt(text: Column, limit: int = 160) -> Column:
    t = squeeze(text)
    head = F.substring(t, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))


def narration_wording(text: Column, intro: Column) -> Column:
    """Wording without its introduction: the stated opening dropped, first delimited clause, first line."""
    has_intro = F.coalesce((F.length(intro) > 0) & text.startswith(intro), F.lit(False))
    body = F.when(has_intro, F.substr(text, F.length(intro) + 1)).otherwise(text)
    clause = F.split_part(F.split_part(F.btrim(body, F.lit(" «.:\n")), F.lit("»"), F.lit(1)), F.lit("\n"), F.lit(1))
    return F.btrim(clause, F.lit(" «».:"))


def fold_for_markers(text: Column) -> Column:
    """Marker spelling: marks removed, alef / ya / ta forms folded."""
    return F.translate(F.regexp_replace(text, V.FOLD_DIACRITICS, ""), V.MARKER_FROM, V.MARKER_TO)


def stretches(text: Column, breaks: str) -> Column:
    """array<struct<start,end,hit>> of the longest stretches without a character of the class ``breaks``, left to right."""
    parts = F.struct(F.split(text, f"{breaks}+", -1).alias("hits"), F.regexp_extract_all(text, F.lit(f"{breaks}+"), F.lit(0)).alias("gaps"))

    def all_of(x: Column) -> Column:
        ends = running_totals(F.transform(x["hits"], lambda h, i: F.length(h) + F.when(i > 0, F.length(F.get(x["gaps"], i - 1))).otherwise(0)))
        one = lambda y: F.transform(y["hits"], lambda h, i: F.struct((F.get(y["ends"], i) - F.length(h)).alias("start"), F.get(y["ends"], i).alias("end"), h.alias("hit")))
        return F.filter(let(F.struct(x["hits"].alias("hits"), ends.alias("ends")), one), lambda m: m["hit"] != "")

    return let(parts, all_of)


def unmarked_places(text: Column) -> Column:
    """Places of the characters that are no marks."""
    return F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(~c.rlike(V.FOLD_DIACRITICS), i)), lambda i: i.isNotNull())


def original_offset(text: Column, folded_offset: Column, has_marks: Column | None = None, places: Column | None = None) -> Column:
    """Offset in ``text`` of the character that stands at ``folded_offset`` in its folded copy.

    ``has_marks``: whether the text has marks at all, ``places``: its ``unmarked_places``, where the caller knows them once per text.
    """
    has_marks = text.rlike(V.FOLD_DIACRITICS) if has_marks is None else has_marks
    places = unmarked_places(text) if places is None else places
    return F.when(~has_marks, folded_offset).otherwise(F.coalesce(F.get(places, folded_offset), F.length(text)))


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit>> of every match of ``pattern``, left to right (offsets 0-based, end exclusive)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("between"))

    def all_of(x: Column) -> Column:
        ends = running_totals(F.transform(x["hits"], lambda h, i: F.length(F.get(x["between"], i)) + F.length(h)))

        def one(y: Column) -> Column:
            return F.transform(y["hits"], lambda h, i: F.struct((F.get(y["ends"], i) - F.length(h)).alias("start"), F.get(y["ends"], i).alias("end"), h.alias("hit")))

        return let(F.struct(x["hits"].alias("hits"), ends.alias("ends")), one)

    return let(parts, all_of)


def aligned_words(text: Column, script: str, drop_honorifics: bool = False) -> Column:
    """struct(norm, orig): normal words and their original spellings, one to one."""
    both = let(F.coalesce(text, F.lit("")), lambda t: F.struct(words(t, script).alias("norm"), _kept(t, script).alias("orig")))
    if not drop_honorifics or script != "arabic":
        return both
    pick = lambda ws, k: F.transform(k, lambda i: F.element_at(ws, i))
    return let(both, lambda x: let(kept_positions(x["norm"]), lambda k: F.struct(pick(x["norm"], k).alias("norm"), pick(x["orig"], k).alias("orig"))))
