"""Claims: extraction by markers, predicates, and the interval joins that merge claim sets.

A claim row has claim_id, doc_id, type, quote, start, end, attributed_to, explicit_attribution, level,
certainty, origin, closed, is_question.
"""
from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import tags as T
from ..functions import text as X
from ..session import cut_lineage
from . import grams as G
from .intervals import length, near_pairs, shared
from .similar import near_texts

COLUMNS = ["claim_id", "doc_id", "type", "quote", "start", "end", "attributed_to", "explicit_attribution", "level", "certainty", "origin", "closed", "is_question"]
QUOTED = ("ayah", "hadith")
SENTENCE_BREAK = "[.؟!\\n؛]"


@dataclass(frozen=True)
class Marker:
    """One way a quotation is introduced. ``take``: 'after' the marker, 'group' 1 of it, or the 'whole' match."""

    name: str
    pattern: str
    type: str
    level: str
    take: str = "after"
    min_words: int = 2
    certainty: str = "not_applicable"
    question: bool = False
    attributed: bool = True


MARKERS = [
    Marker("canon_brackets", V.CANON_BRACKETS, "ayah", "A", "group"),
    Marker("canon", V.CANON_MARKER, "ayah", "A"),
    Marker("narration", V.NARRATION_MARKER, "hadith", "A"),
    Marker("scholar", V.SCHOLAR_MARKER, "attributed_quote", "B", min_words=4),
    Marker("request", V.REQUEST, "request", "B", "whole", attributed=False),
    Marker("personal", V.PERSONAL, "ruling", "D", "whole", certainty="ijtihadi", attributed=False),
    Marker("question", V.QUESTION, "ruling", "B", "whole", certainty="ijtihadi", question=True, attributed=False),
]


@dataclass(frozen=True)
class Limits:
    """Optional limits of marker claims; none is set by default."""

    quote_chars: int | None = None
    quote_words: int | None = None
    question_chars: int | None = None


NO_LIMITS = Limits()


def quote_after(plain: Column, pos: Column, limits: Limits = NO_LIMITS, chunks: Column | None = None) -> Column:
    """struct(start, end, closed): the quotation that begins at ``pos``, delimited or up to the sentence end.

    ``chunks``: the text in blocks (``X.chunked``), where the caller has them once per text. What follows ``pos`` is read
    from the blocks there, and from the whole rest only where it goes on beyond them.
    """
    chunks = X.chunked(plain) if chunks is None else chunks
    limit = limits.quote_chars

    def closing(at: Column, closer: Column) -> Column:
        """Place of the closing mark after ``at``, 0 if there is none."""
        if limit is not None:
            return F.instr(X.chars(chunks, at + 1, F.lit(limit - 1)), closer)
        return X.let(F.instr(X.rest_from(chunks, at + 1, 8), closer), lambda k: F.when(k > 0, k).otherwise(F.instr(X.rest_from(chunks, at + 1), closer)))

    def open_ended(p: Column) -> Column:
        if limit is None:
            n = X.leading(chunks, p, r"^[^.؟!\n…]*")
        else:
            n = F.length(F.regexp_extract(X.chars(chunks, p, F.lit(limit)), r"^[^.؟!\n…]*", 0))
        if limits.quote_words is not None:
            ws = lambda k: F.filter(F.split(X.chars(chunks, p, k), r"\s+"), lambda w: w != "")
            n = X.let(n, lambda k: F.when(F.size(ws(k)) > limits.quote_words, F.length(F.array_join(F.slice(ws(k), 1, limits.quote_words), " "))).otherwise(k))
        return F.struct(p.cast("int").alias("start"), (p + n).cast("int").alias("end"), F.lit(False).alias("closed"))

    def located(at: Column) -> Column:
        closers = F.create_map(*[x for kv in V.OPENERS.items() for x in map(F.lit, kv)])

        def delimited(x: Column) -> Column:
            # the closing mark must stand within the character limit, if any, after at least one character
            is_closed = F.coalesce(x["k"] > 1, F.lit(False))
            inner = F.struct((at + 1).cast("int").alias("start"), (at + x["k"]).cast("int").alias("end"), F.lit(True).alias("closed"))
            return F.when(is_closed, inner).otherwise(X.let(F.when(x["opened"], at + 1).otherwise(at), open_ended))

        shut = lambda c: F.struct(c.isNotNull().alias("opened"), F.when(c.isNotNull(), closing(at, c)).alias("k"))
        return X.let(closers[X.chars(chunks, at, F.lit(1))], lambda c: X.let(shut(c), delimited))

    return X.let(pos + X.leading(chunks, pos, r"^[ \t:،,]*"), located)


def extract_by_markers(docs: DataFrame, markers: list[Marker] = MARKERS, limits: Limits = NO_LIMITS) -> DataFrame:
    """Claims introduced by a marker: one narrow pass over the documents, one output row per hit.

    All of a text's hits are read off its blocks inside the row, so that no hit carries or passes over the whole text.
    """
    base = G.once(docs.select("doc_id", "text"), "plain", X.fold_for_markers(F.col("text")))
    base = G.once(base, "has_marks", F.col("text").rlike(V.FOLD_DIACRITICS))
    base = G.once(base, "b", F.struct(X.chunked(F.col("plain")).alias("plain"), X.chunked(F.col("text")).alias("text"), F.when(F.col("has_marks"), X.unmarked_places(F.col("text"))).alias("places")))
    hits = F.flatten(F.array_compact(F.array(*[_marker_hits(m, limits) for m in markers])))
    out = base.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")
    lead = F.length(F.regexp_extract("raw", r"^[\s\p{Z}]*", 0))
    out = out.withColumn("quote", F.regexp_replace("raw", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).withColumn("start", F.col("a") + lead)
    out = out.withColumn("end", F.col("start") + F.length("quote")).filter(F.size(F.filter(F.split(F.col("quote"), r"\s+"), lambda w: w != "")) >= 2)
    if any(m.question for m in markers):
        out = _without_taken_questions(out)
    return out.withColumn("origin", F.lit("marker")).withColumn("claim_id", F.concat_ws("-", "doc_id", "origin", "rule", "start")).select(*COLUMNS, "rule")


def _marker_hits(m: Marker, limits: Limits) -> Column:
    """array<struct> of a text's claims by one marker, from the columns of ``extract_by_markers``; null beyond the limit of a question."""
    plain, text, blocks, places = F.col("plain"), F.col("text"), F.col("b.plain"), F.col("b.places")

    def span(hit: Column) -> Column:
        if m.take == "after":
            return quote_after(plain, hit["end"], limits, blocks)
        cut = 1 if m.take == "group" else 0
        return F.struct((hit["start"] + cut).alias("start"), (hit["end"] - cut).alias("end"), F.lit(m.take == "group").alias("closed"))

    original = lambda at: X.original_offset(text, at, F.col("has_marks"), places).cast("int")

    def name(hit: Column) -> Column:
        """Who is named: (group, its place)."""
        whole = X.chars(blocks, hit["start"], F.length(hit["hit"]) + 1)
        return X.let(F.regexp_extract(whole, m.pattern, 1), lambda g: F.struct(g.alias("group"), (hit["start"] + F.instr(hit["hit"], g) - 1).alias("at")))

    def found(hit: Column) -> Column:
        named = name(hit) if m.name == "scholar" else F.lit(None).cast("struct<group:string,at:int>")
        return F.struct(hit.alias("m"), span(hit).alias("s"), named.alias("who"))

    def kept(x: Column) -> Column:
        ok, s = x["s"]["end"] > x["s"]["start"], x["s"]
        if m.min_words > 2:
            ok = ok & (F.size(F.filter(F.split(X.chars(blocks, s["start"], s["end"] - s["start"]), r"\s+"), lambda w: w != "")) >= m.min_words)
        if m.name == "scholar":
            head = X.chars(blocks, s["start"], F.lit(60))
            reports_view = x["who"]["group"].rlike(V.SCHOLAR_GROUP) & F.rtrim(x["m"]["hit"]).endswith("ان")
            other = head.rlike("^" + V.NARRATION_MARKER.replace("(?i)", "(?i:", 1) + ")") | head.rlike("^" + V.CANON_MARKER.replace("(?i)", "(?i:", 1) + ")")
            ok = ok & ~reports_view & ~other
        if m.question:
            ok = ok & T.asked_of_the_tool(x["m"]["hit"])
        return ok

    def claim(x: Column) -> Column:
        at = F.struct(original(x["s"]["start"]).alias("a"), original(x["s"]["end"]).alias("b"))
        named = F.lit(None).cast("string")
        if m.name == "scholar":
            a, b = original(x["who"]["at"]), original(x["who"]["at"] + F.length(x["who"]["group"]))
            named = F.trim(X.chars(F.col("b.text"), a, b - a))
        return X.let(
            at,
            lambda y: F.struct(
                F.lit(m.type).alias("type"), X.chars(F.col("b.text"), y["a"], y["b"] - y["a"]).alias("raw"), y["a"].alias("a"), named.alias("attributed_to"), F.lit(m.attributed).alias("explicit_attribution"),
                F.lit(m.level).alias("level"), F.lit(m.certainty).alias("certainty"), x["s"]["closed"].alias("closed"), F.lit(m.question).alias("is_question"), F.lit(m.name).alias("rule"),
            ),
        )

    claims = F.transform(F.filter(F.transform(X.matches_with_offsets(plain, m.pattern), found), kept), claim)
    return F.when(F.length("text") <= limits.question_chars, claims) if m.question and limits.question_chars is not None else claims


def _without_taken_questions(claims: DataFrame) -> DataFrame:
    """A question inside a request or a personal case is not a question of its own."""
    numbered = claims.withColumn("row", F.concat_ws("-", "rule", "start"))
    asked, taken = numbered.filter("is_question"), numbered.filter("not is_question and (type = 'request' or level = 'D')")
    inside = near_pairs(asked.select("doc_id", "start", "end", "row"), taken.select("doc_id", "start", "end")).select("doc_id", F.col("a_row").alias("row")).distinct()
    return numbered.join(inside, ["doc_id", "row"], "left_anti").drop("row")


def marker_before(text: Column, start: Column, pattern: str, within: int, reach: int = 90) -> Column:
    """The last marker in the ``reach`` characters before ``start`` ends at most ``within`` characters before it."""
    from_ = F.greatest(F.lit(0), start - reach)
    lead = X.fold_for_markers(F.substr(text, from_ + 1, start - from_))
    ends = F.transform(X.matches_with_offsets(lead, pattern), lambda m: m["end"])
    return F.coalesce(F.length(lead) - F.try_element_at(ends, F.lit(-1)) <= within, F.lit(False))


def markers_before(claims: DataFrame, docs: DataFrame, pattern: str, within: int, reach: int = 90) -> DataFrame:
    """``claims`` (claim_id, doc_id, start) with ``before``, as ``marker_before`` tells it.

    The places travel to the text, not the text to each place: a document's claims are one row, and what stands
    before each is read off the text's blocks.
    """
    of_doc = claims.groupBy("doc_id").agg(F.collect_list(F.struct("claim_id", "start")).alias("at"))
    rows = G.once(of_doc.join(docs.select("doc_id", "text"), "doc_id"), "b", F.coalesce(X.chunked(F.col("text")), F.array().cast("array<string>"))).drop("text")
    lead = lambda x: X.chars(F.col("b"), F.greatest(F.lit(0), x["start"] - reach), F.least(x["start"], F.lit(reach)))
    leads = rows.select("doc_id", F.explode(F.transform("at", lambda x: F.struct(x["claim_id"].alias("claim_id"), x["start"].alias("start"), lead(x).alias("lead")))).alias("x")).select("doc_id", "x.*")
    return leads.select("claim_id", "doc_id", "start", marker_before(F.col("lead"), F.length("lead"), pattern, within, reach).alias("before"))


def canon_marker_before(text: Column, start: Column) -> Column:
    bracket = F.rtrim(F.substr(text, F.greatest(F.lit(1), start - 2), F.least(F.lit(3), start))).endswith("﴿")
    return marker_before(text, start, V.CANON_MARKER, 6) | bracket


def narration_marker_before(text: Column, start: Column) -> Column:
    return marker_before(text, start, V.NARRATION_MARKER, 3)


def locate_quote(quote: Column, text: Column) -> Column:
    """struct(start, end, how): literal place of a proposed quotation: exact, else with whitespace differences."""
    q = F.trim(quote)
    at = F.instr(text, q)
    flexible = F.regexp_replace(F.regexp_replace(q, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    loose = F.regexp_substr(text, flexible)
    exact = F.struct((at - 1).alias("start"), (at - 1 + F.length(q)).alias("end"), F.lit("exact").alias("how"))
    spaced = F.struct((F.instr(text, loose) - 1).alias("start"), (F.instr(text, loose) - 1 + F.length(loose)).alias("end"), F.lit("whitespace").alias("how"))
    return F.when(F.length(q) == 0, F.lit(None)).when(at > 0, exact).when(loose.isNotNull(), spaced)


def locate_proposals(proposals: DataFrame, docs: DataFrame, script: str, floor: float = 0.90) -> DataFrame:
    """Keeps proposals whose words really stand in their text; the last resort is an aligned span at ``floor`` or better."""
    from ..functions import alignment as A

    at = G.once(proposals.join(docs.select("doc_id", "text"), "doc_id"), "at", locate_quote(F.col("quote"), F.col("text")))
    direct = at.filter("at is not null").select(*proposals.columns, "at.start", "at.end", "at.how")
    rest = at.filter("at is null and length(trim(quote)) > 0")
    spanned = G.once(G.once(rest, "q", X.words(F.col("quote"), script)), "s", X.words(F.col("text"), script))
    spanned = A.with_best_span(spanned, "q", "s").filter(F.col("span.score") >= floor)
    off = G.once(spanned, "o", X.word_span_offsets(F.col("text"), F.col("span.start"), F.col("span.end") - 1, script))
    return direct.unionByName(off.select(*proposals.columns, F.col("o.start").alias("start"), F.col("o.end").alias("end"), F.lit("aligned").alias("how")))


# --------------------------------------------------------------------------- predicates


def is_speakers_statement(type_: Column, is_question: Column, level: Column, quote: Column) -> Column:
    return type_.isin("fact", "ruling") & ~is_question & level.isin("A", "B") & ~T.attributes_to_canon(quote)


def hide_own_statements(verdicts: DataFrame) -> DataFrame:
    own = is_speakers_statement(F.col("type"), F.col("is_question"), F.col("level"), F.col("quote"))
    return verdicts.filter(~own | (F.col("state") == "supported"))


def drop_formulas(claims: DataFrame, formulas: DataFrame, script: str) -> DataFrame:
    """Opening formulas quoted without a marker are not citations. ``formulas``: (text)."""
    keyed = claims.withColumn("norm", F.array_join(X.words(F.col("quote"), script), " "))
    known = formulas.select(F.array_join(X.words(F.col("text"), script), " ").alias("norm")).distinct()
    bare = keyed.filter(~F.col("explicit_attribution")).join(F.broadcast(known), "norm", "left_anti")
    return bare.unionByName(keyed.filter("explicit_attribution")).drop("norm")


def long_enough(claims: DataFrame, script: str, min_words: int = 6, min_content: int = 4) -> DataFrame:
    ws = G.once(claims, "ws", X.aligned_words(F.col("quote"), script, True)["norm"])
    return ws.filter((F.size("ws") >= min_words) & (X.content_words(F.col("ws")) >= min_content)).drop("ws")


def sentences(docs: DataFrame, limit: int | None = None, script: str = "arabic", min_words: int = 6, min_content: int = 4) -> DataFrame:
    """Candidate sentences with offsets: (doc_id, n, quote, start, end), of the first ``limit`` pieces of a text if one is given."""
    found = docs.select("doc_id", F.posexplode(X.stretches(F.col("text"), SENTENCE_BREAK)).alias("n", "m"))
    found = found if limit is None else found.filter(F.col("n") < limit)
    lead = F.length(F.regexp_extract("m.hit", r"^[\s\p{Z}]*", 0))
    s = found.select("doc_id", "n", F.regexp_replace("m.hit", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("quote"), (F.col("m.start") + lead).alias("start"))
    s = s.withColumn("end", F.col("start") + F.length("quote")).filter(F.size(F.split("quote", r"\s+")) >= min_words)
    if script == "arabic":
        s = s.filter(X.is_arabic(F.col("quote")))
    ws = G.once(s, "ws", X.tokens(F.col("quote"), script, script == "arabic"))
    return ws.filter(X.content_words(F.col("ws")) >= min_content).drop("ws")


def outside(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows (doc_id, start, end, n) that touch no taken range."""
    hit = near_pairs(rows.select("doc_id", "start", "end", "n"), taken.select("doc_id", "start", "end")).select("doc_id", F.col("a_n").alias("n")).distinct()
    return rows.join(hit, ["doc_id", "n"], "left_anti")


def near_verbatim(rows: DataFrame, texts: DataFrame, script: str = "arabic", own: bool = False) -> DataFrame:
    """``rows`` of sentences (doc_id, n, quote) that stand nearly word for word in a text: with ``key`` and ``similarity``.

    ``texts``: (key, text), met sentence by sentence. Similarity is that of letters in normal form, 0.88 or more; the most
    similar text counts, then the smallest key. With ``own`` the keys are document ids, and no document is
    its own source. Equal sentences are one row until the end, with the two best sources of each, one for the other's documents.
    Sentences without words, and null or empty texts, match nothing.
    """
    norm = lambda c: F.array_join(X.words(c, script), " ")
    q = G.once(rows, "t", norm(F.col("quote"))).withColumn("sid", F.sha2("t", 256))
    split = texts.select("key", F.explode(F.array_remove(F.split(F.coalesce("text", F.lit("")), f"{SENTENCE_BREAK}+", -1), "")).alias("s"))
    r = cut_lineage(G.once(split, "t", norm(F.col("s"))).filter("t <> ''").withColumn("sid", F.sha2("t", 256)).select("sid", "t", "key").distinct())
    wanted = cut_lineage(q.select("sid", "t").distinct())
    pairs = cut_lineage(near_texts(wanted, r.select("sid", "t").distinct()).withColumn("similarity", F.round("similarity", 9)))
    first = r.groupBy(F.col("sid").alias("other")).agg(F.min("key").alias("key"))
    second = r.withColumnRenamed("sid", "other").join(first.withColumnRenamed("key", "k"), "other").filter("key > k").groupBy("other").agg(F.min("key").alias("key"))
    sources = pairs.join(first.unionByName(second), "other")
    order = lambda: F.min(F.struct((-F.col("similarity")).alias("s"), "key"))
    best = sources.groupBy("sid").agg(order().alias("b"))
    found = q.join(best, "sid")
    if own:
        rest = sources.join(best.select("sid", F.col("b.key").alias("k")), "sid").filter("key <> k").groupBy("sid").agg(order().alias("b2"))
        found = found.join(rest, "sid", "left").withColumn("b", F.when(F.col("b.key") == F.col("doc_id"), F.col("b2")).otherwise(F.col("b"))).filter("b IS NOT NULL")
    return found.select(*rows.columns, F.col("b.key").alias("key"), (-F.col("b.s")).alias("similarity"))


# --------------------------------------------------------------------------- merging claim sets


def _same_type(left: str = "a_", right: str = "b_") -> Column:
    return F.col(left + "type") == F.col(right + "type")


def compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a.isin(*QUOTED) & b.isin(*QUOTED))


def absorb_closed(scanned: DataFrame, closed: DataFrame, docs: DataFrame, script: str) -> DataFrame:
    """Folds scan hits into delimited quotations; the outermost delimited quotation stands for what is inside it.

    Adds ``rematch``: the words differ from the scan's, so its exact match no longer describes the row.
    """
    pick = ["doc_id", "claim_id", "type", "start", "end", "quote"]
    cc = near_pairs(closed.select(*pick), closed.select(*pick)).filter(_same_type() & (F.col("a_claim_id") != F.col("b_claim_id")))
    inner = cc.filter((F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end")) & ((F.col("a_start") != F.col("b_start")) | (F.col("a_end") != F.col("b_end"))))
    nested = inner.select("doc_id", F.col("a_claim_id").alias("c_claim_id")).distinct().withColumn("nested", F.lit(True))
    pc = near_pairs(scanned.select(*pick), closed.select(*pick), left="p_", right="c_").filter(_same_type("p_", "c_"))
    pc = pc.join(nested, ["doc_id", "c_claim_id"], "left").join(docs.select("doc_id", "text"), "doc_id")
    runs_on = F.substr("text", F.col("c_end") + 1, F.greatest(F.lit(0), F.col("p_end") - F.col("c_end"))).rlike("[«“﴿]")
    straddles = (F.col("p_start") < F.col("c_start")) & (F.col("c_start") < F.col("p_end")) & F.col("nested").isNull() & ((F.col("p_end") <= F.col("c_end")) | runs_on)
    marked = pc.withColumn("straddles", straddles).drop("text")
    gone = marked.filter("straddles").select("doc_id", F.col("p_claim_id").alias("claim_id")).distinct()
    inside = marked.join(gone.withColumnRenamed("claim_id", "p_claim_id"), ["doc_id", "p_claim_id"], "left_anti").filter(shared("p_", "c_") >= 0.9 * length("p_"))
    counted = inside.withColumn("n", F.count("*").over(W.partitionBy("doc_id", "c_claim_id")))
    fits = counted.filter((F.col("n") == 1) & (length("p_") >= 0.9 * length("c_")))
    words_of = lambda c: F.array_join(X.words(F.col(c), script), " ")
    adopted = fits.groupBy("doc_id", F.col("p_claim_id").alias("claim_id")).agg(
        F.max(F.struct(length("c_").alias("l"), F.col("c_start").alias("start"), F.col("c_end").alias("end"), F.col("c_quote").alias("quote"), (words_of("p_quote") != words_of("c_quote")).alias("rematch"))).alias("x")
    )
    consumed = inside.select("doc_id", F.col("p_claim_id").alias("claim_id")).distinct()
    used = fits.select("doc_id", F.col("c_claim_id").alias("claim_id")).distinct()
    rest = scanned.join(gone, ["doc_id", "claim_id"], "left_anti").join(consumed, ["doc_id", "claim_id"], "left_anti").withColumn("rematch", F.lit(False))
    base = scanned.drop("start", "end", "quote", "closed", "explicit_attribution").join(adopted, ["doc_id", "claim_id"])
    taken = base.select(*[c for c in base.columns if c != "x"], "x.start", "x.end", "x.quote", "x.rematch", F.lit(True).alias("closed"), F.lit(True).alias("explicit_attribution"))
    outer = closed.join(nested.select("doc_id", F.col("c_claim_id").alias("claim_id")), ["doc_id", "claim_id"], "left_anti")
    added = outer.join(used, ["doc_id", "claim_id"], "left_anti").withColumn("rematch", F.lit(True))
    return rest.unionByName(taken, allowMissingColumns=True).unionByName(added, allowMissingColumns=True)


def merge_claims(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Primary claims, and extra ones not yet covered to 60 % by compatible claims, in text order.

    The order matters only inside a chain of touching ranges, so each chain is folded by itself.
    """
    both = primary.withColumn("prio", F.lit(0)).unionByName(extra.withColumn("prio", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("doc_id").orderBy("start", "end", "claim_id")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    chained = both.withColumn("head", F.when(F.coalesce(F.col("start") < reach, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("head").over(w))
    item = F.struct("prio", "start", "end", "type", "claim_id", "origin")
    shape = "array<struct<start:int,end:int,type:string,claim_id:string>>"

    def step(acc: Column, x: Column) -> Column:
        meets = F.filter(acc, lambda p: compatible(p["type"], x["type"]))
        covered = F.aggregate(meets, F.lit(0), lambda t, p: t + F.greatest(F.lit(0), F.least(p["end"], x["end"]) - F.greatest(p["start"], x["start"])))
        enough = (covered > 0) & (covered >= 0.6 * (x["end"] - x["start"]))
        row = F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["type"].alias("type"), x["claim_id"].alias("claim_id"))
        return F.when((x["prio"] == 1) & enough, acc).otherwise(F.concat(acc, F.array(row)))

    kept = chained.groupBy("doc_id", "chain").agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(shape), step).alias("k"))
    ids = kept.select("doc_id", F.explode("k.claim_id").alias("claim_id"))
    merged = both.join(ids, ["doc_id", "claim_id"], "left_semi").drop("prio")
    return _pass_attribution(merged, extra.join(ids, ["doc_id", "claim_id"], "left_anti"))


def _pass_attribution(merged: DataFrame, dropped: DataFrame) -> DataFrame:
    """A dropped proposal hands what it knew about attribution to the rows that cover it."""
    pick = ["doc_id", "claim_id", "type", "start", "end", "origin"]
    pairs = near_pairs(merged.select(*pick), dropped.filter("origin = 'proposed'").select(*pick, "explicit_attribution", "attributed_to"))
    told = pairs.filter(_same_type() & (F.col("a_origin") != "proposed")).groupBy("doc_id", F.col("a_claim_id").alias("claim_id")).agg(
        F.max("b_explicit_attribution").alias("told_explicit"), F.min_by("b_attributed_to", "b_start").alias("told_name")
    )
    out = merged.join(told, ["doc_id", "claim_id"], "left")
    return out.withColumn("explicit_attribution", F.col("explicit_attribution") | F.coalesce("told_explicit", F.lit(False))).withColumn(
        "attributed_to", F.coalesce("attributed_to", "told_name")
    ).drop("told_explicit", "told_name")


def widen_narrations(scanned: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scanned narrations replaced by a proposal a fifth wider around them: (kept, proposals left)."""
    wide = _wider(scanned, proposed, "hadith").filter(~F.col("any_closed"))
    return _replace(scanned, proposed, wide)


def widen_canon(scanned: DataFrame, proposed: DataFrame, matches: DataFrame, edges: DataFrame, near: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Canon fragments replaced by a wider proposal that the matcher still places in the same unit.

    ``matches``: (claim_id, group_no, unit_start, unit_end, similarity) of fragments and proposals; ``edges``:
    (claim_id, starts_at_unit_start, ends_at_unit_end) of fragments. A proposal that only adds words beside a
    fragment's own unit border adds the speaker's words and widens nothing.
    """
    wide = _wider(scanned, proposed, "ayah")
    pick = ["doc_id", "claim_id", "type", "start", "end"]
    inside = near_pairs(scanned.filter("type = 'ayah'").select(*pick), proposed.select(*pick), left="p_", right="c_").filter(_same_type("p_", "c_") & (shared("p_", "c_") >= 0.9 * length("p_")))
    inside = inside.join(edges.select(F.col("claim_id").alias("p_claim_id"), "starts_at_unit_start", "ends_at_unit_end"), "p_claim_id", "left").fillna(False, ["starts_at_unit_start", "ends_at_unit_end"])
    m = matches.select("claim_id", "group_no", "unit_start", "unit_end", "similarity")
    pm, cm = m.toDF("p_claim_id", "pg", "pa", "pb", "ps"), m.toDF("c_claim_id", "cg", "ca", "cb", "cs")
    seen = inside.join(pm, "p_claim_id").join(cm, "c_claim_id")
    same = (F.col("pg") == F.col("cg")) & (F.col("pa") <= F.col("cb")) & (F.col("ca") <= F.col("pb")) & (F.col("cs") >= near)
    per = seen.groupBy("doc_id", "c_claim_id").agg(
        F.max(same).alias("same"), F.any_value("c_start").alias("cs0"), F.any_value("c_end").alias("ce0"),
        F.min(F.struct("p_start", "starts_at_unit_start")).alias("first"), F.max(F.struct("p_end", "ends_at_unit_end")).alias("last"),
    )
    after_only = (F.col("cs0") >= F.col("first.p_start") - 2) & (F.col("ce0") > F.col("last.p_end")) & F.col("last.ends_at_unit_end")
    before_only = (F.col("ce0") <= F.col("last.p_end") + 2) & (F.col("cs0") < F.col("first.p_start")) & F.col("first.starts_at_unit_start")
    ok = per.filter(F.col("same") & ~after_only & ~before_only).select("doc_id", F.col("c_claim_id").alias("claim_id"))
    return _replace(scanned, proposed, wide.join(ok, ["doc_id", "claim_id"], "left_semi"))


def _wider(scanned: DataFrame, proposed: DataFrame, kind: str) -> DataFrame:
    pick = ["doc_id", "claim_id", "type", "start", "end"]
    pairs = near_pairs(scanned.filter(F.col("type") == kind).select(*pick, "closed", "explicit_attribution"), proposed.filter(F.col("type") == kind).select(*pick), left="p_", right="c_")
    inside = pairs.filter(shared("p_", "c_") >= 0.9 * length("p_"))
    per = inside.groupBy("doc_id", F.col("c_claim_id").alias("claim_id")).agg(
        F.max(length("p_")).alias("longest"), F.any_value(length("c_")).alias("wide"), F.max("p_closed").alias("any_closed"), F.max("p_explicit_attribution").alias("told"), F.collect_set("p_claim_id").alias("inside")
    )
    return per.filter(F.col("wide") >= 1.2 * F.col("longest"))


def _replace(scanned: DataFrame, proposed: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = wide.select("doc_id", F.explode("inside").alias("claim_id")).distinct()
    came = proposed.join(wide.select("doc_id", "claim_id", "told"), ["doc_id", "claim_id"]).withColumn("explicit_attribution", F.col("explicit_attribution") | F.col("told")).drop("told")
    kept = scanned.join(gone, ["doc_id", "claim_id"], "left_anti").unionByName(came, allowMissingColumns=True)
    return kept, proposed.join(wide.select("doc_id", "claim_id"), ["doc_id", "claim_id"], "left_anti")


def join_split_quotations(proposed: DataFrame, closed: DataFrame) -> DataFrame:
    """Two or more pieces of one delimited quotation become that quotation."""
    pick = ["doc_id", "claim_id", "type", "start", "end"]
    pairs = near_pairs(proposed.select(*pick), closed.select(*pick, "quote")).filter(_same_type() & (F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end")))
    split = pairs.withColumn("n", F.count("*").over(W.partitionBy("doc_id", "b_claim_id"))).filter("n >= 2")
    first = split.groupBy("doc_id", "b_claim_id").agg(F.min(F.struct("a_start", "a_claim_id")).alias("f"), F.any_value("b_quote").alias("quote"), F.any_value("b_start").alias("start"), F.any_value("b_end").alias("end"))
    pieces = split.select("doc_id", F.col("a_claim_id").alias("claim_id")).distinct()
    whole = first.select("doc_id", F.col("f.a_claim_id").alias("claim_id"), "quote", "start", "end", F.lit(True).alias("closed")).dropDuplicates(["doc_id", "claim_id"])
    joined = proposed.drop("quote", "start", "end", "closed").join(whole, ["doc_id", "claim_id"])
    return proposed.join(pieces, ["doc_id", "claim_id"], "left_anti").unionByName(joined)


def prefer_sayings(claims: DataFrame, sayings: DataFrame) -> DataFrame:
    """A narration or statement on the same words as an attributed saying gives way to the saying."""
    rivals = claims.filter(F.col("type").isin("hadith", "fact", "ruling") & ~F.col("is_question"))
    pairs = near_pairs(rivals.select("doc_id", "claim_id", "start", "end"), sayings.select("doc_id", "start", "end"))
    same = pairs.filter((shared() >= 0.6 * length("a_")) & (shared() >= 0.8 * length("b_"))).select("doc_id", F.col("a_claim_id").alias("claim_id")).distinct()
    return claims.join(same, ["doc_id", "claim_id"], "left_anti")


def _half_overlaps(claims: DataFrame, markers: DataFrame) -> DataFrame:
    pairs = near_pairs(claims.select("doc_id", "claim_id", "start", "end"), markers.select("doc_id", "claim_id", "start", "end", "type", "certainty"), left="c_", right="m_")
    return pairs.filter(shared("c_", "m_") >= 0.5 * F.least(length("c_"), length("m_")))


def keep_personal_cases(proposed: DataFrame, markers: DataFrame) -> DataFrame:
    """Claims that overlap a personal-case marker become level D; a marker nothing overlaps is added."""
    personal = markers.filter("level = 'D'")
    hits = _half_overlaps(proposed, personal)
    told = hits.groupBy("doc_id", F.col("c_claim_id").alias("claim_id")).agg(F.max_by(F.struct("m_type", "m_certainty"), "m_start").alias("m"))
    out = proposed.join(told, ["doc_id", "claim_id"], "left")
    change = F.col("m").isNotNull() & ~F.col("type").isin(*QUOTED)
    out = out.withColumns(
        {
            "level": F.when(change, "D").otherwise(F.col("level")),
            "certainty": F.when(change, F.col("m.m_certainty")).otherwise(F.col("certainty")),
            "type": F.when(change, F.col("m.m_type")).otherwise(F.col("type")),
        }
    ).drop("m")
    new = personal.join(hits.select("doc_id", F.col("m_claim_id").alias("claim_id")).distinct(), ["doc_id", "claim_id"], "left_anti")
    return out.unionByName(new, allowMissingColumns=True)


def keep_questions(proposed: DataFrame, markers: DataFrame) -> DataFrame:
    """Claims that read as a question become questions, unless quoted, personal or a request to fabricate."""
    asked = markers.filter("is_question")
    hits = _half_overlaps(proposed, asked)
    told = hits.select("doc_id", F.col("c_claim_id").alias("claim_id")).distinct().withColumn("hit", F.lit(True))
    out = proposed.join(told, ["doc_id", "claim_id"], "left")
    q = F.col("quote")
    open_ = ~F.col("type").isin(*QUOTED) & ~((F.col("level") == "D") & T.is_personal_case(q))
    reads = T.looks_like_question(q) & ~T.is_fabrication_request(q)
    on_hit = F.coalesce(F.col("hit"), F.lit(False)) & open_
    elsewhere = open_ & ~F.col("is_question") & (F.col("type") != "attributed_quote") & reads
    becomes = (on_hit & reads) | elsewhere
    out = out.withColumn("lower", on_hit | becomes).withColumn("becomes", becomes)
    out = out.withColumns(
        {
            "is_question": F.col("is_question") | F.col("becomes"),
            "level": F.when(F.col("lower") & (F.col("level") == "D"), "B").otherwise(F.col("level")),
            "type": F.when(F.col("becomes"), "ruling").otherwise(F.col("type")),
        }
    ).drop("hit", "lower", "becomes")
    new = asked.join(hits.select("doc_id", F.col("m_claim_id").alias("claim_id")).distinct(), ["doc_id", "claim_id"], "left_anti")
    return out.unionByName(new, allowMissingColumns=True)


# --------------------------------------------------------------------------- noise


def repeated_quotations(claims: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(doc_id, claim_id) of quotations said more fully elsewhere in the document, or said before.

    Containment is looked up by the first three words, never by pairing all quotations of a document; a document's
    quotations of a type meet in one row, so that no text is sent with each of its words.
    """
    quoted = claims.withColumn("is_shown", F.lit(False))
    if shown is not None:
        quoted = shown.withColumn("is_shown", F.lit(True)).unionByName(quoted, allowMissingColumns=True)
    rows = G.once(quoted.filter(F.col("type").isin(*QUOTED)), "plain", T.plain_words(F.col("quote"))).select("doc_id", "claim_id", "type", "start", "plain", "is_shown")
    rows = rows.filter(F.size(F.split("plain", " ")) >= 3)
    per = rows.groupBy("doc_id", "type").agg(F.collect_list(F.struct("claim_id", "start", "plain", "is_shown")).alias("c"))

    def said_elsewhere(batches):
        for batch in batches:
            found = [(k, x) for k, (doc_id, c) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("c").to_pylist(), strict=True)) for x in _repeated(c, doc_id is not None)]
            docs, ids = pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], batch.column("c").type.value_type.field("claim_id").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(docs), ids], ["doc_id", "claim_id"])

    kinds = dict(rows.dtypes)
    return per.select("doc_id", "c").mapInArrow(said_elsewhere, f"doc_id {kinds['doc_id']}, claim_id {kinds['claim_id']}").distinct()


def _repeated(claims: list[dict], in_document: bool) -> list:
    """The claim_ids among a document's quotations of one type that ``repeated_quotations`` names; without a document, equal texts only."""
    by_text: dict[str, list[dict]] = {}
    for c in claims:
        by_text.setdefault(c["plain"], []).append(c)
    order = lambda c: (not c["is_shown"], c["start"] is not None, c["start"] or 0, c["claim_id"] is not None, c["claim_id"] or type(c["claim_id"])())
    # equal texts: the earliest (or an announced one) stays
    out = [c["claim_id"] for same in by_text.values() for c in sorted(same, key=order)[1:] if not c["is_shown"]]
    head = {t: tuple(t.split(" ")[:3]) for t, same in by_text.items() if in_document and not all(c["is_shown"] for c in same)}
    heads, holding = set(head.values()), {}
    for t in by_text if head else ():
        w = t.split(" ")
        for h in heads.intersection(zip(w, w[1:], w[2:])):  # noqa: B905
            holding.setdefault(h, []).append(t)
    for t, h in head.items():
        if any(len(longer) > len(t) and f" {t} " in f" {longer} " for longer in holding[h]):
            out += [c["claim_id"] for c in by_text[t] if not c["is_shown"]]
    return out


def drop_noise(claims: DataFrame, shown: DataFrame | None = None, quotations: DataFrame | None = None) -> DataFrame:
    """Claims worth a verdict of their own.

    Left out: a question about a neighbouring quotation's authenticity, sayings under three words, an editor's
    note, the sentence that introduces a quotation, a statement that contains one, and repeated quotations.
    """
    pick = ["doc_id", "claim_id", "start", "end", "quote"]
    seen = claims.filter(F.col("type").isin(*QUOTED)).select(*pick)
    for more in (shown, quotations):
        if more is not None:
            seen = seen.unionByName(more.filter(F.col("type").isin(*QUOTED)).select(*pick))
    seen = seen.dropDuplicates(["doc_id", "claim_id"])
    words_n = F.size(F.filter(F.split(T.plain_words(F.col("quote")), " "), lambda w: w != ""))
    open_ = claims.filter(~F.col("type").isin(*QUOTED))
    pairs = near_pairs(open_.select(*pick, "type", "is_question"), seen, reach=81).filter(F.col("a_claim_id") != F.col("b_claim_id"))
    covers = shared() >= 0.9 * length("b_")
    ahead, behind = F.col("b_start") - F.col("a_end"), F.col("a_start") - F.col("b_end")
    close = covers | ahead.between(-80, 80) | behind.between(0, 40)
    per = pairs.groupBy("doc_id", F.col("a_claim_id").alias("claim_id")).agg(
        F.max(covers).alias("contains_one"), F.max(ahead.between(0, 80)).alias("precedes_one"), F.collect_set(F.when(close, F.col("b_quote"))).alias("near"),
    )
    flagged = open_.join(per, ["doc_id", "claim_id"], "left")
    rest = F.aggregate(F.coalesce("near", F.array().cast("array<string>")), F.col("quote"), lambda t, q: F.replace(t, q, F.lit(" ")))
    asks = F.col("is_question") | (F.col("type") == "request")
    q = F.col("quote")
    statement = F.col("type").isin("fact", "ruling") & ~F.col("is_question")
    noise = (
        ((F.col("type") != "attributed_quote") & asks & (F.size(F.coalesce("near", F.array().cast("array<string>"))) > 0) & T.asks_authenticity(rest) & ~T.is_fabrication_request(q))
        | ((F.col("type") == "attributed_quote") & (words_n < 3))
        | (statement & q.rlike(V.EDITORS_NOTE))
        | (statement & (words_n <= 30) & F.coalesce("precedes_one", F.lit(False)) & (T.presents_a_quotation(q) | T.attributes_to_canon(q)))
        | ((F.col("type") == "fact") & ~F.col("is_question") & F.coalesce("contains_one", F.lit(False)))
    )
    gone = flagged.filter(noise).select("doc_id", "claim_id").unionByName(repeated_quotations(claims, shown))
    return claims.join(gone.distinct(), ["doc_id", "claim_id"], "left_anti")


def cap_claims(claims: DataFrame, limit: int | None = None) -> DataFrame:
    """Numbers the claims of a document, at most ``limit`` of them if one is given: scan results before the others, then in text order."""
    w = W.partitionBy("doc_id").orderBy(F.col("origin").endswith("_scan").cast("int").desc(), "start", "claim_id")
    numbered = claims.withColumn("index", F.row_number().over(w))
    return numbered if limit is None else numbered.filter(F.col("index") <= limit)


def new_claims(merged: DataFrame, announced: DataFrame) -> DataFrame:
    return merged.join(announced.select("claim_id"), "claim_id", "left_anti")


def count_outside(runs: DataFrame, words: DataFrame, spans: DataFrame, min_words: int = 6, min_content: int = 4) -> DataFrame:
    """Runs that keep enough words once the words inside other matches are left out.

    ``runs``: (doc_id, run_id, start_w, end_w); ``words``: (doc_id, words); ``spans``: taken word ranges (doc_id, start, end).
    Runs meet the taken ranges as ranges; a document's words are joined once, not once for each of its runs.
    """
    of_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("run_id", "start_w", "end_w")).alias("runs")).join(words.select("doc_id", "words"), "doc_id")
    cut = F.transform("runs", lambda r: F.struct(r["run_id"].alias("run_id"), r["start_w"].alias("start_w"), F.slice("words", r["start_w"].cast("int") + 1, (r["end_w"] - r["start_w"]).cast("int")).alias("ws")))
    rows = of_doc.select("doc_id", F.explode(cut).alias("r")).select("doc_id", "r.*")
    at = runs.select("doc_id", F.col("start_w").alias("start"), F.col("end_w").alias("end"), "run_id")
    met = near_pairs(at, spans.select("doc_id", "start", "end")).groupBy("doc_id", F.col("a_run_id").alias("run_id")).agg(F.collect_set(F.struct(F.col("b_start").alias("s"), F.col("b_end").alias("e"))).alias("taken"))
    joined = rows.join(met, ["doc_id", "run_id"], "left")

    def free(w: Column, i: Column) -> Column:
        place = F.col("start_w") + i
        return ~F.exists(F.coalesce("taken", F.array().cast(met.schema["taken"].dataType)), lambda t: (t["s"] <= place) & (place < t["e"]))

    left = joined.select("doc_id", "run_id", F.filter("ws", free).alias("left")).groupBy("doc_id", "run_id").agg(F.flatten(F.collect_list("left")).alias("left"))
    return left.filter(F.size("left") > 0).select("doc_id", "run_id", F.size("left").cast("long").alias("n_outside"), X.content_words(F.col("left")).alias("n_content")).filter(
        (F.col("n_outside") >= min_words) & (F.col("n_content") >= min_content)
    )
