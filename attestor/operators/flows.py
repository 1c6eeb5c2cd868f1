"""Whole flows per claim type, and documents to verdicts."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import fixed_values as V
from ..functions import grades as GR
from ..functions import tags as T
from ..functions import text as X
from ..session import cut_lineage, fits_broadcast
from . import claims as C
from . import grams as G
from . import lookup as L
from . import match as M
from . import retrieve as R
from . import rules as RU
from . import scan as S


@dataclass
class Canon:
    """Canon tables derived once from its units, stored in the shared folder and read by every step on them."""

    units: DataFrame
    script: str
    positions: DataFrame
    tokens: DataFrame
    idf: DataFrame
    small: bool
    display_tokens: DataFrame | None = None

    @classmethod
    def build(cls, units: DataFrame, script: str, two_spellings: bool = False) -> "Canon":
        positions = cut_lineage(G.unit_positions(units, script, "text_match"))
        display = cut_lineage(G.stream_tokens(G.unit_positions(units, script, "text_display"))) if two_spellings else None
        return cls(units, script, positions, cut_lineage(G.stream_tokens(positions)), cut_lineage(G.word_idf(positions.select("words"))), fits_broadcast(units, F.col("text_match")), display)


def scan_canon(docs: DataFrame, canon: Canon, min_words: int = 4) -> DataFrame:
    """Verbatim canon passages with character offsets: (doc_id, start_w, end_w, p, spelling, start, end, quote)."""
    words = G.doc_words(G.spread(docs), canon.script)
    runs = S.canon_scan(words, canon.tokens, canon.idf, canon.small, canon.display_tokens, min_words)
    return S.with_offsets(runs, docs, canon.script)


def scan_records(docs: DataFrame, records: DataFrame, script: str, min_words: int = 6) -> DataFrame:
    """Verbatim record passages with character offsets. ``records``: (src BIGINT, text)."""
    words = G.doc_words(G.spread(docs), script)
    rec = G.once(records.select("src", "text"), "words", X.words(F.col("text"), script)).select("src", "words")
    runs = S.record_scan(words, rec, fits_broadcast(records, F.col("text")), min_words, script=script)
    return S.with_offsets(runs, docs, script)


# --------------------------------------------------------------------------- per type


def verify_canon(claims: DataFrame, canon: Canon) -> DataFrame:
    """Canon verdicts. ``claims`` needs claim_id, quote, explicit_attribution, transcribed."""
    cw = R.claim_words(claims, canon.script)
    found = M.match_canon(cw.select("claim_id", "q"), canon.tokens, canon.positions, canon.small)
    counted = cw.select("claim_id", F.size("q").alias("quoted_words"))
    j = claims.join(counted, "claim_id").join(found, "claim_id", "left")
    has = F.col("kind").isNotNull()
    d = RU.decide_canon(
        has, F.coalesce(F.col("kind") == "exact", F.lit(False)), F.coalesce("similarity", F.lit(0.0)), F.when(has, F.col("quoted_words")).otherwise(0),
        F.col("explicit_attribution"), F.col("transcribed"),
    )
    return j.withColumn("d", d).select(*claims.columns, "quoted_words", "kind", "similarity", "p", "n_words", "d.*")


def open_prefixes(claims: DataFrame, script: str) -> DataFrame:
    """Prefix tries of unclosed marker quotations: (claim_id, try_id, n, quote); the whole text has n = null."""
    o = claims.filter((F.col("origin") == "marker") & ~F.col("closed")).select("claim_id", "quote")
    ws = G.once(o, "ws", X.words(F.col("quote"), script)).filter(F.size("ws") > V.PREFIX_LENGTHS[0])
    cut = ws.withColumn("n", F.explode(A.prefix_lengths(F.size("ws"))))
    end = X.word_span_offsets(F.col("quote"), F.lit(0), F.col("n") - 1, script)["end"]
    tries = cut.select("claim_id", "n", F.substr("quote", F.lit(1), end).alias("quote"))
    whole = ws.select("claim_id", F.size("ws").alias("n"), "quote")
    return whole.withColumn("whole", F.lit(True)).unionByName(tries.withColumn("whole", F.lit(False))).withColumn("try_id", F.concat_ws("#", "claim_id", "n"))


def refine_open_quotes(claims: DataFrame, tries: DataFrame, scores: DataFrame, verbatim: bool = False) -> DataFrame:
    """Claims with their open quotations shortened to the prefix that matches. ``scores``: (try_id, sim)."""
    s = tries.join(scores, "try_id", "left").fillna(0.0, ["sim"])
    per = s.groupBy("claim_id").agg(
        F.max(F.when(F.col("whole"), F.struct("n", "sim"))).alias("w"), F.array_sort(F.collect_list(F.when(~F.col("whole"), F.struct("n", "sim")))).alias("t"), F.collect_list(F.struct("n", "quote")).alias("texts")
    )
    pick = A.longest_verbatim_prefix(F.col("w.n"), F.col("t")) if verbatim else A.choose_open_prefix(F.col("w.n"), F.col("w.sim"), F.col("t"))
    kept = per.withColumn("keep", F.coalesce(pick, F.col("w.n"))).select("claim_id", F.filter("texts", lambda x: x["n"] == F.col("keep"))[0]["quote"].alias("short"))
    out = claims.join(kept, "claim_id", "left").withColumn("quote", F.coalesce("short", "quote")).drop("short")
    return out.withColumn("end", F.col("start") + F.length("quote")) if "start" in claims.columns else out


def graded_candidates(claims: DataFrame, corpora: dict[str, DataFrame], script: str, pool: int = 40, k: int = 40) -> DataFrame:
    """Ranked, aligned candidates of every corpus. Each corpus: (key, text) and record columns."""
    cw, queries = R.claim_words(claims, script), R.query_claims(claims, script)
    parts = []
    for name, records in corpora.items():
        rw = R.record_words(records, script)
        parts.append((name, R.align(R.bm25(queries, rw, pool), cw, rw)))
    return R.rank_candidates(R.union_corpora(*parts), k)


def verify_graded(claims: DataFrame, graded: DataFrame, script: str, books: DataFrame | None = None, grade_rows: DataFrame | None = None) -> DataFrame:
    """Graded verdicts. ``graded``: (key, text, attribution, grade); ``books``: (key, text, book, trusted);
    ``grade_rows``: optional further gradings (key, text, narrator, scholar, book, grade, url).
    """
    corpora = {"graded": graded} | ({"books": books} if books is not None else {})
    cands = graded_candidates(claims, corpora, script)
    about = graded.select(F.lit("graded").alias("corpus"), "key", "attribution", "grade", F.lit(None).cast("string").alias("book"), GR.in_trusted_collection(F.col("attribution")).alias("trusted"))
    if books is not None:
        about = about.unionByName(books.select(F.lit("books").alias("corpus"), "key", F.lit(None).cast("string").alias("attribution"), F.lit(None).cast("string").alias("grade"), "book", "trusted"))
    cw = R.claim_words(claims, script)
    counted = cw.select("claim_id", F.least(F.size("q"), X.content_words(F.col("q")) + 1).alias("quoted_words"))
    full = cands.join(about, ["corpus", "key"]).join(counted, "claim_id").withColumn("strong", F.col("similarity") >= RU.DEFAULT.required(F.col("quoted_words")))
    full = cut_lineage(full)  # read four times below; the alignment behind it is the costly step
    # records of the graded corpus do not count as a trusted book when the primary is chosen
    strong = full.filter("strong").withColumn("any_trusted", F.max("trusted").over(W.partitionBy("claim_id"))).withColumn("trusted", F.col("trusted") & (F.col("corpus") == "books"))
    primary = R.pick_primary(strong).select("claim_id", "corpus", "key", "span_start", "span_end", F.col("similarity").alias("p_sim"), "any_trusted")
    primary = with_diff(primary, corpora, cw, script).drop("span_start", "span_end")
    classes = full.filter("strong and grade is not null").select("claim_id", GR.classify_grade(F.col("grade")).alias("g"))
    extra_best = None
    if grade_rows is not None:
        heads = primary.join(about.join(union_texts(corpora), ["corpus", "key"]), ["corpus", "key"]).select("claim_id", X.normalize(F.substr("text", F.lit(1), F.lit(260)), script).alias("head"))
        extra = R.grades_for(claims, grade_rows, script, heads)
        classes = classes.unionByName(extra.select("claim_id", GR.classify_grade(F.col("grade")).alias("g")))
        extra_best = extra.groupBy("claim_id").agg(F.max("similarity").alias("g_sim"))
    classes = classes.groupBy("claim_id").agg(F.collect_set("g").alias("classes"))
    best = full.filter("rank = 1").select("claim_id", F.col("similarity").alias("b_sim"), F.col("key").alias("b_key"), F.col("corpus").alias("b_corpus"))
    j = claims.join(counted, "claim_id").join(primary, "claim_id", "left").join(best, "claim_id", "left").join(classes, "claim_id", "left")
    j = j.join(extra_best, "claim_id", "left") if extra_best is not None else j.withColumn("g_sim", F.lit(None).cast("double"))
    found = F.col("p_sim").isNotNull() | F.col("g_sim").isNotNull() | F.coalesce(F.col("b_sim") >= RU.DEFAULT.graded_partial, F.lit(False))
    sim = F.coalesce("p_sim", "g_sim", "b_sim", F.lit(0.0))
    same = F.when(F.col("p_diff").isNotNull(), A.same_wording(F.col("p_diff"), script))
    d = RU.decide_graded(
        found, sim, F.lit(False), F.coalesce("classes", F.array().cast("array<string>")), F.coalesce("any_trusted", F.lit(False)), F.col("quoted_words"), same
    )
    out = j.withColumn("d", d).withColumn("same_words", F.coalesce(same, F.lit(True))).withColumn("sim", F.round(sim, 4))
    shown = F.col("d.state") != "not_found"
    return out.select(
        *claims.columns, "quoted_words", F.col("sim").alias("similarity"), F.when(shown, F.coalesce("corpus", "b_corpus")).alias("corpus"), F.when(shown, F.coalesce("key", "b_key")).alias("key"),
        "d.*", RU.match_kind(F.col("d.rule_id"), F.col("sim"), F.col("same_words")).alias("match_kind"), F.col("p_diff").alias("diff"),
    )


def with_diff(chosen: DataFrame, corpora: dict[str, DataFrame], claims_w: DataFrame, script: str) -> DataFrame:
    """Adds p_diff, the word differences of the chosen span: one row per claim, never per candidate."""
    texts = union_texts(corpora).join(chosen.select("corpus", "key").distinct(), ["corpus", "key"], "left_semi")
    w = G.once(texts, "s", X.aligned_words(F.col("text"), script, True)).select("corpus", "key", F.col("s.norm").alias("words"), F.col("s.orig").alias("orig"))
    rows = chosen.join(w, ["corpus", "key"]).join(claims_w, "claim_id")
    n = F.col("span_end") - F.col("span_start")
    cut = lambda c: F.slice(c, F.col("span_start") + 1, n)
    return rows.withColumn("p_diff", A.word_diff("q_orig", "q", cut("orig"), cut("words"))).drop("words", "orig", "q", "q_orig")


def union_texts(corpora: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("corpus"), "key", "text") for name, df in corpora.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_saying(sayings: DataFrame, graded: DataFrame, script: str, pages: DataFrame | None = None) -> DataFrame:
    """Sayings: the graded corpus first (its words may be someone else's), then the library.

    ``sayings``: (claim_id, quote, attributed_to, level); ``graded``: (key, text, intro); ``pages``: (key, author, text).
    """
    best = graded_candidates(sayings, {"graded": graded}, script, 40, 1).select("claim_id", "key", "similarity")
    first = sayings.join(best, "claim_id", "left").join(graded.select("key", "intro"), "key", "left")
    in_corpus = F.coalesce(F.col("similarity") >= RU.DEFAULT.saying_verbatim, F.lit(False))
    first = first.withColumn("in_corpus", in_corpus).withColumn("attribution", F.when(in_corpus & L.reported_as_anothers(F.coalesce("intro", F.lit("")), F.coalesce("attributed_to", F.lit(""))), "false"))
    if pages is not None:
        rest = first.filter("not in_corpus").select("claim_id", "quote", "attributed_to")
        lib = R.library_match(rest, pages, script).select("claim_id", F.col("key").alias("page_key"), F.col("similarity").alias("page_sim"), F.col("attribution").alias("page_attr"))
        first = first.join(lib, "claim_id", "left")
    else:
        first = first.withColumns({"page_key": F.lit(None).cast(dict(graded.dtypes)["key"]), "page_sim": F.lit(None).cast("double"), "page_attr": F.lit(None).cast("string")})
    found = F.col("in_corpus") | F.col("page_key").isNotNull()
    sim = F.coalesce("page_sim", "similarity", F.lit(0.0))
    d = RU.apply_level_caps(RU.decide_saying(found, sim, F.coalesce("page_attr", "attribution")), F.col("level"))
    return first.withColumn("d", d).withColumn("sim", sim).select(
        *sayings.columns, F.col("sim").alias("similarity"), F.when(F.col("in_corpus"), F.col("key")).alias("key"), "page_key", "d.*"
    )


def verify_statement(statements: DataFrame, graded: DataFrame, script: str, recited: DataFrame | None = None) -> DataFrame:
    """Statements: supported only by an explicit text, which arrives as ``explicit_text``; topical records are listed.

    ``statements``: (claim_id, doc_id, quote, level, type, explicit_text); ``recited``: (doc_id, source_id, text).
    """
    hits = R.bm25(R.query_claims(statements, script), R.record_words(graded, script), 5, only=graded.filter(F.col("grade").isNotNull()))
    listed = hits.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("lexical_rank", "key"))).alias("c")).select("claim_id", F.transform("c", lambda x: x["key"]).alias("candidates"))
    j = G.once(statements, "by_meaning", T.attributes_to_canon(F.col("quote")) & (F.col("level") != "D")).join(listed, "claim_id", "left")
    if recited is not None:
        j = j.join(L.recited_source(statements, recited, script), "claim_id", "left")
    else:
        j = j.withColumn("source_id", F.lit(None).cast("bigint")).withColumn("shared", F.lit(None).cast("bigint"))
    about = F.col("by_meaning") | T.mentions_person(F.col("quote"))
    explicit = F.coalesce("explicit_text", F.lit(False)) & ~about & (F.col("level") != "C")
    d = F.when(F.col("by_meaning") & (F.col("level") != "C"), RU.decide_by_meaning()).otherwise(RU.decide_statement(F.col("level"), explicit))
    capped = F.when(F.col("level") == "D", RU.decide_statement(F.lit("D"), F.lit(False))).otherwise(RU.apply_level_caps(d, F.col("level")))
    return j.withColumn("d", capped).select(
        *statements.columns, "candidates", F.when(F.col("by_meaning"), F.col("source_id")).alias("compared_with"), "d.*"
    )


def referrals(verdicts: DataFrame, pages: DataFrame, script: str) -> DataFrame:
    """Referred rows with their topic words and the nearest titled page, tried on the topic words and then on the
    question's own words. ``verdicts``: (claim_id, quote, search_query, is_question, personal_case, referral).
    """
    r = G.once(verdicts.filter("referral"), "referral_query", X.referral_query(F.col("search_query"), F.col("quote"), F.col("is_question")))
    tries = r.select("claim_id", F.lit(1).alias("t"), F.col("referral_query").alias("q")).unionByName(
        r.filter("is_question and not personal_case").select("claim_id", F.lit(2).alias("t"), F.col("quote").alias("q"))
    ).filter("q is not null")
    asked = G.once(tries, "stems", X.stems(F.col("q"), script, titles=True)).withColumn("q_id", F.concat_ws("#", "claim_id", "t"))
    near = R.nearest_title(asked.select("q_id", "stems"), pages).join(asked.select("q_id", "claim_id", "t"), "q_id")
    best = near.groupBy("claim_id").agg(F.min_by(F.struct("page_id", "title", "url"), "t").alias("m"))
    return r.join(best, "claim_id", "left").select("claim_id", "referral_query", "m.page_id", "m.title", "m.url")


# --------------------------------------------------------------------------- documents to verdicts


def scan_claims(docs: DataFrame, canon: Canon, records: DataFrame, script: str) -> DataFrame:
    """Claims from both scans; a record run counts only with enough words outside the canon passages."""
    # each scan is read several times below
    c = cut_lineage(scan_canon(docs, canon))
    r = cut_lineage(scan_records(docs, records, script).withColumn("run_id", F.concat_ws("-", F.lit("r"), "doc_id", "start")))
    taken = c.select("doc_id", F.col("start_w").alias("start"), F.col("end_w").alias("end"))
    kept = C.count_outside(r.select("doc_id", "run_id", "start_w", "end_w"), G.doc_words(docs, script), taken).select("run_id")
    canon_rows = c.select("doc_id", F.lit("ayah").alias("type"), "quote", "start", "end", F.lit("canon_scan").alias("origin"))
    record_rows = r.join(kept, "run_id", "left_semi").select("doc_id", F.lit("hadith").alias("type"), "quote", "start", "end", F.lit("record_scan").alias("origin"))
    out = canon_rows.unionByName(record_rows)
    return out.select(
        F.concat_ws("-", "doc_id", "origin", "start").alias("claim_id"), "doc_id", "type", "quote", F.col("start").cast("int"), F.col("end").cast("int"),
        F.lit(None).cast("string").alias("attributed_to"), F.lit(False).alias("explicit_attribution"), F.lit("A").alias("level"), F.lit("not_applicable").alias("certainty"),
        "origin", F.lit(False).alias("closed"), F.lit(False).alias("is_question"),
    )


def all_claims(docs: DataFrame, canon: Canon, records: DataFrame, script: str, markers: list[C.Marker] = C.MARKERS, limit: int | None = None) -> DataFrame:
    """Prioritised union: scans, then delimited marker quotations, then the other marker claims; noise dropped, capped."""
    # every stage reads its inputs several times, so each is written once to the shared checkpoint folder
    marked = cut_lineage(C.extract_by_markers(docs, markers).drop("rule"))
    scanned = cut_lineage(C.prefer_sayings(scan_claims(docs, canon, records, script), marked.filter("type = 'attributed_quote'")))
    quick = cut_lineage(C.absorb_closed(scanned, marked.filter(F.col("closed") & F.col("type").isin(*C.QUOTED)), docs, script).drop("rematch"))
    rest = marked.filter(~F.col("closed") | (F.col("type") == "attributed_quote"))
    return C.cap_claims(C.drop_noise(cut_lineage(C.merge_claims(quick, rest))), limit)


def verify_documents(docs: DataFrame, canon: Canon, graded: DataFrame, script: str, markers: list[C.Marker] = C.MARKERS, pages: DataFrame | None = None) -> DataFrame:
    """Flat verdicts of every claim of every document. ``graded``: (key BIGINT, text, attribution, grade, intro)."""
    claims = all_claims(docs, canon, graded.select(F.col("key").alias("src"), "text"), script, markers)
    claims = cut_lineage(claims).withColumn("branch", RU.dispatch_branch(F.col("type"), F.col("level"), F.col("is_question"))).withColumn("transcribed", F.lit(False))
    part = lambda b: claims.filter(F.col("branch") == b)
    keep = ["claim_id", "doc_id", "type", "quote", "start", "end", "level", "is_question", "state", "rule_id", "referral"]
    shown = keep + ["similarity", "source_key"]
    canon_v = verify_canon(part("canon"), canon).withColumn("source_key", F.concat(F.lit("canon:"), F.col("p"))).select(*shown)
    graded_v = verify_graded(part("graded"), graded, script).withColumn("source_key", F.concat(F.lit("graded:"), F.col("key"))).select(*shown)
    saying_v = verify_saying(part("saying"), graded, script, pages).withColumn("source_key", F.concat(F.lit("graded:"), F.col("key"))).select(*shown)
    statement_v = verify_statement(part("statement").withColumn("explicit_text", F.lit(False)), graded, script)
    plain = part("question").withColumn("d", RU.decide_question()).unionByName(part("request").withColumn("d", RU.decide_request())).select(*claims.columns, "d.*")
    rest = statement_v.select(*keep).unionByName(plain.select(*keep))
    both = canon_v.unionByName(graded_v).unionByName(saying_v).unionByName(rest, allowMissingColumns=True)
    return C.hide_own_statements(both).withColumn("action", RU.state_action(F.col("state")))
