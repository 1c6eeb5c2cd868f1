"""Evidence rules, whole flows per claim type, lookups across corpora."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import fixed_values as V
from ..functions import grades as GR
from ..functions import text as X
from ..operators import claims as C
from ..operators import flows as FL
from ..operators import grams as G
from ..operators import lookup as L
from ..operators import retrieve as RT
from ..operators import rules as RU
from ..operators import scan as S
from .claim_queries import MARKERS, marked, MARKED
from .common import *  # noqa: F403
from .common import Registry
from .scan_queries import RETRIEVAL, ALTERED, CANON_SCAN, SEEDS, TITLES, _ALIGNED, _FUZZY, aligned, altered_claims, canon, span_sql, title_pages

R = Registry()

# every labelled document becomes one set of facts for the rules
FACTS = (
    f"{GRADED}, fc AS (SELECT key, grade_class, lang, length(text) % 101 / 100.0::DOUBLE AS sim, CAST(length(text) % 17 AS INT) AS words, key % 7 <> 0 AS found, key % 3 = 0 AS explicit, key % 5 = 0 AS transcribed, key % 11 = 0 AS trusted, key % 2 = 0 AS identical, "
    "CASE key % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS level FROM graded)"
)


def facts(spark, sf):
    n, k = F.length("text"), F.col("key")
    return graded(spark, sf).select(
        "key", "grade_class", "lang", (n % 101 / 100.0).alias("sim"), (n % 17).cast("int").alias("words"), (k % 7 != 0).alias("found"), (k % 3 == 0).alias("explicit"), (k % 5 == 0).alias("transcribed"),
        (k % 11 == 0).alias("trusted"), (k % 2 == 0).alias("identical"), F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (k % 4 + 1).cast("int")).alias("level"),
    )


_FLOOR = "round(0.6 + 0.12 * least(1.0, greatest(0, 12 - words) / 6), 4)"
_REQ = "CASE WHEN words <= 4 THEN 0.95 ELSE 0.8 END"


@R("rul_1_thresholds", f"WITH {FACTS} SELECT key, CAST({_REQ} AS DOUBLE) AS required, {_FLOOR} AS floor FROM fc")
def _(spark, sf):
    t = RU.DEFAULT
    return facts(spark, sf).select("key", t.required(F.col("words")).alias("required"), t.floor(t.graded_partial, F.col("words")).alias("floor"))


CANON_RULE = (
    f"CASE WHEN NOT found THEN 'not_found|ayah.none' WHEN sim >= 0.99 AND (words >= 3 OR sim >= 1.0) THEN 'supported|ayah.exact' WHEN sim >= 0.85 THEN 'supported_with_note|ayah.near' WHEN sim < {_FLOOR} THEN 'not_found|ayah.below_threshold' "
    "WHEN explicit AND transcribed THEN 'needs_review|ayah.altered_transcript' WHEN explicit THEN 'contradicted|ayah.altered' ELSE 'needs_review|ayah.partial_unattributed' END"
)


def _pair(d):
    return F.concat_ws("|", d["state"], d["rule_id"])


@R("rul_2_canon_decision", f"WITH {FACTS} SELECT key, {CANON_RULE} AS decision FROM fc")
def _(spark, sf):
    d = RU.decide_canon(F.col("found"), F.col("sim") >= 0.99, F.col("sim"), F.col("words"), F.col("explicit"), F.col("transcribed"))
    return facts(spark, sf).withColumn("d", d).select("key", _pair(F.col("d")).alias("decision"))


GRADED_RULE = (
    f"CASE WHEN NOT found OR sim < {_FLOOR} THEN 'not_found|hadith.none' WHEN words < 3 THEN 'needs_review|hadith.too_short' WHEN sim < {_REQ} THEN 'needs_review|hadith.partial' "
    "WHEN NOT trusted AND grade_class = 'mixed' THEN 'needs_review|hadith.grading_conflict' WHEN NOT trusted AND grade_class = 'fabricated' THEN 'contradicted|hadith.fabricated' WHEN NOT trusted AND grade_class = 'weak' THEN 'needs_review|hadith.weak' "
    "WHEN sim >= 0.95 AND identical THEN 'supported|hadith.accepted_exact' ELSE 'supported_with_note|hadith.accepted_near' END"
)


def graded_facts(spark, sf):
    d = RU.decide_graded(F.col("found"), F.col("sim"), F.lit(False), F.array("grade_class"), F.col("trusted"), F.col("words"), F.col("identical"))
    return facts(spark, sf).withColumn("d", d)


@R("rul_3_graded_decision", f"WITH {FACTS} SELECT key, {GRADED_RULE} AS decision FROM fc")
def _(spark, sf):
    return graded_facts(spark, sf).select("key", _pair(F.col("d")).alias("decision"))


STATEMENT_RULE = "CASE level WHEN 'D' THEN 'needs_review|ruling.personal_case' WHEN 'C' THEN 'needs_review|ruling.disputed' ELSE CASE WHEN explicit THEN 'supported|ruling.text_found' ELSE 'needs_review|ruling.no_text' END END"


@R("rul_4_statement_decision", f"WITH {FACTS} SELECT key, {STATEMENT_RULE} AS decision FROM fc")
def _(spark, sf):
    return facts(spark, sf).withColumn("d", RU.decide_statement(F.col("level"), F.col("explicit"))).select("key", _pair(F.col("d")).alias("decision"))


@R("rul_5_7_constant_decisions", f"WITH {FACTS} SELECT key, CASE key % 3 WHEN 0 THEN 'needs_review|attribution.by_meaning' WHEN 1 THEN 'not_found|request.no_fabrication' ELSE 'needs_review|question.referral' END AS decision, TRUE AS referral FROM fc")
def _(spark, sf):
    k = F.col("key") % 3
    d = F.when(k == 0, RU.decide_by_meaning()).when(k == 1, RU.decide_request()).otherwise(RU.decide_question())
    return facts(spark, sf).withColumn("d", d).select("key", _pair(F.col("d")).alias("decision"), "d.referral")


ATTR = "CASE key % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'reported' WHEN 3 THEN 'unnamed' END"
SAYING_RULE = (
    f"CASE WHEN NOT found OR sim < 0.9 THEN 'not_found|quote.none' WHEN {ATTR} = 'false' THEN 'contradicted|quote.misattributed' WHEN {ATTR} = 'unnamed' THEN 'supported_with_note|quote.unnamed' "
    f"WHEN {ATTR} = 'reported' THEN 'supported_with_note|quote.reported' WHEN {ATTR} = 'true' THEN 'supported|quote.verbatim' ELSE 'needs_review|quote.attribution_unknown' END"
)


@R("rul_6_saying_decision", f"WITH {FACTS} SELECT key, {SAYING_RULE.replace('sim < 0.9', 'sim + 0.5 < 0.9')} AS decision FROM fc")
def _(spark, sf):
    k = F.col("key") % 5
    a = F.when(k == 0, "true").when(k == 1, "false").when(k == 2, "reported").when(k == 3, "unnamed")
    return facts(spark, sf).withColumn("d", RU.decide_saying(F.col("found"), F.col("sim") + 0.5, a)).select("key", _pair(F.col("d")).alias("decision"))


@R(
    "rul_8_level_caps",
    f"WITH {FACTS}, d AS (SELECT key, level, {GRADED_RULE} AS x FROM fc) SELECT key, CASE WHEN level = 'D' THEN 'needs_review|' || split_part(x, '|', 2) || '+level_d' WHEN level = 'C' AND split_part(x, '|', 1) <> 'needs_review' THEN 'needs_review|' || split_part(x, '|', 2) || '+level_c' ELSE x END AS decision, level = 'D' AS personal_case, level = 'C' AS disagreement_noted FROM d",
)
def _(spark, sf):
    d = graded_facts(spark, sf).withColumn("c", RU.apply_level_caps(F.col("d"), F.col("level")))
    return d.select("key", _pair(F.col("c")).alias("decision"), "c.personal_case", "c.disagreement_noted")


def _kw(words):
    return r"(?:^|[^\x{0621}-\x{064A}])[وف]?[بلك]?(?:ال)?(?:" + "|".join(words) + ")"


# letters of the texts read as grading words, so that every class occurs
GRADE_TEXT = "CASE key % 6 WHEN 0 THEN 'حديثٌ صحيحٌ' WHEN 1 THEN 'لا يصحّ' WHEN 2 THEN 'موضوع ' || lang WHEN 3 THEN 'إسناده ضعيف وله شواهد' WHEN 4 THEN 'روي من وجه صحيح ومن وجه ضعيف' ELSE lang END"
_GN = norm_ar_sql("gt")


@R(
    "rul_9_grade_classes",
    rf"""WITH {GRADED}, g AS (SELECT key, {GRADE_TEXT} AS gt FROM graded), n AS (SELECT key, {_GN} AS t FROM g), c AS (SELECT key, regexp_matches(t, '{_kw(V.GRADE_FABRICATED)}') AS f, regexp_matches(t, '{_kw(V.GRADE_WEAK)}') AS w,
    regexp_matches(regexp_replace(regexp_replace(t, '{_kw(V.GRADE_WEAK)}', ' ', 'g'), '{_kw(V.GRADE_FABRICATED)}', ' ', 'g'), '{_kw(V.GRADE_ACCEPTED)}') AS a FROM n)
    SELECT key, CASE WHEN a AND (w OR f) THEN 'mixed' WHEN f THEN 'fabricated' WHEN w THEN 'weak' WHEN a THEN 'accepted' ELSE 'unknown' END AS class FROM c""",
)
def _(spark, sf):
    texts = F.array(F.lit("حديثٌ صحيحٌ"), F.lit("لا يصحّ"), F.concat(F.lit("موضوع "), "lang"), F.lit("إسناده ضعيف وله شواهد"), F.lit("روي من وجه صحيح ومن وجه ضعيف"), F.col("lang"))
    return graded(spark, sf).select("key", GR.classify_grade(F.get(texts, (F.col("key") % 6).cast("int"))).alias("class"))


@R("rul_10_trusted_collection", f"WITH {GRADED} SELECT key, key % 3 = 0 AS trusted FROM graded")
def _(spark, sf):
    line = F.when(F.col("key") % 3 == 0, F.concat(F.lit("رواه البُخاري — "), "attribution")).otherwise(F.concat(F.lit("رواه "), "attribution"))
    return graded(spark, sf).select("key", GR.in_trusted_collection(line).alias("trusted"))


@R(
    "rul_11_actions",
    f"WITH {VERDICTS} SELECT claim_id, CASE state WHEN 'supported' THEN 'adopt' WHEN 'supported_with_note' THEN 'correct_wording' WHEN 'needs_review' THEN 'refer_to_scholars' WHEN 'not_found' THEN 'remove_or_request_source' ELSE 'remove_and_warn' END AS action FROM verdicts",
)
def _(spark, sf):
    return verdict_rows(spark, sf).select("claim_id", RU.state_action(F.col("state")).alias("action"))


@R("rul_11_invariant", f"WITH {VERDICTS} SELECT claim_id, CASE WHEN state IN ('supported', 'supported_with_note') AND claim_id % 10 = 0 THEN 'supported_without_source' ELSE 'question_without_referral' END AS violation FROM verdicts WHERE (state IN ('supported', 'supported_with_note') AND claim_id % 10 = 0) OR (is_question AND claim_id % 2 = 0)")
def _(spark, sf):
    v = verdict_rows(spark, sf).withColumns(
        {"source_text": F.when(F.col("claim_id") % 10 != 0, "text"), "ref": F.col("source"), "url": F.col("source"), "rule_id": F.lit("hadith.accepted_exact"), "referral": F.col("claim_id") % 2 != 0}
    )
    return RU.invariant_violations(v).select("claim_id", "violation")


_OVP = "least(a.e, b.e) - greatest(a.start, b.start) > 0.5 * least(a.e - a.start, b.e - b.start)"


@R("rul_11_overlapping_verdicts", f"WITH {MARKED} SELECT a.cid AS a_id, b.cid AS b_id FROM mk a JOIN mk b ON a.doc_id = b.doc_id AND a.cid < b.cid AND {_OVP}")
def _(spark, sf):
    return RU.overlapping_verdicts(marked(spark, sf)).select("a_id", "b_id")


@R(
    "rul_12_explanations",
    f"WITH {FACTS}, d AS (SELECT key, level, words, split_part({GRADED_RULE}, '|', 2) AS r FROM fc) SELECT key, CASE WHEN r IN ('hadith.none', 'hadith.partial', 'hadith.too_short') THEN 'hadith_not_found' ELSE 'hadith_found' END AS family, "
    f"CASE WHEN r = 'hadith.none' THEN {_FLOOR} WHEN r = 'hadith.too_short' THEN NULL WHEN r = 'hadith.accepted_exact' THEN 0.95::DOUBLE ELSE CAST({_REQ} AS DOUBLE) END AS threshold, 'quoted_text' AS level_reason FROM d",
)
def _(spark, sf):
    v = graded_facts(spark, sf).select("key", F.lit("hadith").alias("type"), "level", F.col("words").alias("quoted_words"), "d.rule_id")
    return RU.explain(v).select("key", "family", "threshold", "level_reason")


@R(
    "rul_13_match_kind",
    f"WITH {FACTS}, d AS (SELECT key, sim, identical, split_part({GRADED_RULE}, '|', 2) AS r FROM fc) SELECT key, CASE WHEN sim >= 0.95 AND identical THEN 'exact' WHEN r = 'hadith.accepted_exact' THEN 'exact' WHEN r = 'hadith.partial' THEN 'partial' ELSE 'near' END AS kind FROM d",
)
def _(spark, sf):
    return graded_facts(spark, sf).select("key", RU.match_kind(F.col("d.rule_id"), F.col("sim"), F.col("identical")).alias("kind"))


@R("rul_14_dispatch", f"WITH {VERDICTS}, v AS (SELECT *, CASE claim_id % 5 WHEN 0 THEN 'ayah' WHEN 1 THEN 'hadith' WHEN 2 THEN 'attributed_quote' WHEN 3 THEN 'request' ELSE 'ruling' END AS t FROM verdicts) SELECT claim_id, CASE WHEN is_question AND t NOT IN ('ayah', 'hadith') AND claim_id % 4 <> 3 THEN 'question' ELSE CASE t WHEN 'ayah' THEN 'canon' WHEN 'hadith' THEN 'graded' WHEN 'attributed_quote' THEN 'saying' WHEN 'request' THEN 'request' ELSE 'statement' END END AS branch FROM v")
def _(spark, sf):
    k = F.col("claim_id")
    t = F.element_at(F.array(*[F.lit(x) for x in ("ayah", "hadith", "attributed_quote", "request", "ruling")]), (k % 5 + 1).cast("int"))
    return verdict_rows(spark, sf).select("claim_id", RU.dispatch_branch(t, F.when(k % 4 == 3, "D").otherwise("A"), F.col("is_question")).alias("branch"))


# --------------------------------------------------------------------------- flows


@R("rul_15_graded_flow", None)
def _(spark, sf):
    v = FL.verify_graded(passage_claims(spark, sf), graded(spark, sf), SCRIPT)
    return v.select("claim_id", "key", "similarity", "state", "rule_id", "match_kind", "quoted_words")


@R(
    "rul_16_canon_flow",
    f"""WITH {CANON}, {IDF}, {ALTERED}, {SEEDS}, {_FUZZY}, {span_sql('wp', 'claim_id,seed_rank')}, r AS (SELECT claim_id, round(score, 4) AS sim, len(qc.q) AS words FROM sp JOIN wn USING (claim_id, seed_rank) JOIN qc USING (claim_id) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 9) DESC, seed_rank) = 1)
    SELECT claim_id, sim AS similarity, CASE WHEN sim >= 0.999 THEN 'ayah.exact' WHEN sim >= 0.85 THEN 'ayah.near' WHEN sim < {_FLOOR} THEN 'ayah.below_threshold' ELSE 'ayah.altered' END AS rule_id FROM r""",
)
def _(spark, sf):
    q = altered_claims(spark, sf).select("claim_id", F.array_join("q", " ").alias("quote"), F.lit(True).alias("explicit_attribution"), F.lit(False).alias("transcribed"))
    return FL.verify_canon(q, canon(spark, sf)).select("claim_id", "similarity", "rule_id")


def corpus_records(spark, sf):
    """The labelled documents as the graded corpus of a whole flow."""
    return graded(spark, sf).select("key", "text", "attribution", "grade", "intro")


@R("flow_all_claims", None)
def _(spark, sf):
    records = corpus_records(spark, sf).select(F.col("key").alias("src"), "text")
    return FL.all_claims(documents(spark, sf), canon(spark, sf), records, SCRIPT, MARKERS).select("claim_id", "doc_id", "type", "quote", "start", "end", "origin", "index")


@R("rul_17_saying_flow", None)
def _(spark, sf):
    s = passage_claims(spark, sf).withColumn("attributed_to", F.lit("ابن تيمية")).withColumn("level", F.lit("B"))
    pages = documents(spark, sf, "source").select(F.col("doc_id").alias("key"), F.col("source").alias("author"), "text")
    return FL.verify_saying(s, graded(spark, sf), SCRIPT, pages).select("claim_id", "key", "page_key", "state", "rule_id")


@R("rul_18_statement_flow", None)
def _(spark, sf):
    c = passage_claims(spark, sf).select("claim_id", F.col("claim_id").cast("bigint").alias("doc_id"), "quote", F.lit("A").alias("level"), F.lit("fact").alias("type"), (F.col("claim_id").cast("int") % 2 == 0).alias("explicit_text"))
    return FL.verify_statement(c, graded(spark, sf), SCRIPT).select("claim_id", F.array_join("candidates", ",").alias("candidates"), "state", "rule_id")


NEAR = (
    "qa AS (SELECT q_id, stem, coalesce(idf, 0) AS idf FROM (SELECT q_id, unnest(stems) AS stem FROM tq) LEFT JOIN ti USING (stem)), qtot AS (SELECT q_id, sum(idf) AS total, count(*) AS size FROM qa GROUP BY q_id), "
    "hit AS (SELECT q_id, page_id, sum(idf) AS s, count(*) AS shared FROM qa JOIN (SELECT page_id, unnest(stems) AS stem FROM tf) USING (stem) GROUP BY ALL), "
    "nr AS (SELECT q_id, page_id, title, url, s / total AS coverage, shared, s / total - 0.02 * greatest(0, len(stems) - shared) AS rank FROM hit JOIN qtot USING (q_id) JOIN tf USING (page_id) WHERE total > 0 AND round(s / total, 9) >= 0.8 AND shared >= least(2, size)), "
    "nb AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(rank, 9) DESC, page_id) = 1)"
)


@R(
    "joi_9_nearest_title",
    f"WITH {TITLES}, tq AS (SELECT page_id AS q_id, list_filter(stems, lambda x, i: i <> 1) AS stems FROM (SELECT page_id, list_sort(stems) AS stems FROM tf) WHERE len(stems) > 1), {NEAR} SELECT q_id, page_id, round(coverage, 6) AS coverage, shared, round(rank, 6) AS rank FROM nb",
)
def _(spark, sf):
    p = title_pages(spark, sf)
    # every title asks with all its stems but the first in alphabetical order
    q = p.filter(F.size("stems") > 1).select(F.col("page_id").alias("q_id"), F.slice(F.array_sort("stems"), F.lit(2), F.size("stems")).alias("stems"))
    return RT.nearest_title(q, p).select("q_id", "page_id", F.round("coverage", 6).alias("coverage"), F.col("shared").cast("bigint").alias("shared"), F.round("rank", 6).alias("rank"))


@R("rul_19_referrals", None)
def _(spark, sf):
    p = title_pages(spark, sf)
    v = p.select(F.col("page_id").cast("string").alias("claim_id"), F.col("title").alias("quote"), F.lit(None).cast("string").alias("search_query"), F.lit(True).alias("is_question"), (F.col("page_id") % 4 == 0).alias("personal_case"), F.lit(True).alias("referral"))
    return FL.referrals(v, p, SCRIPT).select("claim_id", "referral_query", "page_id")


ST = f"list_distinct(list_filter({{}}, lambda x: length(x) > 3))"


@R(
    "joi_10_shared_vocabulary",
    f"WITH s AS (SELECT doc_id, {ST.format(tokens_sql('text'))} AS s FROM documents) SELECT a.doc_id, len(list_intersect(a.s, b.s)) AS shared, CASE WHEN len(a.s) = 0 THEN 0.0 ELSE round(len(list_intersect(a.s, b.s)) / len(a.s), 6) END AS ratio FROM s a JOIN s b ON b.doc_id = a.doc_id + 1",
)
def _(spark, sf):
    d = documents(spark, sf)
    pairs = d.select("doc_id", F.col("text").alias("quote")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), "text"), "doc_id")
    return RT.with_shared_vocabulary(pairs, SCRIPT).select("doc_id", F.col("shared").cast("bigint").alias("shared"), F.round("ratio", 6).alias("ratio"))


@R("joi_20_words_of_another_corpus", f"WITH {_ALIGNED}, b AS (SELECT sp.claim_id, sp.key, round(sp.score, 4) AS sim FROM sp JOIN rk USING (claim_id, key) QUALIFY row_number() OVER (PARTITION BY sp.claim_id ORDER BY round(sp.score, 4) DESC, lexical_rank, sp.key) = 1) SELECT qs.claim_id, CASE WHEN sim >= 0.95 THEN key END AS other_key FROM qs LEFT JOIN b USING (claim_id)")
def _(spark, sf):
    best = RT.rank_candidates(RT.union_corpora(("graded", aligned(spark, sf))), 1).join(graded(spark, sf).select("key", F.col("url").alias("ref"), "grade"), "key")
    v = passage_claims(spark, sf).withColumn("state", F.lit("not_found"))
    return L.words_of_another_corpus(v, best.select("claim_id", "key", "ref", "grade", "similarity")).select("claim_id", "other_key")


@R(
    "joi_21_recited_source",
    f"""WITH {GRADED}, l AS (SELECT item_id AS claim_id, item_id % 5 AS doc_id, unnest({ST.format(tokens_sql('text'))}) AS stem FROM benchmark), r AS (SELECT key AS source_id, key % 5 AS doc_id, unnest({ST.format(tokens_sql('text'))}) AS stem FROM graded),
    v AS (SELECT claim_id, source_id, count(*) AS shared FROM l JOIN r USING (doc_id, stem) GROUP BY ALL HAVING count(*) >= 2) SELECT claim_id, source_id, shared FROM v QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY shared DESC, source_id) = 1""",
)
def _(spark, sf):
    s = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), (F.col("item_id") % 5).alias("doc_id"), F.col("text").alias("quote"))
    r = graded(spark, sf).select(F.col("key").alias("source_id"), (F.col("key") % 5).alias("doc_id"), "text")
    return L.recited_source(s, r, SCRIPT)


@R("joi_22_grades_of_a_text", None)
def _(spark, sf):
    g = graded(spark, sf).select("key", "text", F.col("lang").alias("narrator"), F.col("attribution").alias("scholar"), F.col("lang").alias("book"), "grade", "url")
    return RT.grades_for(passage_claims(spark, sf), g, SCRIPT).select("claim_id", "key", "grade", "similarity", "place")


@R(
    "joi_23_topical_alternatives",
    f"""WITH {RETRIEVAL}, cs AS (SELECT claim_id, {ST.format(tokens_sql('quote'))} AS s FROM qs), gs AS (SELECT key, {ST.format(tokens_sql('text'))} AS s FROM graded WHERE grade_class = 'accepted'),
    p AS (SELECT claim_id, key, lexical_rank, len(list_intersect(cs.s, gs.s)) AS shared, len(cs.s) AS n FROM rk JOIN cs USING (claim_id) JOIN gs USING (key))
    SELECT claim_id, key, CAST(shared AS INT) AS shared, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY lexical_rank) AS INT) AS place FROM p WHERE shared >= 2 AND (shared >= 3 OR shared / n >= 0.3) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY lexical_rank) <= 6""",
)
def _(spark, sf):
    c = passage_claims(spark, sf).withColumns({"state": F.lit("not_found"), "rule_id": F.lit("hadith.none"), "level": F.lit("A"), "source_url": F.lit(None).cast("string")})
    return RT.topical_alternatives(c, graded(spark, sf), SCRIPT).select("claim_id", "key", "shared", "place")


@R("joi_24_library_match", None)
def _(spark, sf):
    s = passage_claims(spark, sf).withColumn("attributed_to", F.lit("web"))
    pages = documents(spark, sf, "source").select(F.col("doc_id").alias("key"), F.col("source").alias("author"), "text")
    return RT.library_match(s, pages, SCRIPT).select("claim_id", "key", "similarity", "attribution")


@R("joi_28_proposed_reference", f"WITH {CANON}, s AS (SELECT group_no, unit_no, {ST.format(tokens_sql('text'))} AS s FROM cu), c AS (SELECT item_id AS claim_id, {ST.format(tokens_sql('text'))} AS s, item_id // 8 + 1 AS group_no, (item_id + 1) % 8 + 1 AS unit_no FROM benchmark) SELECT claim_id, s.group_no, s.unit_no, len(list_intersect(c.s, s.s)) AS shared FROM c JOIN s ON s.group_no = c.group_no AND s.unit_no = c.unit_no WHERE len(list_intersect(c.s, s.s)) >= 1")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    ref = F.concat((F.floor(F.col("item_id") / 8) + 1).cast("string"), F.lit(" : "), ((F.col("item_id") + 1) % 8 + 1).cast("string"))
    c = b.select(F.col("item_id").alias("claim_id"), F.col("text").alias("quote"), F.lit("A").alias("level"), ref.alias("evidence_ref"))
    return L.by_proposed_reference(c, canon_units(spark, sf), SCRIPT).withColumn("shared", F.col("shared").cast("bigint"))


@R(
    "joi_29_parallel_text",
    f"WITH {CANON}, r AS (SELECT item_id AS claim_id, item_id // 8 + 1 AS group_no, item_id % 8 + 1 AS a, item_id % 8 + 3 AS b FROM benchmark), j AS (SELECT claim_id, count(*) AS n, string_agg(text, ' ' ORDER BY unit_no) AS t FROM r JOIN cu ON cu.group_no = r.group_no AND unit_no BETWEEN a AND b GROUP BY claim_id) SELECT r.claim_id, CASE WHEN n = 3 THEN t END AS parallel_text FROM r JOIN j USING (claim_id)",
)
def _(spark, sf):
    r = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), (F.floor(F.col("item_id") / 8) + 1).cast("int").alias("group_no"), (F.col("item_id") % 8 + 1).cast("int").alias("unit_start"), (F.col("item_id") % 8 + 3).cast("int").alias("unit_end"))
    return L.parallel_text(r, canon_units(spark, sf).select("group_no", "unit_no", F.col("text_match").alias("text"))).select("claim_id", "parallel_text")


# --------------------------------------------------------------------------- comparison of wordings


# Every fifth word of a passage is replaced, every seventh left out, and a word put in behind every eleventh.
_CHANGED = "CASE WHEN i % 5 = 0 THEN ['zz' || i] WHEN i % 7 = 0 THEN [] ELSE [x] END || CASE WHEN i % 11 = 0 THEN ['yy' || i] ELSE [] END"


@R(
    "aln_3_word_diff",
    f"""WITH w AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w)
    SELECT item_id, count(*) FILTER (i % 5 <> 0 AND i % 7 <> 0) AS equal, string_agg(CASE WHEN i % 5 = 0 THEN 'zz' || i || CASE WHEN i % 11 = 0 THEN ' yy' || i ELSE '' END WHEN i % 11 = 0 THEN 'yy' || i END, ' ' ORDER BY i) AS changed,
           string_agg(CASE WHEN i % 5 = 0 OR i % 7 = 0 THEN x END, ' ' ORDER BY x) AS missing, TRUE AS whole FROM u GROUP BY item_id""",
)
def _(spark, sf):
    b = G.once(table(spark, sf, "benchmark"), "w", X.words(F.col("text"), SCRIPT))
    at = lambda name, i: F.array(F.concat(F.lit(name), (i + 1).cast("string")))
    none = F.array().cast("array<string>")
    changed = F.transform("w", lambda x, i: F.concat(F.when((i + 1) % 5 == 0, at("zz", i)).when((i + 1) % 7 == 0, none).otherwise(F.array(x)), F.when((i + 1) % 11 == 0, at("yy", i)).otherwise(none)))
    d = G.once(b, "q", F.flatten(changed)).select("item_id", "q", "w", A.word_diff("q", "q", "w", "w").alias("diff"))
    said = lambda side, op: F.array_join(F.filter(F.transform(F.filter("diff", op), lambda x: x[side]), lambda x: x != ""), " ")
    every, other = (lambda x: F.lit(True)), (lambda x: x["op"] != "equal")
    return d.select(
        "item_id", F.size(F.split(said("source", lambda x: x["op"] == "equal"), " ")).cast("bigint").alias("equal"), said("quoted", other).alias("changed"), F.array_join(F.array_sort(F.split(said("source", other), " ")), " ").alias("missing"),
        ((said("quoted", every) == F.array_join("q", " ")) & (said("source", every) == F.array_join("w", " "))).alias("whole"),
    )


def respelled(spark, sf):
    """Passages of even number with the last letter of long words changed, the others with each seventh word left out."""
    b = G.once(table(spark, sf, "benchmark"), "w", X.words(F.col("text"), SCRIPT))
    near = F.transform("w", lambda x: F.when(F.length(x) >= 5, F.concat(F.substr(x, F.lit(1), F.length(x) - 1), F.lit("q"))).otherwise(x))
    q = F.when(F.col("item_id") % 2 == 0, near).otherwise(F.filter("w", lambda x, i: (i + 1) % 7 != 0))
    return G.once(b, "q", q).withColumn("diff", A.word_diff("q", "q", "w", "w"))


@R("aln_4_same_wording", "SELECT item_id, item_id % 2 = 0 AS same FROM benchmark")
def _(spark, sf):
    return respelled(spark, sf).select("item_id", A.same_wording(F.col("diff"), SCRIPT).alias("same"))


PREFIXES = f"w AS (SELECT CAST(item_id AS VARCHAR) AS claim_id, {words_sql('text')} AS w FROM benchmark), p AS (SELECT claim_id, len(w) AS words, unnest([5, 7, 9, 12, 16, 20, 26, 34, 45]) AS n FROM w), t AS (SELECT claim_id, words, n, (n * 7 + words) % 100 / 100.0::DOUBLE AS sim FROM p WHERE n < words)"


def prefix_tries(spark, sf):
    w = G.once(passage_claims(spark, sf), "n", F.size(X.words(F.col("quote"), SCRIPT)))
    tries = F.transform(A.prefix_lengths(F.col("n")), lambda x: F.struct(x.alias("n"), ((x * 7 + F.col("n")) % 100 / 100.0).alias("sim")))
    return G.once(w, "t", tries)


@R(
    "aln_5_open_quotation",
    f"""WITH RECURSIVE {PREFIXES}, o AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n) AS k FROM t), f(claim_id, words, k, bn, bs) AS (SELECT claim_id, len(w), 0, len(w), 0.3::DOUBLE FROM w
    UNION ALL SELECT f.claim_id, f.words, o.k, CASE WHEN g OR (NOT g AND h) THEN o.n ELSE bn END, CASE WHEN g OR (NOT g AND h) THEN o.sim ELSE bs END FROM f JOIN o ON o.claim_id = f.claim_id AND o.k = f.k + 1, LATERAL (SELECT o.sim >= 0.8 AND (bs < 0.8 OR o.n > bn OR bn = f.words) AS g, bs < 0.8 AND o.sim > bs + 0.02 AS h))
    SELECT claim_id, CAST(arg_max(bn, k) AS INT) AS keep FROM f GROUP BY claim_id""",
)
def _(spark, sf):
    return prefix_tries(spark, sf).select("claim_id", A.choose_open_prefix(F.col("n"), F.lit(0.3), F.col("t")).alias("keep"))


@R("aln_6_verbatim_prefix", f"WITH {PREFIXES} SELECT w.claim_id, CAST(max(n) AS INT) AS keep FROM w LEFT JOIN t ON t.claim_id = w.claim_id AND sim >= 0.9 GROUP BY w.claim_id")
def _(spark, sf):
    return prefix_tries(spark, sf).select("claim_id", A.longest_verbatim_prefix(F.col("n"), F.col("t")).alias("keep"))


@R(
    "aln_8_collation",
    f"""WITH w AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark WHERE item_id % 2 = 0), u AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS j FROM w)
    SELECT CAST(item_id AS VARCHAR) AS claim_id, 0 AS span_start, CAST(count(*) AS INT) AS span_end, coalesce(string_agg(CASE WHEN length(x) >= 5 AND NOT x LIKE '%q' THEN CAST(j AS VARCHAR) END, ',' ORDER BY j), '') AS marks FROM u GROUP BY item_id""",
)
def _(spark, sf):
    r = respelled(spark, sf).filter(F.col("item_id") % 2 == 0)
    v = r.select(F.col("item_id").cast("string").alias("claim_id"), F.array_join("q", " ").alias("quote"), "diff", F.col("text").alias("source_text"))
    return A.collate_verdicts(v, SCRIPT).select("claim_id", "collation.span_start", "collation.span_end", F.array_join("collation.marks", ",").alias("marks"))


@R(
    "aln_10_source_window",
    rf"WITH s AS (SELECT item_id, trim(regexp_replace(text, '[\s\pZ]+', ' ', 'g')) AS t FROM benchmark), p AS (SELECT item_id, t, string_split(t, ' ') AS w FROM s) SELECT item_id, array_to_string(w[1:3], ' ') || ' ' AS before, '' AS after, TRUE AS unquoted FROM p",
)
def _(spark, sf):
    t = X.squeeze(F.col("text"))
    b = G.once(table(spark, sf, "benchmark").select("item_id", "text"), "w", F.split(t, " "))
    step = lambda op, c: F.struct(F.lit(op).alias("op"), F.lit("").alias("quoted"), c.alias("source"))
    half = F.floor((F.size("w") - 3) / 2).cast("int")
    d = F.array(step("equal", F.array_join(F.slice("w", F.lit(4), half), " ")), step("insert", F.array_join(F.slice("w", half + 4, F.size("w")), " ")))
    b = G.once(b, "d", d)
    win = A.source_window(F.col("d"), F.col("text"))
    return b.select("item_id", win["before"].alias("before"), win["after"].alias("after"), A.has_unquoted(F.col("d")).alias("unquoted"))


@R("str_1_scan_verdicts", f"WITH RECURSIVE {CANON_SCAN} SELECT doc_id, CAST(i AS INT) AS start_w, CAST(i + len AS INT) AS end_w, 'supported' AS state, 'ayah.exact' AS rule_id, 'adopt' AS action FROM gr")
def _(spark, sf):
    """The certain verdicts, as the first of the two streams emits them for a batch of documents."""
    c = canon(spark, sf)
    runs = S.canon_scan(G.doc_words(documents(spark, sf), SCRIPT), c.tokens, c.idf, c.small)
    yes, no = F.lit(True), F.lit(False)
    d = RU.decide_canon(yes, yes, F.lit(1.0), F.col("end_w") - F.col("start_w"), no, no)
    return runs.withColumn("d", d).select("doc_id", "start_w", "end_w", "d.state", "d.rule_id", RU.state_action(F.col("d.state")).alias("action"))
