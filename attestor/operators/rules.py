"""Evidence rules as CASE expressions: numbers and source facts in, a decision struct out."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .intervals import length, near_pairs, shared


@dataclass(frozen=True)
class Thresholds:
    canon_near: float = 0.85
    canon_partial: float = 0.60
    canon_min_exact_words: int = 3
    graded_exact: float = 0.95
    graded_match: float = 0.80
    graded_partial: float = 0.60
    graded_min_words: int = 3
    short_words: int = 4
    short_match: float = 0.95
    partial_short_words: int = 12
    partial_short_bonus: float = 0.12
    saying_verbatim: float = 0.90

    def required(self, words: Column) -> Column:
        return F.when(words <= self.short_words, F.lit(self.short_match)).otherwise(F.lit(self.graded_match))

    def floor(self, base: float, words: Column) -> Column:
        missing = F.greatest(F.lit(0), F.lit(self.partial_short_words) - words)
        return F.round(F.lit(base) + self.partial_short_bonus * F.least(F.lit(1.0), missing / 6), 4)


DEFAULT = Thresholds()


def _decision(state: str, rule_id: str, *, referral=False, grade_unavailable=False, personal=False, disagreement=False) -> Column:
    return F.struct(
        F.lit(state).alias("state"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(referral).alias("referral"),
        F.lit(grade_unavailable).alias("grade_unavailable"),
        F.lit(personal).alias("personal_case"),
        F.lit(disagreement).alias("disagreement_noted"),
    )


def _cases(*branches: tuple[Column, Column], otherwise: Column) -> Column:
    first, *rest = branches
    out = F.when(*first)
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def decide_canon(found: Column, exact: Column, sim: Column, words: Column, explicit: Column, transcribed: Column, t: Thresholds = DEFAULT) -> Column:
    review = "needs_review"
    return _cases(
        (~found, _decision("not_found", "ayah.none", referral=True)),
        (exact & ((words >= t.canon_min_exact_words) | (sim >= 1.0)), _decision("supported", "ayah.exact")),
        (sim >= t.canon_near, _decision("supported_with_note", "ayah.near")),
        (sim < t.floor(t.canon_partial, words), _decision("not_found", "ayah.below_threshold", referral=True)),
        (explicit & transcribed, _decision(review, "ayah.altered_transcript")),
        (explicit, _decision("contradicted", "ayah.altered")),
        otherwise=_decision(review, "ayah.partial_unattributed", referral=True),
    )


def decide_graded(
    found: Column, sim: Column, paraphrase: Column, grades: Column, trusted: Column, words: Column, wording_identical: Column, t: Thresholds = DEFAULT
) -> Column:
    """``grades``: array of grade classes. A trusted collection overrides rejections; ``mixed`` counts as one."""
    review = "needs_review"
    has = lambda g: F.array_contains(grades, g)
    rejected = ~trusted & (has("weak") | has("fabricated") | has("mixed"))
    accepted = trusted | has("accepted")
    exact = accepted & (sim >= t.graded_exact) & ~paraphrase & F.coalesce(wording_identical, F.lit(True))
    return _cases(
        (~found | ((sim < t.floor(t.graded_partial, words)) & ~paraphrase), _decision("not_found", "hadith.none", referral=True)),
        (words < t.graded_min_words, _decision(review, "hadith.too_short", referral=True)),
        ((sim < t.required(words)) & ~paraphrase, _decision(review, "hadith.partial", referral=True)),
        ((accepted & rejected) | (~trusted & has("mixed")), _decision(review, "hadith.grading_conflict", referral=True)),
        (~trusted & has("fabricated"), _decision("contradicted", "hadith.fabricated")),
        (~trusted & has("weak"), _decision(review, "hadith.weak", referral=True)),
        (exact, _decision("supported", "hadith.accepted_exact")),
        (accepted & paraphrase, _decision(review, "hadith.possible_paraphrase", referral=True)),
        (accepted, _decision("supported_with_note", "hadith.accepted_near")),
        (F.size(grades) > 0, _decision(review, "hadith.grading_unclear", referral=True)),
        otherwise=_decision(review, "hadith.no_grading", referral=True, grade_unavailable=True),
    )


def decide_statement(level: Column, explicit_text: Column) -> Column:
    return _cases(
        (level == "D", _decision("needs_review", "ruling.personal_case", referral=True, personal=True)),
        (level == "C", _decision("needs_review", "ruling.disputed", referral=True, disagreement=True)),
        (explicit_text, _decision("supported", "ruling.text_found")),
        otherwise=_decision("needs_review", "ruling.no_text", referral=True),
    )


def decide_by_meaning() -> Column:
    return _decision("needs_review", "attribution.by_meaning", referral=True)


def decide_saying(found: Column, sim: Column, attribution: Column, t: Thresholds = DEFAULT) -> Column:
    """``attribution``: 'true', 'false', 'reported', 'unnamed' or null."""
    return _cases(
        (~found | (sim < t.saying_verbatim), _decision("not_found", "quote.none", referral=True)),
        (attribution == "false", _decision("contradicted", "quote.misattributed")),
        (attribution == "unnamed", _decision("supported_with_note", "quote.unnamed")),
        (attribution == "reported", _decision("supported_with_note", "quote.reported")),
        (attribution == "true", _decision("supported", "quote.verbatim")),
        otherwise=_decision("needs_review", "quote.attribution_unknown", referral=True),
    )


def decide_request() -> Column:
    return _decision("not_found", "request.no_fabrication", referral=True)


def decide_question() -> Column:
    return _decision("needs_review", "question.referral", referral=True)


def apply_level_caps(d: Column, level: Column) -> Column:
    """Level D is always a personal case under review; level C can at most be under review."""

    def made(state, suffix, personal, disagreement, unavailable) -> Column:
        return F.struct(
            state.alias("state"), F.concat(d["rule_id"], F.lit(suffix)).alias("rule_id"), F.lit(True).alias("referral"),
            unavailable.alias("grade_unavailable"), F.lit(personal).alias("personal_case"), F.lit(disagreement).alias("disagreement_noted"),
        )

    review = F.lit("needs_review")
    return (
        F.when(level == "D", made(review, "+level_d", True, False, F.lit(False)))
        .when((level == "C") & (d["state"] != "needs_review"), made(review, "+level_c", False, True, d["grade_unavailable"]))
        .when(
            level == "C",
            F.struct(
                d["state"].alias("state"), d["rule_id"].alias("rule_id"), F.lit(True).alias("referral"), d["grade_unavailable"].alias("grade_unavailable"),
                d["personal_case"].alias("personal_case"), F.lit(True).alias("disagreement_noted"),
            ),
        )
        .otherwise(d)
    )


# --------------------------------------------------------------------------- mappings and explanations


def state_action(state: Column) -> Column:
    pairs = [x for kv in V.STATE_ACTION.items() for x in map(F.lit, kv)]
    return F.create_map(*pairs)[state]


def base_rule(rule_id: Column) -> Column:
    return F.split_part(rule_id, F.lit("+"), F.lit(1))


def rule_catalogue(spark) -> DataFrame:
    rows = [(r, fam, thr) for r, (fam, thr) in V.RULE_CATALOGUE.items()]
    return spark.createDataFrame(rows, "rule_base string, family string, threshold_name string")


def explain(verdicts: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Adds limits family, the threshold the rule compared with, and why the level is what it is."""
    words = F.col("quoted_words")
    value = (
        F.when(F.col("threshold_name") == "canon_near", F.lit(t.canon_near))
        .when(F.col("threshold_name") == "canon_floor", t.floor(t.canon_partial, words))
        .when(F.col("threshold_name") == "graded_exact", F.lit(t.graded_exact))
        .when(F.col("threshold_name") == "graded_required", t.required(words))
        .when(F.col("threshold_name") == "graded_floor", t.floor(t.graded_partial, words))
        .when(F.col("threshold_name") == "saying_verbatim", F.lit(t.saying_verbatim))
    )
    reason = (
        F.when(F.col("type").isin("ayah", "hadith"), "quoted_text").when(F.col("type") == "request", "request").when(F.col("level") == "D", "personal_pattern").otherwise("default")
    )
    joined = verdicts.withColumn("rule_base", base_rule(F.col("rule_id"))).join(F.broadcast(rule_catalogue(verdicts.sparkSession)), "rule_base", "left")
    return joined.withColumn("threshold", value).withColumn("level_reason", reason).drop("rule_base", "threshold_name")


def match_kind(rule_id: Column, sim: Column, same_words: Column, t: Thresholds = DEFAULT) -> Column:
    """exact / near / partial / paraphrase of a decided row; ``same_words``: no differing word is known."""
    base = base_rule(rule_id)
    return (
        F.when(base == "ayah.exact", "exact")
        .when(base == "ayah.near", "near")
        .when(base.startswith("ayah."), "partial")
        .when(base == "hadith.possible_paraphrase", "paraphrase")
        .when(base.startswith("hadith.") & (sim >= t.graded_exact) & same_words, "exact")
        .when(base == "hadith.accepted_exact", "exact")
        .when(base == "hadith.partial", "partial")
        .when(base.startswith("hadith."), "near")
        .when(base == "ruling.text_found", "topic")
        .when(base.startswith("quote.") & (sim >= 0.999), "exact")
        .when(base.startswith("quote."), "near")
        .otherwise("referenced")
    )


def dispatch_branch(claim_type: Column, level: Column, is_question: Column) -> Column:
    """Which rule family a claim goes to: questions first, unless personal or quoted."""
    quoted = claim_type.isin("ayah", "hadith")
    return (
        F.when(is_question & ~quoted & (level != "D"), "question")
        .when(claim_type == "ayah", "canon")
        .when(claim_type == "hadith", "graded")
        .when(claim_type == "attributed_quote", "saying")
        .when(claim_type == "request", "request")
        .otherwise("statement")
    )


def copy_text(kind: Column, rule_id: Column, text: Column, ref: Column, url: Column, grades: Column, grade_unavailable: Column) -> Column:
    """Ready-to-cite string: canon text with its place, or text, reference, up to three gradings and link."""

    def graded(g: Column) -> Column:
        who = F.concat_ws(" — ", g["scholar"], g["book"])
        return F.concat(F.lit("Grading: "), F.trim(g["text"]), F.when(who != "", F.concat(F.lit(" — "), who)).otherwise(""), F.lit(" ("), g["source_name"], F.lit(")"))

    canon = F.concat(F.lit("﴿"), text, F.lit("﴾ ["), ref, F.lit("]"))
    missing = F.when(grade_unavailable, F.lit("Grading not available from the source"))
    lines = F.concat_ws("\n", F.trim(text), ref, F.array_join(F.transform(F.slice(F.coalesce(grades, F.array().cast("array<struct<text:string,scholar:string,book:string,source_name:string>>")), 1, 3), graded), "\n"), missing, url)
    lines = F.regexp_replace(lines, "\n+", "\n")
    return F.when(text.isNull() | base_rule(rule_id).isin(*V.NO_COPY_RULES), F.lit(None)).when(kind == "canon", canon).otherwise(lines)


def invariant_violations(verdicts: DataFrame) -> DataFrame:
    """Rows that must not exist: supported without source text, reference and link; raised reports by meaning; unreferred questions."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    no_source = empty("source_text") | empty("ref") | empty("url")
    return verdicts.withColumn(
        "violation",
        F.when(F.col("state").isin("supported", "supported_with_note") & no_source, "supported_without_source")
        .when((F.col("rule_id") == "attribution.by_meaning") & (F.col("state") != "needs_review"), "report_by_meaning_raised")
        .when(F.col("is_question") & ~F.col("referral"), "question_without_referral"),
    ).filter("violation is not null")


def overlapping_verdicts(verdicts: DataFrame) -> DataFrame:
    """Pairs of verdicts of one document that share more than half of the shorter one (must be empty)."""
    v = verdicts.select("doc_id", "start", "end", F.col("claim_id").alias("id"))
    pairs = near_pairs(v, v).filter(F.col("a_id") < F.col("b_id"))
    return pairs.filter(shared() > 0.5 * F.least(length("a_"), length("b_")))
