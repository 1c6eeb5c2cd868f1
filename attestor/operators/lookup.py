"""Lookups by reference, parallel texts, fragment extension, notes across corpora."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import tags as T
from ..functions import text as X
from . import grams as G


def by_proposed_reference(claims: DataFrame, units: DataFrame, script: str) -> DataFrame:
    """Level-A claims that name ``group:unit`` and share a stem with that unit: (claim_id, group_no, unit_no, shared)."""
    ref = r"^\s*(\d{1,3})\s*:\s*(\d{1,3})\s*$"
    named = claims.filter((F.col("level") == "A") & F.col("evidence_ref").rlike(ref)).select(
        "claim_id", "quote", F.regexp_extract("evidence_ref", ref, 1).cast("int").alias("group_no"), F.regexp_extract("evidence_ref", ref, 2).cast("int").alias("unit_no")
    )
    pairs = named.join(units.select("group_no", "unit_no", "text_match"), ["group_no", "unit_no"])
    s = G.once(pairs, "shared", F.size(F.array_intersect(X.stems(F.col("quote"), script), X.stems(F.col("text_match"), script))))
    return s.filter("shared >= 1").select("claim_id", "group_no", "unit_no", "shared")


def parallel_text(ranges: DataFrame, parallel: DataFrame, max_units: int = 10) -> DataFrame:
    """Parallel text of a unit range, parts in order; null when a part is missing or the range is too long.

    ``ranges``: (claim_id, group_no, unit_start, unit_end); ``parallel``: (group_no, unit_no, text).
    """
    short = ranges.withColumn("want", F.col("unit_end") - F.col("unit_start") + 1)
    asked = short.filter(F.col("want").between(1, max_units)).withColumn("unit_no", F.explode(F.sequence("unit_start", "unit_end")))
    found = asked.join(parallel.filter(F.length(F.trim("text")) > 0), ["group_no", "unit_no"])
    parts = found.groupBy("claim_id", "want").agg(F.array_sort(F.collect_list(F.struct("unit_no", "text"))).alias("p"), F.count("*").alias("n"))
    whole = parts.filter("n = want").select("claim_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("parallel_text"))
    return ranges.join(whole, "claim_id", "left")


def same_reference(preds: DataFrame, rows: DataFrame, units: DataFrame, script: str) -> DataFrame:
    """(id, same_ref): equal references, canon units that contain each other's words, or the same corpus family.

    References look like ``canon:g:u``, ``graded:id``, ``books:key``, ``grades``.
    """
    both = rows.select("id", "expected_ref").join(preds.select("id", "ref"), "id")
    text = G.once(units.select("group_no", "unit_no", F.col("text_match").alias("t")), "norm", X.normalize(F.col("t"), script)).select(
        F.concat_ws(":", F.lit("canon"), "group_no", "unit_no").alias("r"), "norm"
    )
    joined = both.join(text.toDF("expected_ref", "want_text"), "expected_ref", "left").join(text.toDF("ref", "got_text"), "ref", "left")
    within = F.col("got_text").contains(F.col("want_text")) | F.col("want_text").contains(F.col("got_text"))
    family = F.split_part("expected_ref", F.lit(":"), F.lit(1))
    records = F.col("ref").startswith("graded:") | F.col("ref").startswith("books") | F.col("ref").startswith("grades")
    same = (F.col("ref") == F.col("expected_ref")) | ((family == "canon") & within) | (family.isin("graded", "grades") & records)
    return joined.select("id", F.coalesce(same, F.lit(False)).alias("same_ref"))


def words_of_another_corpus(canon_verdicts: DataFrame, best_records: DataFrame, exact: float = 0.95) -> DataFrame:
    """Canon claims not found there whose words stand in the graded corpus: adds other_key, other_ref, other_grade.

    ``best_records``: best candidate per claim (claim_id, key, ref, grade, similarity).
    """
    best = best_records.filter(F.col("similarity") >= exact).select("claim_id", F.col("key").alias("other_key"), F.col("ref").alias("other_ref"), F.col("grade").alias("other_grade"))
    out = canon_verdicts.join(best, "claim_id", "left")
    missing = (F.col("state") == "not_found") & (F.size(F.split(F.trim("quote"), r"\s+")) >= 4)
    return out.withColumns({c: F.when(missing, F.col(c)) for c in ("other_key", "other_ref", "other_grade")})


def introduced_as_saying(canon_verdicts: DataFrame, docs: DataFrame, narration_before, canon_before) -> DataFrame:
    """Flags canon words that the text introduces as a person's saying."""
    at = canon_verdicts.join(docs.select("doc_id", "text"), "doc_id")
    flag = narration_before(F.col("text"), F.col("start")) & ~canon_before(F.col("text"), F.col("start"))
    return at.withColumn("presented_as_saying", flag).drop("text")


def reported_as_anothers(intro: Column, attributed_to: Column) -> Column:
    """The source reports the words as the central person's while the text names someone else."""
    named = X.normalize_arabic(attributed_to)
    persons = [p for p in V.PERSON_NAMES]
    norm_intro = X.normalize_arabic(intro)
    claimed, prophetic = F.lit(False), F.lit(False)
    for p in persons:
        claimed = claimed | named.contains(p)
        prophetic = prophetic | norm_intro.contains("قال " + p)
    return prophetic & (named != "") & ~claimed


def recited_source(statements: DataFrame, recited: DataFrame, script: str, floor: int = 2) -> DataFrame:
    """For a statement made by meaning, the quotation of the same document that shares most stems (two at least).

    ``statements``: (claim_id, doc_id, quote); ``recited``: (doc_id, source_id, text). Pairs meet on (document, stem).
    """
    left = G.once(statements.select("claim_id", "doc_id", "quote"), "s", X.stems(F.col("quote"), script)).select("claim_id", "doc_id", F.explode("s").alias("stem"))
    right = G.once(recited.select("doc_id", "source_id", "text"), "s", X.stems(F.col("text"), script)).select("doc_id", "source_id", F.explode("s").alias("stem"))
    votes = left.join(right, ["doc_id", "stem"]).groupBy("claim_id", "source_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= floor)
    return votes.groupBy("claim_id").agg(F.max_by("source_id", F.struct("shared", -F.col("source_id"))).alias("source_id"), F.max("shared").alias("shared"))


# --------------------------------------------------------------------------- fragments widened over changed words


def extend_fragments(runs: DataFrame, words: DataFrame, breaks: DataFrame, unit_words: DataFrame, reach: int = 4) -> DataFrame:
    """Widened word ranges of exact fragments: (run_id, doc_id, lo, hi).

    Up to four neighbouring words are taken on each side when the outermost is the source's own word and at least
    half are equal (not all: equal neighbours would be part of the run); one or two changed words are taken where
    the source unit and the sentence both end. ``runs``: (run_id, doc_id, start_w, end_w, at) with ``at`` the
    fragment's first word in ``unit_words`` (run_id, src); ``breaks``: (doc_id, gaps) flags per gap between words.
    """
    rows = runs.join(words, "doc_id").join(breaks, "doc_id").join(unit_words, "run_id")
    last, tail = F.col("end_w") - 1, F.col("at") + F.col("end_w") - F.col("start_w") - 1  # the run's last word, here and in the unit
    before = [("words", F.col("start_w"), -1), ("src", F.col("at"), -1), ("gaps", F.col("start_w"), -1)]
    after = [("words", last, 1), ("src", tail, 1), ("gaps", last - 1, 1)]
    unit_left = F.size("src") - 1 - tail

    def width(places: list, at_end: bool) -> Column:
        """How many neighbours are taken: the widest choice among those that one table of neighbours allows."""
        word, unit, gap = (lambda k, c=c, base=base, sign=sign: F.when(base + sign * k >= 0, F.get(c, base + sign * k)) for c, base, sign in places)
        table = F.transform(
            F.sequence(F.lit(1), F.lit(reach)),
            lambda k: F.struct(
                k.alias("k"),
                (word(k).isNull() | unit(k).isNull() | F.coalesce(gap(k), F.lit(True))).alias("closed"),
                F.coalesce(word(k) == unit(k), F.lit(False)).alias("same"),
            ),
        )
        room = F.coalesce(F.array_min(F.transform(F.filter(table, lambda x: x["closed"]), lambda x: x["k"])) - 1, F.lit(reach))
        equal = lambda k: F.size(F.filter(F.slice(table, F.lit(1), k), lambda x: x["same"]))
        fits = lambda x: x["same"] & (2 * equal(x["k"]) >= x["k"]) & (equal(x["k"]) < x["k"])
        ends = lambda x: (x["k"] <= 2) & (x["k"] == unit_left) & F.coalesce(F.get("gaps", last + x["k"]), F.lit(True))
        allowed = F.filter(table, lambda x: (x["k"] <= room) & ((fits(x) | ends(x)) if at_end else fits(x)))
        return F.coalesce(F.array_max(F.transform(allowed, lambda x: x["k"])), F.lit(0))

    return rows.select("run_id", "doc_id", (F.col("start_w") - width(before, False)).alias("lo"), (F.col("end_w") + width(after, True)).alias("hi"))


def gap_breaks(docs: DataFrame, script: str) -> DataFrame:
    """(doc_id, gaps): for each gap after a word, whether a sentence or quotation border lies in it."""
    piece, brk = f"[^{V.WORD_BREAKS}]+", f"[{V.WORD_BREAKS}]+"
    body = F.regexp_replace(F.col("text"), f"^{brk}", "")
    gaps = F.transform(F.regexp_extract_all(body, F.lit(brk), F.lit(0)), lambda g: g.rlike(V.EDGE_BREAK))
    return docs.select("doc_id", gaps.alias("gaps"))


def join_adjoining(runs: DataFrame) -> DataFrame:
    """Widened pieces of one group that meet become one range: (doc_id, group_no, lo, hi)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id", "group_no").orderBy("lo")
    seen = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    part = runs.withColumn("new", F.when(F.coalesce(F.col("lo") <= seen, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    return part.groupBy("doc_id", "group_no", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("T",)] + ["T"]
