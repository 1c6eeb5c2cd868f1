"""Text helpers that must stay near linear in a text, and set-wise title lookups, against plain Python."""
import re

from pyspark.sql import functions as F

from attestor.functions import fixed_values as V
from attestor.functions import tags as T
from attestor.functions import text as X
from attestor.operators import claims as C
from attestor.operators import grams as G
from attestor.operators import retrieve as RT


def test_running_totals_over_blocks(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        ns = [(i * 7) % 11 for i in range(n)]
        got = spark.createDataFrame([(ns,)], "ns array<int>").select(X.running_totals(F.col("ns")).alias("t")).first()["t"]
        assert got == [sum(ns[: i + 1]) for i in range(n)]


def test_matches_and_stretches_of_a_long_text(spark):
    t = "".join(f"that é{i}. \n" for i in range(900)) + "that"
    row = spark.createDataFrame([(t,)], "t string").select(X.matches_with_offsets(F.col("t"), r"that\s").alias("m"), X.stretches(F.col("t"), C.SENTENCE_BREAK).alias("s")).first()
    assert [(m.start, m.end, m.hit) for m in row["m"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"that\s", t)]
    assert [(m.start, m.end, m.hit) for m in row["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^.؟!\n؛]+", t)]


def test_quotations_longer_than_the_blocks_read_first(spark):
    marker = [C.Marker("said", r"(?i)\bthat\s+", "hadith", "A")]
    run, inside = "word " * 600, "a. b " * 500
    t = "x" * 300 + f" that {run}end. that ({inside}) that (never closed. That " + " " * 700 + "two words"
    got = {(r.start, r.closed, r.quote) for r in C.extract_by_markers(spark.createDataFrame([(1, t)], "doc_id long, text string"), marker).collect()}
    first, second = t.index(run), t.index(inside)
    # the first sentence holds no other marker; an opener that never closes is skipped
    assert got == {(first, False, run + "end"), (second, True, inside.strip()), (t.index("never"), False, "never closed"), (t.index("two words"), False, "two words")}


def test_marker_before_reads_only_what_stands_before(spark):
    t = "é" * 500 + " that quoted words. " + "y" * 200 + " more"
    claims = spark.createDataFrame([("a", 1, t.index("quoted")), ("b", 1, t.index("more")), ("c", 1, 0)], "claim_id string, doc_id long, start int")
    got = C.markers_before(claims, spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string"), r"(?i)\bthat\s+", 6).collect()
    assert {r.claim_id: r.before for r in got} == {"a": True, "b": False, "c": False}


def test_tags_agree_with_the_whole_patterns(spark):
    texts = ["what is it?", "ما حكم هذا؟", "هذا الشيء عندهم حرام؟", "plain text", "is it allowed for me", "a sin", "الصلاة", "", "x " * 50 + "بدعه ?"]
    rows = T.tag_texts(spark.createDataFrame([(t,) for t in texts], "text string")).withColumn("f", X.fold_for_markers(F.col("text")))
    for r in rows.select("*", F.col("f").rlike(V.QUESTION).alias("q"), F.col("f").rlike(V.PERSONAL).alias("p")).collect():
        assert (r.is_question, r.is_personal_case) == (r.q, r.p), r.text


def test_position_grams_and_equal_titles(spark):
    w = spark.createDataFrame([(1, "a b c".split()), (2, ["a"]), (3, [])], "doc_id long, words array<string>")
    assert {(r.doc_id, r.n, r.i, r.gram) for r in G.position_grams(w).collect()} == {(1, 2, 0, "a b"), (1, 2, 1, "b c"), (1, 3, 0, "a b c")}
    pages = spark.createDataFrame([(i, f"t{i}", f"u{i}", ["alpha", "beta"] if i % 2 else ["beta", "gamma"]) for i in range(1, 41)], "page_id long, title string, url string, stems array<string>")
    q = spark.createDataFrame([(f"q{i}", ["beta", "alpha"]) for i in range(50)], "q_id string, stems array<string>")
    got = RT.nearest_title(q, pages).collect()
    assert len(got) == 50 and {(r.page_id, r.title, r.shared) for r in got} == {(1, "t1", 2)}


def test_words_outside_taken_ranges(spark):
    ws = [f"word{i % 9}{i}" for i in range(60)]
    words = spark.createDataFrame([(1, ws), (2, ws)], "doc_id long, words array<string>")
    runs = spark.createDataFrame([(1, "a", 0, 30), (1, "b", 30, 60), (2, "c", 5, 12)], "doc_id long, run_id string, start_w int, end_w int")
    spans = spark.createDataFrame([(1, 10, 26), (1, 20, 33), (2, 0, 6), (2, 40, 50)], "doc_id long, start int, end int")
    counted = C.count_outside(runs, words, spans)
    assert {r.run_id: r.n_outside for r in counted.collect()} == {"a": 10, "b": 27, "c": 6}
    # the words are joined a document at a time, so no row of a run carries them
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(start_w" not in plan
