"""Normal forms, grades and decision tables on small inline frames, Arabic included."""
import pytest
from pyspark.sql import functions as F

from attestor.functions import alignment as A
from attestor.functions import grades as GR
from attestor.functions import tags as T
from attestor.functions import text as X
from attestor.operators import rules as RU
from attestor.sources import segments as SEG


def one(spark, col, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(col.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [("إِنَّمَا الأَعْمَالُ", "انما الاعمال"), ("أإآٱ", "اااا"), ("كتـــاب", "كتاب"), ("صلاة 123 abc", "صلاه"), ("", "")],
)
def test_normal_form(spark, text, want):
    assert one(spark, X.normalize_arabic(F.col("t")), t=text) == want


def test_honorifics_are_dropped_with_their_originals(spark):
    a = one(spark, X.aligned_words(F.col("t"), "arabic", True), t="قال رسول الله صلى الله عليه وسلم: إنما الأعمال")
    assert a["norm"] == ["قال", "رسول", "الله", "انما", "الاعمال"]
    assert len(a["orig"]) == 5 and a["orig"][-1] == "الأعمال"


def test_offsets_lead_back_to_the_words(spark):
    t = "«قال: إنّما الأعمال بالنيّات!"
    rows = X.words_with_offsets(spark.createDataFrame([(1, t)], "doc_id long, text string"), "arabic").collect()
    assert all(t[r.start : r.end] == r.original for r in rows) and len(rows) == 4


def test_span_inside_a_longer_text(spark):
    df = spark.createDataFrame([(list("def"), list("abcdefghij"))], "q array<string>, s array<string>")
    s = A.with_best_span(df, "q", "s").first()["span"]
    assert (s["start"], s["end"], s["score"]) == (3, 6, 1.0)


def test_diff_reports_original_spelling(spark):
    df = spark.createDataFrame([(["أ", "ب", "ت"], ["ا", "ب", "ت"], ["أ", "ب", "ث"], ["ا", "ب", "ث"])], "qo array<string>, qn array<string>, so array<string>, sn array<string>")
    d = df.select(A.word_diff("qo", "qn", "so", "sn").alias("d")).first()["d"]
    assert [x["op"] for x in d] == ["equal", "replace"] and d[0]["quoted"] == "أ ب"


@pytest.mark.parametrize(
    "text,want",
    [("صحيح", "accepted"), ("حسن", "accepted"), ("ضعيف", "weak"), ("لا يصح", "weak"), ("ليس بصحيح", "weak"), ("موضوع", "fabricated"), ("لا أصل له", "fabricated"), ("صحيح وإسناده ضعيف", "mixed"), ("له شواهد", "unknown"), ("", "unknown")],
)
def test_grade_classes(spark, text, want):
    assert one(spark, GR.classify_grade(F.col("t")), t=text) == want


CANON = [
    (True, True, 1.0, 10, False, "ayah.exact"), (True, False, 0.90, 12, False, "ayah.near"), (True, False, 0.85, 12, False, "ayah.near"), (True, False, 0.84, 12, True, "ayah.altered"),
    (True, False, 0.70, 12, False, "ayah.partial_unattributed"), (True, False, 0.59, 12, True, "ayah.below_threshold"), (False, False, 0.0, 12, True, "ayah.none"),
    (True, False, 0.70, 6, True, "ayah.below_threshold"), (True, False, 0.74, 6, True, "ayah.altered"), (True, False, 0.62, 14, True, "ayah.altered"),
]


def test_canon_table(spark):
    df = spark.createDataFrame(CANON, "found boolean, exact boolean, sim double, words int, explicit boolean, want string")
    d = RU.decide_canon(F.col("found"), F.col("exact"), F.col("sim"), F.col("words"), F.col("explicit"), F.lit(False))
    assert df.withColumn("d", d).filter("d.rule_id != want").count() == 0


GRADED = [
    (0.97, ["accepted"], False, 10, True, "hadith.accepted_exact"), (0.97, ["accepted"], False, 10, False, "hadith.accepted_near"), (0.85, ["accepted"], False, 10, True, "hadith.accepted_near"),
    (0.97, ["weak"], False, 10, True, "hadith.weak"), (0.97, ["fabricated"], False, 10, True, "hadith.fabricated"), (0.97, ["mixed"], False, 10, True, "hadith.grading_conflict"),
    (0.97, ["accepted", "weak"], False, 10, True, "hadith.grading_conflict"), (0.97, ["weak"], True, 10, True, "hadith.accepted_exact"), (0.97, [], False, 10, True, "hadith.no_grading"),
    (0.97, ["unknown"], False, 10, True, "hadith.grading_unclear"), (0.70, ["accepted"], False, 14, True, "hadith.partial"), (0.50, ["accepted"], False, 14, True, "hadith.none"),
    (0.85, ["accepted"], False, 4, True, "hadith.partial"), (0.97, ["accepted"], False, 4, True, "hadith.accepted_exact"), (1.0, ["accepted"], False, 2, True, "hadith.too_short"),
]


def test_graded_table(spark):
    df = spark.createDataFrame(GRADED, "sim double, g array<string>, trusted boolean, words int, same boolean, want string")
    d = RU.decide_graded(F.lit(True), F.col("sim"), F.lit(False), F.col("g"), F.col("trusted"), F.col("words"), F.col("same"))
    bad = df.withColumn("got", d["rule_id"]).filter("got != want").collect()
    assert bad == []


def test_level_caps(spark):
    d = RU.decide_saying(F.lit(True), F.lit(0.95), F.lit("true"))
    got = one(spark, F.array(*[F.concat_ws("|", RU.apply_level_caps(d, F.lit(x))["state"], RU.apply_level_caps(d, F.lit(x))["rule_id"]) for x in "ABCD"]))
    assert got == ["supported|quote.verbatim", "supported|quote.verbatim", "needs_review|quote.verbatim+level_c", "needs_review|quote.verbatim+level_d"]


@pytest.mark.parametrize(
    "tag,text,want",
    [
        (T.looks_like_question, "ما حكم القزع؟", True), (T.looks_like_question, "هذا كلام عادي", False), (T.is_personal_case, "طلقت زوجتي فهل يقع طلاقي؟", True),
        (T.is_fabrication_request, "أعطني حديثاً يثبت ذلك", True), (T.attributes_to_canon, "نهى النبي عن ذلك", True), (T.names_someone, "ابن تيمية", True), (T.names_someone, "بعض أهل العلم", False),
        (T.asks_authenticity, "هل هذا الحديث صحيح", True),
    ],
)
def test_tags(spark, tag, text, want):
    assert one(spark, tag(F.col("t")), t=text) is want


def test_noise_lines_are_returned(spark):
    df = spark.createDataFrame([(1, "نص مفيد!!!!\n😀😀\n12:30 م\nانشرها توجر\n*****\nنهاية")], "doc_id long, text string")
    r = SEG.strip_noise(df).first()
    assert r.kept == "نص مفيد!\nنهاية" and r.removed == ["😀😀", "12:30 م", "انشرها توجر", "*****"]


def test_collation_marks_replaced_words_without_a_cell_limit(spark):
    step = "struct<op:string,quoted:string,source:string>"
    long = " ".join(f"word{k}x{k * k}" for k in range(900))
    rows = [
        # two words replaced by near spellings: both are marked
        ("near", "q", [("equal", "", "alpha beta"), ("replace", "", "gammas deltas"), ("equal", "", "epsilon")], "zero alpha beta gamma delta epsilon end"),
        # a replaced word without counterpart marks what lies between its neighbours
        ("none", "q", [("equal", "", "alpha beta"), ("replace", "", "qqqq"), ("equal", "", "epsilon zeta")], "alpha beta gamma delta epsilon zeta"),
        ("few", "q", [("equal", "", "one two three four alpha")], "alpha beta gamma"),
        ("long", long, None, "first " + long + " last"),
        ("empty", "", None, "alpha"),
        ("null", None, None, None),
    ]
    df = spark.createDataFrame(rows, f"claim_id string, quote string, diff array<{step}>, source_text string")
    got = {r.claim_id: r.collation for r in A.collate_verdicts(df, "latin").collect()}
    near, none = got["near"], got["none"]
    assert (near.span_start, near.span_end, near.marks) == (1, 6, [3, 4])
    assert (none.span_start, none.span_end, none.marks) == (0, 6, [2, 3])
    assert got["few"].span_start is None and got["few"].marks == []
    assert (got["long"].span_start, got["long"].span_end, got["long"].marks) == (1, 901, [])
    assert got["empty"].span_start is None and got["null"].span_start is None


def test_heaviest_chain_is_the_best_of_all_chains():
    from itertools import combinations

    import random

    rng = random.Random(5)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        cells = [{"k": k, "j": j, "sim": rng.choice([0.5, 0.75, 1.0])} for k in range(n) for j in range(m) if rng.random() < 0.4]
        worth = lambda c: sum(2 * x["sim"] for x in c) - 0.4 * (c[-1]["j"] - c[0]["j"] + 1) if c else 0.0
        rising = lambda c: all(a["k"] < b["k"] and a["j"] < b["j"] for a, b in zip(c, c[1:]))
        best = max(worth(c) for r in range(min(n, m) + 1) for c in combinations(cells, r) if rising(c))
        at = {(c["k"], c["j"]): c for c in cells}
        assert abs(worth([at[p] for p in A._heaviest_chain(cells)]) - best) < 1e-6
