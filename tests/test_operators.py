"""Scans, matching, retrieval, merging and streams on small frames, checked against brute force."""
import random

from pyspark.sql import functions as F

from attestor.operators import claims as C
from attestor.operators import flows as FL
from attestor.operators import grams as G
from attestor.operators import match as M
from attestor.operators import retrieve as R
from attestor.operators import scan as S
from attestor.operators.intervals import near_pairs
from attestor.streaming import streams as ST

UNITS = [
    (1, 1, "alpha beta gamma delta epsilon zeta"), (1, 2, "eta theta iota kappa lambda mu nu"), (1, 3, "xi omicron pi rho sigma tau upsilon phi chi"),
    (2, 1, "one two three four five six seven"), (2, 2, "eight nine ten eleven twelve"),
]


def canon(spark):
    return FL.Canon.build(spark.createDataFrame([(g, u, t, t) for g, u, t in UNITS], "group_no int, unit_no int, text_display string, text_match string"), "latin")


def brute_longest(doc, stream):
    out = {}
    for i in range(len(doc)):
        best = None
        for p in range(len(stream)):
            n = 0
            while i + n < len(doc) and p + n < len(stream) and doc[i + n] == stream[p + n]:
                n += 1
            if n >= 4 and (best is None or n > best[0]):
                best = (n, p)
        if best:
            out[i] = best
    return out


def test_longest_runs_equal_brute_force_also_with_frequent_grams(spark):
    rnd = random.Random(7)
    word = lambda: rnd.choice("abc")
    stream = [word() for _ in range(300)]
    docs = [[word() for _ in range(40)] + stream[50:75] + [word() for _ in range(10)] for _ in range(3)]
    units = spark.createDataFrame([(1, 1, " ".join(stream))], "group_no int, unit_no int, t string")
    tokens = G.stream_tokens(G.unit_positions(units, "latin", "t"))
    words = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "doc_id long, words array<string>")
    want = {(k, i): v for k, d in enumerate(docs) for i, v in brute_longest(d, stream).items()}
    for cap in (10_000, 6, 2):
        got = {(r.doc_id, r.i): (r.len, r.p) for r in S.longest_at(words, tokens, True, cap).collect()}
        assert got == want, cap


def brute_record_runs(doc, records):
    out, i = [], 0
    while i < len(doc):
        best = None
        for src, rec in records:
            for p in range(len(rec)):
                n = 0
                while i + n < len(doc) and p + n < len(rec) and doc[i + n] == rec[p + n]:
                    n += 1
                if n >= 4 and (best is None or (n, -src, -p) > best):
                    best = (n, -src, -p)
        if best:
            out.append((i, i + best[0], -best[1], -best[2], -best[2] + best[0]))
            i += best[0]
        else:
            i += 1
    return out


def test_record_runs_equal_brute_force_at_every_cap(spark):
    rnd = random.Random(11)
    word = lambda k: [rnd.choice("abc") for _ in range(k)]
    page = word(30)
    records = [(7 * k + 3, word(5) + page[: rnd.randint(8, 30)] + word(4)) for k in range(12)] + [(900, word(3)), (901, []), (902, word(25)), (903, page), (2_500_000, page)]
    records.append((950, ["a", "b", "c"] * 12 + ["a"] * 15))
    docs = [word(20) + page[3:28] + word(10) + records[-4][1][4:20], page, word(3), [], ["b", "c", "a"] * 14 + ["a"] * 18]
    rec = spark.createDataFrame(records, "src long, words array<string>")
    words = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "doc_id long, words array<string>")
    want = sorted((k, *r) for k, d in enumerate(docs) for r in brute_record_runs(d, records))
    for cap in (10_000, 5, 1):
        rows = S.record_runs(words, rec, True, cap).select("doc_id", "start_w", "end_w", "src", "src_start", "src_end").collect()
        assert sorted(map(tuple, rows)) == want, cap


def test_copies_of_a_record_do_not_hide_it(spark):
    text = [f"w{k}" for k in range(60)]
    for copies in (41, 1000):
        rec = spark.createDataFrame([(k, text[:40]) for k in range(copies)] + [(copies, text[20:])], "src long, words array<string>")
        words = spark.createDataFrame([(1, ["x", *text[5:35], "y"]), (2, ["z", *text[10:60]])], "doc_id long, words array<string>")
        got = sorted(map(tuple, S.record_scan(words, rec, True, script="latin").select("doc_id", "src", "start_w", "end_w").collect()))
        assert got == [(1, 0, 1, 31), (2, 0, 1, 31), (2, copies, 31, 51)], copies


def test_scan_finds_passages_over_unit_borders(spark):
    text = "so he said: Epsilon, zeta eta THETA iota and then one two three four five"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = FL.scan_canon(docs, canon(spark)).orderBy("start").collect()
    assert [r.quote for r in rows] == ["Epsilon, zeta eta THETA iota", "one two three four five"]
    assert all(text[r.start : r.end] == r.quote for r in rows)


def test_exact_fuzzy_and_missing_quotes(spark):
    c = canon(spark)
    q = spark.createDataFrame(
        [("exact", "eta theta iota kappa"), ("over", "epsilon zeta eta theta"), ("one_changed", "xi omicron pi changed sigma tau upsilon phi chi"), ("two_words", "alpha beta"), ("none", "quick brown foxes jump")],
        "claim_id string, quote string",
    )
    got = {r.claim_id: r for r in M.match_canon(R.claim_words(q, "latin").select("claim_id", "q"), c.tokens, c.positions, c.small).collect()}
    assert got["exact"].kind == "exact" and got["over"].kind == "exact" and got["one_changed"].kind == "fuzzy"
    assert got["one_changed"].similarity >= 0.8 and "two_words" not in got and "none" not in got
    over = S.covered_units(q.filter("claim_id = 'over'").select("claim_id", F.lit(got["over"].p).alias("p"), F.lit(4).alias("n_words")), c.units, c.positions).first()
    assert (over.unit_start, over.unit_end) == (1, 2)


def test_common_terms_do_not_change_the_ranking(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    recs = [(k, ["the", "of"] * rnd.randint(1, 3) + rnd.choices(vocab, k=12)) for k in range(120)]
    records = spark.createDataFrame(recs, "key long, words array<string>")
    queries = spark.createDataFrame([(f"q{i}", ["the", "of", *rnd.sample(vocab, 5)]) for i in range(8)] + [("only", ["the", "of"])], "claim_id string, terms array<string>")
    full = {(r.claim_id, r.key): round(r.score, 6) for r in R.bm25(queries, records, 10).collect()}
    cut = {(r.claim_id, r.key): round(r.score, 6) for r in R.bm25(queries, records, 10, common=80).collect()}
    assert full == cut and len(full) == 90


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    mk = lambda n: [(rnd.randint(0, 2), s, s + rnd.randint(1, 900)) for s in (rnd.randint(0, 4000) for _ in range(n))]
    a, b = mk(60), mk(60)
    df = lambda rows: spark.createDataFrame([(d, s, e, i) for i, (d, s, e) in enumerate(rows)], "doc_id int, start int, end int, n int")
    for reach in (0, 81):
        got = sorted((r.a_n, r.b_n) for r in near_pairs(df(a), df(b), reach).collect())
        want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] - reach < y[2] and y[1] < x[2] + reach)
        assert got == want


def test_marked_quotations_in_arabic(spark):
    text = "قال تعالى: ﴿الحَمدُ للهِ ربِّ العالمين﴾ وقال رسول الله ﷺ: «إنّما الأعمال بالنيّات» انتهى."
    rows = C.extract_by_markers(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert all(text[r.start : r.end] == r.quote for r in rows)
    assert {(r.type, r.quote) for r in rows if r.closed} >= {("ayah", "الحَمدُ للهِ ربِّ العالمين"), ("hadith", "إنّما الأعمال بالنيّات")}


def test_documents_to_verdicts(spark):
    record = "the scribe wrote forty letters before winter came to the northern valley and sealed each one"
    graded = spark.createDataFrame([(1, record, "Great Collection", "صحيح", ""), (2, "a wholly different report about ships and harbours in summer", "Other", "ضعيف", "")], "key long, text string, attribution string, grade string, intro string")
    texts = [
        "As written: one two three four five six seven. Nothing else follows here.",
        f"Someone told us {record} and we left.",
        "Plain words that quote nobody at all.",
        "",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = FL.verify_documents(docs, canon(spark), graded, "latin").collect()
    got = {(r.doc_id, r.type): r for r in rows}
    assert set(got) == {(0, "ayah"), (1, "hadith")} and len(rows) == 2
    assert (got[0, "ayah"].state, got[0, "ayah"].quote, got[0, "ayah"].similarity) == ("supported", "one two three four five six seven", 1.0)
    assert (got[1, "hadith"].state, got[1, "hadith"].source_key, got[1, "hadith"].quote) == ("supported", "graded:1", record)
    assert all(texts[r.doc_id][r.start : r.end] == r.quote and r.action for r in rows)


def test_repeated_quotation_is_one_claim(spark):
    same = "a b c d e f"
    rows = [(f"c{i}", 1, "hadith", same, i * 20, i * 20 + 11) for i in range(3)]
    df = spark.createDataFrame(rows, "claim_id string, doc_id long, type string, quote string, start int, end int")
    assert sorted(r.claim_id for r in C.repeated_quotations(df).collect()) == ["c1", "c2"]


def events(spark):
    rows = [(i, i % 2, 1.7e9 + 60.0 * i) for i in range(60)]
    return spark.createDataFrame(rows, "event_id long, user_id long, s double").select("event_id", "user_id", F.col("s").cast("timestamp").alias("ts"))


def test_request_limit_batch_equals_brute_force_and_stream(spark, tmp_path):
    ev = events(spark)
    batch = {r.event_id: r.denied for r in ST.limit_requests(ev, 2, 600.0).collect()}
    want = {}
    for user in (0, 1):
        acc = []
        for i in range(user, 60, 2):
            acc = [t for t in acc if 60.0 * i - t <= 600.0]
            want[i] = len(acc) >= 2
            if not want[i]:
                acc.append(60.0 * i)
    assert batch == want
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = ST.limit_requests_stream(stream, 2, 600.0).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id: r.denied for r in spark.table("limited").collect()} == want


def test_verdict_stream_equals_batch(spark, tmp_path):
    c = canon(spark)
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "nothing here at all"), (3, "eta theta iota kappa lambda")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    verify = lambda d: FL.scan_canon(d, c).select("doc_id", "start", "end", "quote")
    q = ST.verify_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), verify, str(tmp_path / "out"), str(tmp_path / "cp"), "verdicts_q").start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "start", "end", "quote")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, verify(docs).collect()))
