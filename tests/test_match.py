"""Fuzzy canon windows without caps, and the set-similarity join, against brute force."""
import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import alignment as A
from attestor.operators import flows as FL
from attestor.operators import generate as GN
from attestor.operators import match as M
from attestor.operators import retrieve as RT
from attestor.operators import similar as SI


def canon(spark, texts):
    return FL.Canon.build(spark.createDataFrame([(1 + k // 8, 1 + k % 8, t, t) for k, t in enumerate(texts)], "group_no int, unit_no int, text_display string, text_match string"), "latin")


def claims(spark, quotes):
    return spark.createDataFrame([(k, q.split()) for k, q in quotes.items()], "claim_id string, q array<string>")


def test_anywhere_distance_is_a_lower_bound():
    rng = random.Random(1)
    for _ in range(60):
        q = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))).strip() or "a"
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 20)))
        got = A._prefix_distances(q, t, anywhere=True)
        want = [min(A._prefix_distances(q, t[a:e])[-1] if e > a else len(q) for a in range(e + 1)) for e in range(1, len(t) + 1)]
        assert got == want


def test_windows_out_of_reach_score_below_the_floor():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    for _ in range(40):
        s = [rng.choice(words) + rng.choice(["", "s", "x"]) for _ in range(40)]
        q = s[10:18]
        q[rng.randrange(8)] = "other"
        windows = [(lo, min(lo + 16, 40)) for lo in range(0, 36, 4)]
        floor = rng.choice([0.5, 0.7, 0.85])
        kept = A._within_reach(" ".join(q), s, windows, floor)
        for lo, hi in windows:
            if (lo, hi) not in kept:
                assert A._span(q, s[lo:hi])[2] < floor


def test_altered_copy_of_a_passage_copied_500_times(spark):
    rng = random.Random(3)
    passage = "one may tell of rivers that ran dry before any rain had come to fill them".split()
    altered = list(passage)
    altered[6], altered[9], altered[12] = "dust", "snow", "cover"
    units = [" ".join(passage)] * 500
    units[311] = " ".join(altered)
    units += [" ".join(rng.choice(passage) for _ in range(15)) for _ in range(40)]
    c = canon(spark, units)
    quote = list(altered)
    quote[2] = "speak"
    got = M.match_canon(claims(spark, {"a": " ".join(quote), "b": " ".join(passage[:-2] + ["heal", "wounds"])}), c.tokens, c.positions, c.small).collect()
    found = {r.claim_id: r for r in got}
    assert found["a"].p == 311 * len(passage) and found["a"].similarity > 0.9  # 500 places share every common pair
    assert found["b"].p % len(passage) == 0 and found["b"].p != 311 * len(passage)


@pytest.mark.parametrize("first, stretch", [(1, 1), (3, 5), (40, 64)])
def test_rounds_equal_aligning_every_window(spark, monkeypatch, first, stretch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "and"] * 12
    units = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 25))) for _ in range(40)]
    quotes = {}
    for k in range(6):
        q = " ".join(units[5 * k : 5 * k + 2]).split()[:12]
        for _ in range(k):
            q[rng.randrange(len(q))] = rng.choice(words)
        quotes[f"q{k}"] = " ".join(q)
    quotes["none"] = "quite unknown words only"
    c, cl = canon(spark, units), claims(spark, quotes)
    everything = M._aligned(M.seed_windows(cl, c.tokens, c.positions, c.small).select("claim_id", "bucket", "seed_rank", F.lit(None).cast("double").alias("floor")), cl, c.tokens, c.small).collect()
    unit_at = {r.pos: (r.group_no, r.unit_no) for r in c.tokens.collect()}
    want = set()
    for claim in {r.claim_id for r in everything}:
        mine = [r for r in everything if r.claim_id == claim]
        best = {}
        for r in mine:
            best[unit_at[r.p]] = max(best.get(unit_at[r.p], 0), round(r.score, 9))
        kth = sorted(best.values(), reverse=True)[2:3]
        want |= {(claim, r.seed_rank, r.p, r.n_words, round(r.score, 9)) for r in mine if not kth or round(r.score, 9) >= kth[0]}
    monkeypatch.setattr(M, "FIRST_WINDOWS", first)
    monkeypatch.setattr(M, "STRETCH", stretch)
    got = M.fuzzy_spans(cl, c.tokens, c.positions, c.small, 3).collect()
    assert {(r.claim_id, r.seed_rank, r.p, r.n_words, round(r.score, 9)) for r in got} == want and want


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(25):
        base = rng.sample(words, rng.randrange(1, 20))
        texts += [list(base) for _ in range(2)]
        for _ in range(4):
            t = list(base)
            t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(t + [rng.choice(words)] * rng.randrange(2))
    texts += [[], ["x"], ["x", "x"]]
    rows = SI.word_sets(spark.createDataFrame(list(enumerate(texts)), "key long, words array<string>")).collect()
    assert {r.key for r in rows} == {k for k, t in enumerate(texts) if t}
    sets = {r.sid: frozenset(r.ws) for r in rows}
    assert len(set(sets.values())) == len(sets)
    some = {s for k, s in enumerate(sorted(sets)) if k % 3}
    frame = spark.createDataFrame([(s, len(w), sorted(w), s in some) for s, w in sets.items()], "sid string, n int, ws array<string>, wanted boolean")
    want = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a in some and a != b and 5 * len(x & y) >= 4 * len(x | y)}
    got = SI.similar_sets(frame).collect()
    assert {(r.sid, r.other, r.shared) for r in got} == want and len(got) == len(want) > 20
    assert all(abs(r.similarity - len(sets[r.sid] & sets[r.other]) / len(sets[r.sid] | sets[r.other])) < 1e-12 for r in got)


def test_similar_sets_of_many_words_meet_in_several(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    base = [frozenset([*common, *(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 240)))]) for _ in range(60)]
    sets = {}
    for x in base:
        own = sorted(x)
        for some in [x, *(frozenset([*rng.sample(own, len(own) - cut), *(f"y{rng.randrange(900)}" for _ in range(more))]) for cut, more in ((3, 4), (len(own) // 10, len(own) // 12), (0, len(own) // 4), (len(own) // 5, 0), (len(own) // 4, 9)))]:
            sets[len(sets)] = some
    # every other set has the one rare word of a group of them at its front
    for k in range(120):
        sets[len(sets)] = frozenset([f"rare{k % 6}", *common, *(f"z{k}_{j}" for j in range(60))])
    frame = spark.createDataFrame([(k, len(w), sorted(w), k % 3 == 0) for k, w in sets.items()], "sid long, n int, ws array<string>, wanted boolean")
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a % 3 == 0 and a != b and 5 * len(x & y) >= 4 * len(x | y)}
    assert {(r.sid, r.other) for r in SI.similar_sets(frame).collect()} == want and len(want) > 100
    met = [(r.sid, r.other) for r in SI.met_sets(frame).collect()]
    assert len(met) == len(set(met)) and want <= set(met) and len(met) < 2 * len(want)


def test_best_similarity_is_the_best_of_all_alignments(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé𝒳") for _ in range(rng.randrange(1, 6)))
    stock = [word() for _ in range(40)]
    text = lambda n: [rng.choice(stock) for _ in range(n)]
    claims = [(k, text(rng.choice([1, 3, 8, 20, 70]))) for k in range(40)] + [(40, []), (7, text(5)), (None, text(4))]
    records = [(k, text(rng.choice([1, 4, 12, 40]))) for k in range(25)] + [(25, []), (3, text(9))]
    records += [(100 + k, [*text(rng.randrange(6)), *q[: rng.randrange(1, 12)], *text(rng.randrange(6))]) for k, q in claims[:20]]
    cands = [(c, r) for c, _ in claims for r, _ in records if rng.random() < 0.4]
    frames = [spark.createDataFrame(*x) for x in ((cands, "claim_id long, key long"), (claims, "claim_id long, q array<string>"), (records, "key long, words array<string>"))]
    one_by_one = RT.align(frames[0], frames[1].withColumn("q_orig", F.col("q")), frames[2].withColumn("orig", F.col("words")))
    want = {r.claim_id: r.s for r in one_by_one.groupBy("claim_id").agg(F.max("similarity").alias("s")).collect()}
    got = RT.best_similarity(*frames).collect()
    assert {r.claim_id: r.similarity for r in got} == want and len(got) == len(want) > 35


def test_rejected_everywhere_reads_texts(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda *swap: " ".join(dict(swap).get(k, w) for k, w in enumerate(t))
    other = [" ".join(f"{p}{k}" for k in range(10)) for p in "abcdef"]
    rows = [
        (1, text(), "weak"), (2, text(), "weak"), (3, text((0, "x")), "unknown"),  # near copies, none accepts
        (10, other[0], "weak"), (11, other[0].replace("a0", "z"), "accepted"),  # a near copy accepts
        (20, other[1], "weak"), (21, other[1].replace("b3", "z"), "fabricated"),  # a weak one whose copy is called invented
        (30, other[2], "fabricated"), (31, "two words", "weak"), (32, None, "fabricated"), (40, other[3], "fabricated"),
    ]
    corpus = [(1, other[3].replace("d1 d2", "y z")), (2, "nothing of it")]
    got = GN.rejected_everywhere(spark.createDataFrame(rows, "key long, text string, grade_class string"), spark.createDataFrame(corpus, "key long, text string"), "latin")
    assert {(r.key, r.grade_class, r.copies) for r in got.collect()} == {(1, "weak", 3), (2, "weak", 3), (21, "fabricated", 2), (30, "fabricated", 1)}
