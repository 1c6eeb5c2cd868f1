"""The left-to-right choice among runs, and the hashes of all lengths at a place."""
import random

from pyspark.sql import functions as F

from attestor.operators import scan as S


def test_choice_among_runs_is_that_among_places(spark):
    rng = random.Random(6)
    runs = []
    for doc in range(60):
        for _ in range(rng.randrange(1, 12)):
            a = rng.randrange(25)
            runs.append((doc, a, a + rng.randrange(4, 12), rng.randrange(40)))
    want = []
    for doc in range(60):
        cursor = 0
        while covers := [(max(a, cursor), -b, d) for k, a, b, d in runs if k == doc and b - 4 >= max(a, cursor)]:
            i, b, d = min(covers)
            want.append((doc, i, -b, i + d))
            cursor = -b
    got = S.choose_among_runs(spark.createDataFrame(runs, "doc_id long, start_w int, end_w int, diag long"))
    assert sorted(map(tuple, got.select("doc_id", "start_w", "end_w", "p").collect())) == sorted(want)


def test_equal_words_have_equal_hashes_at_every_length(spark):
    rng = random.Random(7)
    texts = [[rng.choice("ab") for _ in range(n)] for n in (30, 41)]
    at = [[(i, 4, len(t) - i) for i in range(len(t) - 3)] for t in texts]
    rows = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(zip(texts, at, strict=True))], "k long, words array<string>, at array<struct<i:int,least:int,most:int>>")
    said = {}
    for r in S._lengths(rows, "k").collect():
        said.setdefault((r.h, r.h2, r.len), set()).add(tuple(texts[r.k][r.i : r.i + r.len]))
    wordings = {tuple(t[i : i + n]) for t in texts for i in range(len(t)) for n in range(4, len(t) - i + 1)}
    assert all(len(w) == 1 for w in said.values()) and set.union(*said.values()) == wordings and len(said) == len(wordings)
    first = S._lengths(rows, "k", first=True).groupBy("k", "len", "h", "h2").agg(F.count("*").alias("n"), F.min("i").alias("i")).collect()
    assert all(r.n == 1 for r in first)
    assert all(not any(texts[r.k][j : j + r.len] == texts[r.k][r.i : r.i + r.len] for j in range(r.i)) for r in first)
    stepped = S._lengths(rows, "k", 5).collect()
    assert {(r.i, r.len) for r in stepped if r.k == 0} == {(i, n) for i in range(27) for n in range(4, 31 - i, 5)}


def test_a_document_that_comes_twice_has_no_run_over_a_gap(spark):
    pairs = [(1, i, i + 100) for i in (0, 1, 2, 3, 9, 10, 11)]
    for copies in (1, 2):
        runs = S.diagonal_runs(spark.createDataFrame(pairs * copies, "doc_id long, i int, p long")).collect()
        held = {i for r in runs for i in range(r.start_w, r.end_w - S.GRAM + 1)}
        assert held == {0, 1, 2, 3, 9, 10, 11} and all(r.diag == 100 for r in runs) and (copies > 1 or len(runs) == 2)
