"""The filter that document grams pass before the exchange, and the scan behind it."""
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import grams as G
from attestor.operators import scan as S
from test_operators import brute_longest


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, words array<string>")


def random_words(n, seed, vocabulary=5000):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus_grams(spark, words):
    return G.explode_grams(texts(spark, [words]), S.GRAM).select(F.lit(0).cast("long").alias("src"), F.col("i").cast("long").alias("p"), *S.KEYS)


def test_filter_admits_every_corpus_gram_and_few_others(spark):
    stream = random_words(4000, 1)
    src = corpus_grams(spark, stream)
    n = S.filter_words(src.select(*S.KEYS).distinct().count())
    filt = S.gram_filter(src, n)
    docs = texts(spark, [stream[100:400], random_words(20_000, 2), [], ["w1", "w2"]])
    grams = G.explode_grams(docs, S.GRAM)
    kept = S.admitted(grams, filt, n)
    per = dict(map(tuple, kept.groupBy("doc_id").count().collect()))
    assert per[0] == 297
    assert per.get(1, 0) < 0.05 * 20_000
    assert set(per) <= {0, 1}


def test_filters_of_parts_merge_to_the_filter_of_the_whole(spark):
    src = corpus_grams(spark, random_words(1500, 3))
    whole = S.gram_filter(src, 200)
    merged = S.merge_filters(*[S.gram_filter(src.filter(F.col("p") % 3 == k), 200) for k in range(3)])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_filter_size_is_bounded():
    assert S.filter_words(0) == 1 and S.filter_words(64) == 12
    assert S.filter_words(20_000_000) == S.FILTER_WORDS
    assert S.filter_words(10**9) == 0


@pytest.mark.parametrize("cap", [10_000, 6, 2])
def test_filtered_scan_equals_brute_force(spark, cap):
    rnd = random.Random(11)
    word = lambda: rnd.choice("abc")
    stream = [word() for _ in range(200)]
    docs = [[word() for _ in range(30)] + stream[50:75] + random_words(40, 5) for _ in range(2)] + [random_words(60, 6), []]
    units = spark.createDataFrame([(1, 1, " ".join(stream))], "group_no int, unit_no int, t string")
    tokens = G.stream_tokens(G.unit_positions(units, "latin", "t"))
    want = {(k, i): v for k, d in enumerate(docs) for i, v in brute_longest(d, stream).items()}
    got = {(r.doc_id, r.i): (r.len, r.p) for r in S.longest_at(texts(spark, docs), tokens, False, cap).collect()}
    assert got == want


def test_empty_corpus_and_empty_documents(spark):
    none = spark.createDataFrame([], "pos long, word string")
    assert S.longest_at(texts(spark, [["a", "b", "c", "d"]]), none, False).count() == 0
    tokens = spark.createDataFrame([(k, w) for k, w in enumerate("abcdef")], "pos long, word string")
    assert S.longest_at(texts(spark, []), tokens, False).count() == 0


def test_grams_are_dropped_below_the_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        src = corpus_grams(spark, random_words(500, 7))
        grams = S.admitted(G.explode_grams(texts(spark, [random_words(500, 8)]), S.GRAM), S.gram_filter(src, 100), 100)
        pairs = S.gram_pairs(grams, src, S.HOT, False, False)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    semi = next(k for k, x in enumerate(lines) if "BroadcastHashJoin" in x and "LeftSemi" in x)
    assert any("Exchange hashpartitioning(h" in x for x in lines[:semi])
    assert sum("SortMergeJoin" in x or "ShuffledHashJoin" in x for x in lines) == 1
