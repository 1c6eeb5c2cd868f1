"""Texts that differ by few letters: the join by unchanged pieces against all pairs, and the sentences it serves."""
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import claims as C
from attestor.operators import similar as S


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(rng, t, k):
    t = list(t)
    for _ in range(k):
        at, how = rng.randrange(len(t)), rng.randrange(4)
        if how == 0:
            t[at] = rng.choice("abc ")
        elif how == 1:
            t.insert(at, rng.choice("abc "))
        elif len(t) > 1:
            del t[at]
    return "".join(t)


@pytest.mark.parametrize("num,den", [(22, 25), (3, 4), (19, 20)])
def test_near_texts_are_those_of_all_pairs(spark, num, den):
    rng = random.Random(num)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randrange(8, 90))) for _ in range(12)]
    texts = list(dict.fromkeys(base + [changed(rng, t, rng.randrange(1, 1 + len(t) // 4)) for t in base for _ in range(10)]))
    wanted = texts[::2]
    frame = lambda ts: spark.createDataFrame([(str(texts.index(t)), t) for t in ts], "sid string, t string")
    got = {(r.sid, r.other): r.edits for r in S.near_texts(frame(wanted), frame(texts), num, den, 8).collect()}
    want = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            d = edits(a, b)
            if i % 2 == 0 and len(a) >= 8 and den * d <= (den - num) * max(len(a), len(b)):
                want[str(i), str(j)] = d
    assert got == want and sum(d > 0 for d in want.values()) > 10


def test_long_text_with_edits_at_both_ends(spark):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    other = "x" * 150 + t[:-150]
    rows = spark.createDataFrame([("a", t), ("b", other)], "sid string, t string")
    got = {(r.sid, r.other): r.edits for r in S.near_texts(rows, rows).collect()}
    assert got["a", "b"] == 300 and len(got) == 4


LINE = "the patient traveller finds a quiet light upon the distant hill"


def test_near_verbatim_sentences(spark):
    near = LINE.replace("quiet", "quite").replace("hill", "hills")
    rows = [(1, 0, LINE), (2, 0, near.upper()), (3, 0, LINE), (4, 0, "an entirely different set of words without any source here"), (5, 0, "!!! ??? ... --- ,,, ;;;")]
    rows = spark.createDataFrame(rows, "doc_id long, n int, quote string").withColumn("similar", F.lit(1))
    texts = spark.createDataFrame([(1, f"Before it. {LINE}! After it"), (3, f"{LINE}\n{LINE}."), (9, near), (10, None), (11, ""), (3, f"{LINE}")], "key long, text string")
    got = {r.doc_id: (r.key, round(r.similarity, 3)) for r in C.near_verbatim(rows, texts, "latin").collect()}
    assert got == {1: (1, 1.0), 2: (9, 1.0), 3: (1, 1.0)}
    got = {r.doc_id: (r.key, round(r.similarity, 3)) for r in C.near_verbatim(rows, texts, "latin", own=True).collect()}
    assert got == {1: (3, 1.0), 2: (9, 1.0), 3: (1, 1.0)}
    few = C.near_verbatim(rows, texts.filter("key IN (1, 9)"), "latin", own=True).collect()
    assert {r.doc_id: r.key for r in few} == {1: 9, 2: 9, 3: 1} and {r.doc_id: r.similarity for r in few}[1] == round(1 - edits(LINE, near) / len(near), 9)
    assert C.near_verbatim(rows, texts.limit(0), "latin").count() == 0 and C.near_verbatim(rows.limit(0), texts, "latin").columns == [*rows.columns, "key", "similarity"]
