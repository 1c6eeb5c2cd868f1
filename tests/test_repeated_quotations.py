"""Quotations said more fully elsewhere in a document, against all pairs; no text is sent with each of its words."""
import random

from pyspark.sql import functions as F

from attestor.operators import claims as C


def test_repeated_quotations_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for doc in (1, 2, 3, None):
        said = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(25)]
        rows += [(doc, f"{doc}-{k}", rng.choice(("hadith", "ayah", "fact")), None if k % 9 == 0 else k, q) for k, q in enumerate(said + said[:5])] + [(doc, f"{doc}-x", "hadith", 3, None)]
    claims = spark.createDataFrame(rows, "doc_id long, claim_id string, type string, start int, quote string")
    shown = claims.filter("claim_id IN ('1-4', '2-7', '3-1')").withColumn("claim_id", F.concat(F.lit("s"), "claim_id"))
    for more in (None, shown):
        every = [(*r, False) for r in rows] + ([(*r, True) for r in shown.collect()] if more is not None else [])
        texts = [r for r in every if r[2] in C.QUOTED and r[4] and len(r[4].split(" ")) >= 3]
        order = lambda r: (not r[5], r[3] is not None, r[3] or 0, r[1])
        want = set()
        for a in texts:
            for b in texts:
                if a[:1] + a[2:3] != b[:1] + b[2:3] or a[5]:
                    continue
                fuller = a[0] is not None and len(b[4]) > len(a[4]) and f" {a[4]} " in f" {b[4]} "
                if fuller or (a[4] == b[4] and order(b) < order(a)):
                    want.add((a[0], a[1]))
        got = C.repeated_quotations(claims, more)
        assert {(r.doc_id, r.claim_id) for r in got.collect()} == want and len(want) > 5
        assert got.count() == len(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
