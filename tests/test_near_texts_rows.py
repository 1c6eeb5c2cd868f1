"""What the edit-similarity join sends for every letter."""
from attestor.operators import similar as S


def test_no_text_travels_with_its_pieces(spark):
    rows = spark.createDataFrame([("a" * 64, "the patient traveller finds a quiet light"), ("b" * 64, "the patient traveller finds a quite light")], "sid string, t string")
    near = S.near_texts(rows, rows)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join Inner" in x and "piece#" in x]  # pieces meet by number
    assert {(r.sid[0], r.other[0]) for r in near.collect()} == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}
