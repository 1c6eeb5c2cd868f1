"""Copies among the records of a scan."""
from attestor.operators import scan as S


def test_copies_of_a_record_are_laid_once(spark):
    text = [f"w{k}" for k in range(50)]
    records = spark.createDataFrame([(k, text) for k in range(5, 40)] + [(3, ["x", *text[5:]]), (None, text)], "src long, words array<string>")
    words = spark.createDataFrame([(1, text), (2, text[4:20])], "doc_id long, words array<string>")
    for cap in (1, S.RECORD_HOT):
        rows = sorted(map(tuple, S.record_scan(words, records, True, cap=cap, script="latin").select("doc_id", "src", "start_w", "end_w").collect()))
        assert rows == [(1, 5, 0, 50), (2, 5, 0, 16)], (cap, rows)
