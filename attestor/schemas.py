"""Declared schemas; nothing is inferred at read time."""
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType,
)


def _s(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, I, L, D, B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

CANON_UNIT = _s(group_no=I, unit_no=I, text_display=S, text_match=S)
CANON_GROUP = _s(group_no=I, name=S, name_en=S, units=I, type=S)
CORPUS_TOKEN = _s(pos=L, word=S, group_no=I, unit_no=I)
TRANSLATED = _s(title=S, hadeeth=S, attribution=S, grade=S, explanation=S, url=S)
GRADED_RECORD = _s(
    id=S, title=S, hadeeth=S, hadeeth_intro=S, attribution=S, grade=S, explanation=S, hints=ArrayType(S), reference=S, categories=ArrayType(S), url=S, en=TRANSLATED
)
GRADED_FILE = _s(hadeeths=ArrayType(GRADED_RECORD))
UNGRADED_DOC = _s(doc_id=L, book=S, num=I, text=S, norm=S)
BOOK = _s(book=S, name=S, name_en=S, trusted=B)
GRADE = _s(text=S, scholar=S, book=S, narrator=S, source_name=S, source_url=S)
LIBRARY_PAGE = _s(url=S, book_id=I, page=I, book=S, author=S, place=S, text=S)
TITLE_PAGE = _s(title=S, url=S, collection=S)
SEGMENT = _s(doc_id=L, seg_id=I, text=S, start_s=D, end_s=D)
DOCUMENT = _s(doc_id=L, text=S, input_type=S, title=S, url=S, duration=D, transcript_origin=S, language=S)
CLAIM = _s(
    claim_id=S, doc_id=L, type=S, quote=S, start=I, end=I, attributed_to=S, explicit_attribution=B, level=S, certainty=S, origin=S, closed=B, is_question=B
)
CANDIDATE = _s(claim_id=S, corpus=S, key=S, rank=I, similarity=D, coverage=D, matched_span_text=S)
DIFF_STEP = _s(op=S, quoted=S, source=S)
SPAN = _s(segment_id=I, start=I, end=I)
VERDICT = _s(
    claim_id=S, doc_id=L, type=S, quote=S, start=I, end=I, level=S, certainty=S, state=S, action=S, rule_id=S, match_kind=S, similarity=D, referral=B,
    grade_unavailable=B, personal_case=B, disagreement_noted=B, is_question=B, source_text=S, ref=S, url=S, grades=ArrayType(GRADE), diff=ArrayType(DIFF_STEP), spans=ArrayType(SPAN),
)
SUMMARY = _s(doc_id=L, total=L, by_state=MapType(S, L), stage_seconds=MapType(S, D), warnings=ArrayType(S))
CALL_LOG = _s(
    ts=TimestampType(), day=S, task=S, model=S, prompt_tokens=I, completion_tokens=I, cached_tokens=I, cost_usd=D, latency_ms=I, ok=B, fallback=B, error=S
)
CACHE_ENTRY = _s(k=S, v=S, t=D)
TESTSET = _s(id=S, input_text=S, claim_type=S, content_level=S, expected_state=S, expected_ref=S, category=S, notes=S, reviewed=B)
PREDICTION = _s(id=S, run=I, system=S, state=S, ref=S, has_source=B, seconds=D, detail=S)
CAPTION_FILE = _s(events=ArrayType(_s(tStartMs=L, dDurationMs=L, aAppend=I, segs=ArrayType(_s(utf8=S)))))
TRACKS = _s(language=S, tracks=ArrayType(_s(lang=S, manual=B, ext=S, url=S)))
