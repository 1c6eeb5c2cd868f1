"""Language identification with language-bitmask n-gram filters (bit-sliced Bloom filters).

Fit: n-grams (three bytes of lower-cased text) are counted per language on a bounded sample, the rows with the
smallest hashes of their id; each language's ``TOP`` most frequent ones go into one Bloom filter whose slots are
bitmasks, bit l standing for language l, in as many 64-bit words as the languages need. One look-up of an n-gram, the AND of its ``HASHES`` slots, therefore
returns all languages that contain it.

Score: every n-gram of a whole text is looked up; the popcount of each language's bit over the text is corrected
for the filter's false positives, whose rate is the share of set bits of that language to the power of ``HASHES``;
the language with the most corrected hits is predicted. Its score is its margin-free share: corrected hits by
n-grams looked up.

Defined cases: a null text, an empty text or one without a letter is ``und`` with score 0; a text with letters but
too short for an n-gram, or without a hit, gets the most frequent learned language with score 0; equal hits go to
the first language in code point order; rows without a language or text are not learned from; without anything
to learn every text is ``und``; repeated rows are each scored; further columns are kept by ``identify``.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks as B

SAMPLE = 20_000  # rows that the filter is fitted on, at most
TOP = 500  # n-grams of each language; few enough to tell languages with common ones apart
SLOTS = 2**17
HASHES = 3
UND = "und"
LEAST_SHARE = 0.2  # below this share of known n-grams a text is no running text of any learned language


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray  # a bitmask of languages per slot, a row for each 64 languages
    false_rate: np.ndarray  # of each language
    common: int  # the most frequent language


def learned(docs: DataFrame) -> Column:
    """Rows that may be learned from: a quarter of the ids is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, sample: int = SAMPLE, top: int = TOP) -> Filter:
    """Learns from the rows of ``docs`` (doc_id, text, lang) that have both text and language."""
    rows = B.small_batches(docs).filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # the share of ids that makes a sample of about this size is cut by hash, then exactly
    n = max(rows.count(), 1)
    share = int(min(1.0, 1.2 * sample / n + 1e-3) * 2**32)
    key = F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit(2**32 - 1))
    rows = rows.withColumn("k", key).filter(F.col("k") < share)
    bound = rows.select("k").orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    rows = rows.filter(F.col("k") <= F.lit(bound if bound is not None else -1))

    def grams(batches):
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for a, b, data, offsets in B.text_blocks(batch.column("text")):
                code, at = _grams(data, offsets)
                for name in sorted(set(lang[a:b])):
                    mine = np.repeat(lang[a:b] == name, np.diff(at))
                    value, cnt = np.unique(code[mine], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(value), pa.string()), pa.array(value.astype(np.int32)), pa.array(cnt.astype(np.int64))], names=["lang", "gram", "cnt"])

    counts = rows.select("lang", "text").mapInArrow(grams, "lang string, gram int, cnt long").groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt"))
    total = F.sum("cnt").over(W.partitionBy("lang"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cnt"), "gram"))
    best = counts.select("lang", "gram", rank.alias("r"), total.alias("total")).filter(F.col("r") <= top).toArrow()
    names = sorted(set(best.column("lang").to_pylist()))
    masks = np.zeros((-(-len(names) // 64), SLOTS), np.uint64)
    lang, gram = best.column("lang").to_pylist(), best.column("gram").to_numpy().astype(np.uint32)
    place = {x: k for k, x in enumerate(names)}
    index = np.array([place[x] for x in lang], np.int64)
    for slot in _slots(gram):
        np.bitwise_or.at(masks, (index // 64, slot), B.U(1) << (index % 64).astype(np.uint64))
    filled = np.array([((masks[k // 64] >> B.U(k % 64)) & B.U(1)).mean() for k in range(len(names))])
    totals = dict(zip(lang, best.column("total").to_pylist()))
    common = max(range(len(names)), key=lambda k: (totals[names[k]], -k), default=-1)
    return Filter(names, masks, filled**HASHES, common)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all three-byte grams inside each row that hold a letter byte in the middle, and the rows' offsets."""
    low = B.LOWER[data].astype(np.uint32)
    n = len(data)
    if n < 3:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    code = low[: n - 2] << np.uint32(16)
    code |= low[1 : n - 1] << np.uint32(8)
    code |= low[2:]
    keep = LETTER_BYTE[data[1 : n - 1]]
    for back in (1, 2):  # grams that go over a row's end
        edge = offsets[1:-1] - back
        keep[edge[(edge >= 0) & (edge < n - 2)]] = False
    count = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], count[np.clip(offsets, 0, n - 2)]


LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _slots(code: np.ndarray) -> list[np.ndarray]:
    return [(code * np.uint32(m)) >> np.uint32(32 - 17) for m in _MULTIPLIERS]


def _has_letter(column: pa.Array) -> np.ndarray:
    plain = pc.match_substring_regex(column, r"\p{L}")
    return pc.fill_null(plain, False).to_numpy(zero_copy_only=False)


def predictions(model: Filter, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score) of every text; the index after the last language stands for ``und``."""
    k = len(model.languages)
    best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b, data, offsets in B.text_blocks(column):
        code, at = _grams(data, offsets)
        slots = _slots(code)
        n = np.diff(at)
        hits = np.zeros((b - a, max(k, 1)))
        for lang in range(k):
            if lang % 64 == 0:
                mask = np.full(len(code), ~B.U(0), np.uint64)
                for slot in slots:
                    mask &= model.masks[lang // 64][slot]
            bits = ((mask >> B.U(lang % 64)) & B.U(1)).astype(np.int64)
            raw = np.diff(np.concatenate([[0], np.cumsum(bits)])[at])
            rate = model.false_rate[lang]
            hits[:, lang] = np.maximum((raw - n * rate) / (1 - rate), 0)
        top = hits.argmax(1)
        share = np.minimum(hits.max(1) / np.maximum(n, 1), 1.0)
        top[share == 0] = model.common
        best.append(top)
        score.append(share)
    letter = _has_letter(column) & (k > 0)
    return np.where(letter, np.concatenate(best), k), np.where(letter, np.concatenate(score), 0.0)


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced). Narrow: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    B.small_batches(docs)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*[f"`{c}`" for c in own])

    def run(batches):
        names = pa.array([*shared.value.languages, UND], pa.string())
        for batch in batches:
            pick, score = predictions(shared.value, batch.column("text"))
            yield pa.record_batch([*(batch.column(c) for c in own), names.take(pa.array(pick)), pa.array(score)], names=[*own, "lang_pred", "score"])

    return base.mapInArrow(run, base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def recognised(docs: DataFrame, model: Filter, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs`` that are text of a learned language: not ``und``, and enough of their n-grams known."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        und = len(shared.value.languages)
        for batch in batches:
            pick, score = predictions(shared.value, batch.column("text"))
            yield batch.filter(pa.array((pick != und) & (score >= least)))

    return B.small_batches(docs).mapInArrow(run, docs.schema)
