"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: each distinct word (words as between white space, A-Z lower-cased) with weight
``1 + ln(count)``. For each of ``SAMPLES`` draws and each word, two gamma(2, 1) variates r and c and a uniform
variate b are functions of word and draw alone. The weight S gives ``t = floor(ln S / r + b)`` and
``ln a = ln c - r (t - b) - r``; the word with the smallest a, together with its t, is the sample. Two texts draw the
same sample with a probability equal to their generalised Jaccard similarity, the sum of the smaller weights
by the sum of the larger ones. The value of a names the sample (it is a function of word, draw and t), so a
signature keeps 16 hashed bits of it per draw; a chance agreement of two bits patterns has probability 2**-16.

Variates come from tables of ``QUANTILES`` gamma quantiles, picked by bits of the word's hash times an odd number
of the draw; no random state is kept anywhere, so any task on any machine draws alike.

``with_edits`` needs each document beside its successor by id: texts are dealt once into ranges of ids, and the
first document of each range also goes to the range before it. No global sort, no window over the whole table.

Defined cases: a null or empty text, or one without a word, has the fingerprint of zeros and likeness 1 to another
such text, 0 to any other; equal texts have equal fingerprints; a repeated id orders by text, so repeated rows
are each other's successors; rows with a null id come first; a single document follows itself; an empty table
gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SAMPLES = 128
QUANTILES = 2**16
ROWS_AT_ONCE = 4096
RANGE_ROWS = 4_000  # documents in a range of ids, about

_tables: list[np.ndarray] = []


def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of gamma(2, 1) and their logarithms: x with 1 - (1 + x) exp(-x) = (k + 1/2) / QUANTILES."""
    if not _tables:
        p = (np.arange(QUANTILES) + 0.5) / QUANTILES
        lo, hi = np.zeros(QUANTILES), np.full(QUANTILES, 60.0)
        for _ in range(60):
            mid = (lo + hi) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < p
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        _tables[:] = [lo.astype(np.float32), np.log(lo).astype(np.float32)]
    return _tables[0], _tables[1]


DRAWS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, SAMPLES, dtype=np.uint64) | B.U(1)


def log_a(words: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """ln a of each word (rows) and draw (columns), float32."""
    gamma, log_gamma = _gamma_tables()
    out = np.empty((len(words), SAMPLES), np.float32)
    for s in range(0, len(words), ROWS_AT_ONCE):
        x = words[s : s + ROWS_AT_ONCE, None] * DRAWS
        x ^= x >> B.U(29)
        x *= B.BASE
        r = gamma[(x >> B.U(48)).astype(np.int64)]
        log_c = log_gamma[((x >> B.U(32)) & B.U(0xFFFF)).astype(np.int64)]
        b = ((x >> B.U(8)) & B.U(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight[s : s + ROWS_AT_ONCE, None] / r + b)
        out[s : s + ROWS_AT_ONCE] = log_c - r * (t - b) - r
    return out


def signatures(column: pa.Array) -> np.ndarray:
    """(rows, SAMPLES) 16-bit samples of a string column; zeros for texts without words."""
    out = []
    for a, b, data, offsets in B.text_blocks(column):
        w = B.words(data, offsets, B.IS_TEXT)
        value, cnt, at = _counted(w, b - a)
        row = np.repeat(np.arange(b - a), np.diff(at))
        pair = value ^ B.mix(cnt.astype(np.uint64))
        _, first, which = np.unique(pair, return_index=True, return_inverse=True)
        logs = log_a(B.mix(value[first]), np.log1p(np.log(cnt[first])).astype(np.float32))
        low = np.full((b - a, SAMPLES), np.inf, np.float32)
        step = 16_384
        for s in range(0, len(row), step):  # rows of the matrix gathered a bounded number at a time
            e = min(s + step, len(row))
            heads = np.concatenate([[0], np.flatnonzero(row[s + 1 : e] != row[s : e - 1]) + 1])
            part = np.minimum.reduceat(logs[which[s:e]], heads, axis=0)
            rows_here = row[s + heads]
            low[rows_here] = np.minimum(low[rows_here], part)
        bits = low.view(np.uint32)
        sample = (B.mix(bits.astype(np.uint64) + np.arange(SAMPLES, dtype=np.uint64) * B.BASE) >> B.U(48)).astype(np.uint16)
        sample[np.diff(at) == 0] = 0
        out.append(sample)
    return np.concatenate(out) if out else np.zeros((0, SAMPLES), np.uint16)


def _counted(w: B.Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of each row with their counts, and the rows' offsets."""
    h = w.hash.copy()
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w.row[1:] != w.row[:-1])
    head = np.flatnonzero(new)
    cnt = np.diff(np.concatenate([head, [len(h)]]))
    at = np.concatenate([[0], np.cumsum(np.bincount(w.row[head], minlength=rows))]).astype(np.int64)
    return h[head], cnt, at


def hexed(sample: np.ndarray) -> pa.Array:
    """Signatures as strings of four hexadecimal digits per draw."""
    big = np.ascontiguousarray(sample.astype(">u2"))
    return pa.array([row.tobytes().hex() for row in big], pa.string())


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal samples; texts without words are like each other only."""
    return (x == y).mean(1) if len(x) else np.zeros(0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text). Narrow: no shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), hexed(signatures(batch.column("text")))], names=["doc_id", "fingerprint"])

    base = B.small_batches(docs).select("doc_id", "text")
    return base.mapInArrow(run, base.select("doc_id", F.lit("").alias("fingerprint")).schema)


NULL_KEY = -(2**63)  # a null id comes first


def by_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``part``, the range of ids that a row is dealt to, and ``extra``.

    ``extra`` is 1 for a second copy of a range's first document in the range before it (of the first range, in the
    last one), where it is a successor only. Ranges are even stretches between quantiles of the ids; 63
    quantiles and one row per range are all the driver sees.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))
    ids = docs.select(key.alias("key"))
    n, low, high = ids.agg(F.count("*"), F.min("key"), F.max("key")).first()
    cuts = sorted({int(c) for c in ids.approxQuantile("key", [k / 64 for k in range(1, 64)], 0.005)}) if n > RANGE_ROWS else []
    fine = max(1, round(n / RANGE_ROWS / 64))
    edges = [low or 0, *cuts, (high or 0) + 1]
    coarse = F.lit(0)
    for k, c in enumerate(cuts, 1):
        coarse = F.when(key >= c, k).otherwise(coarse)
    start, end = (F.element_at(F.array(*[F.lit(float(x)) for x in side]), coarse + 1) for side in (edges[:-1], edges[1:]))
    inner = F.floor((key.cast("double") - start) * fine / F.greatest(end - start, F.lit(1.0)))
    part = coarse * fine + F.least(F.greatest(inner, F.lit(0)), F.lit(fine - 1))
    tie = F.xxhash64("text")
    dealt = docs.select("doc_id", "text", part.cast("int").alias("part"))
    firsts = dealt.groupBy("part").agg(F.min(F.struct(key.alias("key"), tie.alias("tie"))).alias("m")).select("part", "m.*").orderBy("part").collect()
    before = [firsts[k - 1]["part"] for k in range(len(firsts))]  # of the first range, the last
    rows = [(r["part"], r["key"], r["tie"], to) for r, to in zip(firsts, before)]
    table = docs.sparkSession.createDataFrame(rows, "part int, first_key long, first_tie long, to int")
    marked = dealt.join(F.broadcast(table), "part")  # one row per RANGE_ROWS documents
    own, copy = (F.struct(c.alias("part"), F.lit(x).alias("extra")) for c, x in ((F.col("part"), 0), (F.col("to"), 1)))
    copies = F.when((key == F.col("first_key")) & (tie == F.col("first_tie")), F.array(own, copy)).otherwise(F.array(own))
    return marked.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.part", "c.extra")


def with_edits(docs: DataFrame) -> DataFrame:
    """Every document with its own, its edited text's and its successor's fingerprint likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited
    text has the last quarter (rounded down, in code points) replaced by as many first code points of the
    successor's text, or all of it when it is shorter.
    """
    tidy = by_ranges(B.small_batches(docs).select("doc_id", "text")).repartition("part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = docs.select("doc_id").schema.add("n_chars", "long")
    for c in names[2:5]:
        schema = schema.add(c, "string")
    for c in names[5:]:
        schema = schema.add(c, "double")

    def rows(ids, texts):
        """``texts`` has one more entry than ``ids``: the last one's successor."""
        edited = []
        for own, after in zip(texts[:-1], texts[1:]):
            k = len(own) // 4
            edited.append(own[: len(own) - k] + after[:k])
        mine, other = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(edited, pa.large_string()))
        sha = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string())
        values = [pa.array(ids), pa.array([len(x) for x in texts[:-1]], pa.int64()), sha, hexed(mine[:-1]), hexed(other), pa.array(likeness(mine[:-1], other)), pa.array(likeness(mine[:-1], mine[1:]))]
        values[0] = values[0].cast(pa.int64()) if pa.types.is_null(values[0].type) else values[0]
        return pa.record_batch(values, names=names)

    def run(batches):
        part, ids, texts, size, extra = None, [], [], 0, False
        for batch in batches:
            cols = [batch.column(c) for c in ("part", "extra", "doc_id", "text")]
            for p, e, i, t in zip(*(c.to_pylist() for c in cols)):
                if p != part:
                    part, ids, texts, size, extra = p, [], [], 0, False
                if extra:
                    continue  # repeats of the successor
                texts.append(t or "")
                extra = bool(e)
                if len(texts) > 1 and (extra or size > 4_000_000):
                    yield rows(ids, texts)
                    ids, texts, size = [], texts[-1:], 0
                if not extra:
                    ids.append(i)
                    size += len(texts[-1])

    return tidy.mapInArrow(run, schema)
