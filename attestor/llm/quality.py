"""Quality classifier by co-training of two views.

The *content* view sees the text: shares of letters, digits, capitals, symbols and punctuation, word and line
statistics, repetition, and hashed beginnings of words. The *metadata* view sees what a page's record says: source,
language, stated length. Each view has a logistic classifier. In each of ``ROUNDS`` rounds either classifier labels
the unlabelled texts it is most sure of and adds them to the other's examples. On a part of the labelled
rows that neither has seen, both are calibrated and weighed against each other by a third logistic fit; the sum
scores all documents.

Fitting uses bounded samples: at most ``LABELLED`` labelled and ``POOL`` unlabelled rows, those with the smallest
hashes of their id. Scoring is one narrow pass over whole texts.

Defined cases: a null text counts as empty, a null source, language or length as its own value; labels other than 0
and 1, and labels of missing documents, teach nothing; with only one class, or none, to learn from every score
is that class's (0 when there is none); repeated rows are each scored; further columns are ignored.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

LABELLED, POOL = 4_000, 8_000
ROUNDS, SURE_ROWS = 5, 200  # rows that either view labels for the other in a round, by class in proportion
STATISTICS, WORD_SLOTS = 14, 64
SOURCES, LANGUAGES, LENGTHS = 64, 16, 24
CONTENT, METADATA = STATISTICS + WORD_SLOTS, SOURCES + LANGUAGES + LENGTHS + 1


def learned(docs: DataFrame) -> Column:
    """Rows whose labels may be learned from: a fifth of the ids is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


# --------------------------------------------------------------------------- views

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True  # letters
_CLASS[1, 48:58] = True
_CLASS[2, 65:91] = True
_CLASS[3, [ord(c) for c in "#$%&*+<=>@\\^_`{|}~/[]"]] = True
_CLASS[4, [ord(c) for c in ".,;:!?"]] = True
_CLASS[5, 10] = True


def content_view(column: pa.Array) -> np.ndarray:
    out = []
    for a, b, data, offsets in B.text_blocks(column):
        n = np.diff(offsets)
        size = np.maximum(n, 1)
        w = B.words(data, offsets, B.IS_TEXT)
        count = np.diff(w.first)
        x = np.zeros((b - a, CONTENT), np.float32)
        shares = [np.diff(np.concatenate([[0], np.cumsum(kind[data])])[offsets]) / size for kind in _CLASS]
        for k, s in enumerate(shares):
            x[:, k] = s
        at = np.sort(w.row.astype(np.uint64) * B.U(2**40) + (w.hash >> B.U(24)))
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        distinct = np.bincount((at[new] >> B.U(40)).astype(np.int64), minlength=b - a)
        again = np.zeros(len(w.hash), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        words = np.maximum(count, 1)
        x[:, 6] = np.log1p(n) / 10
        x[:, 7] = np.log1p(count) / 8
        x[:, 8] = n / words / 10
        x[:, 9] = distinct / words
        x[:, 10] = np.bincount(w.row[again], minlength=b - a) / words
        x[:, 11] = shares[4] * n / words
        x[:, 12] = np.minimum(shares[2] * n / words, 3)
        x[:, 13] = count < 5
        head = B.span_hash(w, w.start, np.minimum(w.start + 3, w.end))
        slot = w.row * WORD_SLOTS + (head >> B.U(58)).astype(np.int64)
        x[:, STATISTICS:] = np.bincount(slot, minlength=(b - a) * WORD_SLOTS).reshape(b - a, WORD_SLOTS) / words[:, None] * 4
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, CONTENT), np.float32)


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    x = np.zeros((batch.num_rows, METADATA), np.float32)
    rows = np.arange(batch.num_rows)
    for name, first, size in (("source", 0, SOURCES), ("lang", SOURCES, LANGUAGES)):
        x[rows, [first + zlib.crc32(repr(v).encode()) % size for v in batch.column(name).to_pylist()]] = 1
    length = [-1 if v is None else int(v) for v in batch.column("n_chars").to_pylist()]
    x[rows, [SOURCES + LANGUAGES + (0 if v < 0 else 1 + min(v, 2**21).bit_length()) for v in length]] = 1
    x[:, -1] = 1
    return x


# --------------------------------------------------------------------------- classifiers


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, centre, scale) of a ridge logistic fit by Newton steps; the last weight is the intercept."""
    x = x.astype(float)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ ((p - y) * weight) + pull * w
        w -= np.linalg.solve((z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(pull), grad)
    return w, centre, scale


def margin(model: tuple, x: np.ndarray) -> np.ndarray:
    w, centre, scale = model
    return (x - centre) / scale @ w[:-1] + w[-1]


@dataclass
class Model:
    views: list[tuple]
    joint: tuple | None
    constant: float | None = None


def co_trained(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], unseen: np.ndarray, rounds: int = ROUNDS, sure: int = SURE_ROWS) -> Model:
    """``x``, ``pool``: the two views of labelled and unlabelled rows; ``unseen`` marks the rows for calibration."""
    seen = ~unseen
    share = y[seen].mean()
    extra: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view was given by the other
    models: list[tuple] = []
    for turn in range(rounds + 1):
        models = []
        for v in (0, 1):
            rows = np.array(list(extra[v]), np.int64)
            given = np.array(list(extra[v].values()), float)
            models.append(logistic(np.concatenate([x[v][seen], pool[v][rows]]), np.concatenate([y[seen], given]), np.concatenate([np.ones(seen.sum()), np.full(len(rows), 0.5)])))
        if turn == rounds or not len(pool[0]):
            break
        for v in (0, 1):
            m = margin(models[v], pool[v])
            order = np.argsort(m, kind="stable")
            many = max(1, round(sure * share)), max(1, round(sure * (1 - share)))
            for r in order[::-1][: many[0]].tolist():
                if m[r] > 2:
                    extra[1 - v].setdefault(r, 1.0)
            for r in order[: many[1]].tolist():
                if m[r] < -2:
                    extra[1 - v].setdefault(r, 0.0)
    both = np.stack([margin(models[v], x[v][unseen]) for v in (0, 1)], axis=1)
    joint = logistic(both, y[unseen], np.ones(unseen.sum())) if len(set(y[unseen])) == 2 else None
    return Model(models, joint)


def combined(model: Model, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(content), model.constant)
    both = np.stack([margin(model.views[0], content), margin(model.views[1], metadata)], axis=1)
    z = margin(model.joint, both) if model.joint else both.sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> Model:
    """Trains on bounded samples of ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality)."""
    key = F.xxhash64("doc_id", F.lit(13))
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").dropDuplicates(["doc_id"])
    chosen = known.withColumn("k", key).orderBy("k", "doc_id").limit(labelled).select("doc_id", "quality")
    rest = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(labels.select("doc_id"), "doc_id", "left_anti")
    more = rest.withColumn("k", key).orderBy("k", "doc_id").limit(pool).select("doc_id", F.lit(-1).alias("quality"))
    wanted = chosen.unionByName(more)  # labelled + pool rows at most

    def views(batches):
        for batch in batches:
            c, m = content_view(batch.column("text")), metadata_view(batch)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in c], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], names=["doc_id", "quality", "c", "m"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(wanted), "doc_id")
    got = rows.mapInArrow(views, "doc_id long, quality int, c binary, m binary").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    label = got.column("quality").to_numpy()
    c, m = (np.frombuffer(b"".join(got.column(n).to_pylist()), np.float32).reshape(-1, width) for n, width in (("c", CONTENT), ("m", METADATA)))
    has = label >= 0
    y = label[has].astype(float)
    if not len(y) or y.min() == y.max():
        return Model([], None, float(y[0]) if len(y) else 0.0)
    unseen = np.arange(len(y)) % 4 == 3
    return co_trained([c[has], m[has]], y, [c[~has], m[~has]], unseen, rounds)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: 0 to 1, higher: label 1, good quality, likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                score = combined(shared.value, content_view(part.column("text")), metadata_view(part))
                yield pa.record_batch([part.column("doc_id"), pa.array(score.astype(float))], names=["doc_id", "score"])

    base = B.small_batches(docs).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return base.mapInArrow(run, base.select("doc_id", F.lit(0.0).alias("score")).schema)
