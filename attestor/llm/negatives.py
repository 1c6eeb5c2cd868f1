"""Hard negatives by segment summary filtering.

Components become whole numbers, ``floor(256 x)``; a row's score is its inner product with the anchor. Cut into segments, a
vector keeps of each segment of L components the mean and the deviation; for two vectors the sum of
``L mean mean' +- L dev dev'`` over the segments bounds their score from both sides (Cauchy-Schwarz on what is left
of the means). ``LEVELS`` cuts a vector ever finer: a row whose bounds rule it out at one level is not met at the next,
and what is left at the end is scored exactly in whole numbers.

1. Rows are dealt by hash into buckets of about ``CELLS`` numbers, whatever their label, so a hot label is spread like any other.
   Every bucket meets the stated query set, the anchors, which reach it batch by batch after its rows.
2. First pass: a bucket's best rows of the anchor's label. The bound to beat is the k-th best of the lower bounds.
   The buckets' few rows are merged by a window.
3. Second pass, with the positives' scores: a bucket's best rows of another label whose score is at most the
   positive's and at least 80 % of it. A row goes when its bounds miss the ranges of all positives, or when k rows that are surely
   within a range are surely better. Merged as before.

Each pass sends the rows once and the anchors once a bucket; nothing passes through the driver but the table's size.

Defined cases: rows with a null vec_id, label or vector, a null or non-finite component, or a sum of squared
components of 4e18 or more (their products leave 64 bits) take no part; a shorter vector counts as followed by zeros; rows
that repeat a vec_id are rows of their own, also as anchors and as each other's positives; ties go to the smaller vec_id; an
anchor without others of its label has no rows, a positive without rows in its range (always so below zero) neither; an empty table
gives no rows; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import blocks as B

POSITIVES = NEGATIVES = 5
CELLS = 1 << 19  # components of a bucket's rows
LEVELS = (1, 4, 16)  # segments of a vector
ANCHORS = 64  # anchors that are held against a bucket at a time
DENSE = 0.125  # share of pairs left from which on a block's scores are taken as one product


def prepared(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(rid, vec_id, label, v array<long>) of the rows that take part."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.lit(float(scale)) * x.cast("double"), F.lit(2.0)) + F.lit(1.0))
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    )
    fit = fit.filter(F.coalesce(squares < 4e18, F.lit(False)))  # null and NaN fail too
    return fit.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of whole numbers, zeros after shorter ones."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy()
    n = np.diff(at)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = values[at[0] : at[-1]]
    return out


class _Summaries:
    """Per level, the means and deviations of each segment, both scaled with the root of the segment's length."""

    def __init__(self, x: np.ndarray):
        f = x.astype(np.float64)
        self.x, self.f = x, f
        self.norm = np.sqrt((f * f).sum(axis=1))
        self.means, self.devs = [], []
        for n in LEVELS:
            if n > 1 and 2 * n > x.shape[1]:
                break
            cut = np.unique(np.arange(n) * x.shape[1] // n)
            length = np.diff(np.append(cut, x.shape[1]))
            sums, squares = (np.add.reduceat(y, cut, axis=1) if x.shape[1] else np.zeros((len(x), 1)) for y in (f, f * f))
            self.means.append(sums / np.sqrt(np.maximum(length, 1)))
            self.devs.append(np.sqrt(np.maximum(0.0, squares - sums * sums / np.maximum(length, 1))))

    def __getitem__(self, i) -> "_Summaries":
        out = object.__new__(_Summaries)
        out.x, out.f, out.norm = self.x[i], self.f[i], self.norm[i]
        out.means, out.devs = [m[i] for m in self.means], [d[i] for d in self.devs]
        return out

    def bounds(self, rows: "_Summaries", level: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, with room for rounding."""
        mid = self.means[level] @ rows.means[level].T
        reach = self.devs[level] @ rows.devs[level].T + np.outer(1e-9 * self.norm, rows.norm) + 1e-6
        return mid - reach, mid + reach

    def scores(self, rows: "_Summaries", alive: np.ndarray) -> np.ndarray:
        """Exact scores of the pairs that are alive; the others may hold anything."""
        small = len(self.norm) and len(rows.norm) and self.norm.max() * rows.norm.max() < 2**52
        if alive.mean() >= DENSE:
            return (self.f @ rows.f.T).astype(np.int64) if small else self.x @ rows.x.T
        out = np.zeros(alive.shape, np.int64)
        a, r = np.nonzero(alive)
        step = max(1, (1 << 21) // max(1, self.x.shape[1]))
        for k in range(0, len(a), step):
            i, j = a[k : k + step], r[k : k + step]
            out[i, j] = np.einsum("ij,ij->i", self.x[i], rows.x[j])
        return out


def _kth(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per line the k-th largest allowed value, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    held = np.where(allowed, values, -np.inf)
    return np.partition(held, values.shape[1] - k, axis=1)[:, -k]


def best_of_label(anchors: _Summaries, rows: _Summaries, other: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor the k best of the given rows (in the order of vec_id): (places, scores). ``other`` is false for itself."""
    alive = other.copy()
    for level in range(len(rows.means)):
        low, high = anchors.bounds(rows, level)
        alive &= high >= _kth(low, alive, k)[:, None]
    scores = anchors.scores(rows, alive)
    out = []
    for line, ok in zip(scores, alive):
        i = np.flatnonzero(ok)
        if len(i) > 4 * k:
            i = i[line[i] >= np.partition(line[i], len(i) - k)[-k]]
        i = i[np.argsort(-line[i], kind="stable")[:k]]
        out.append((i, line[i]))
    return out


def best_within(anchors: _Summaries, rows: _Summaries, allowed: np.ndarray, tops: np.ndarray, k: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each anchor and each of its ``tops`` (a matrix, -1 for none) the k best allowed rows with 80 top <= 100 score <= 100 top."""
    floors = -((-4 * tops) // 5)
    alive = allowed & (tops.max(axis=1) >= 0)[:, None]
    for level in range(len(rows.means)):
        low, high = anchors.bounds(rows, level)
        some = np.zeros_like(alive)
        for j in range(tops.shape[1]):
            top, floor = tops[:, j : j + 1], floors[:, j : j + 1]
            sure = alive & (low >= floor) & (high <= top)
            least = np.maximum(floor, _kth(low, sure, k)[:, None]) if sure.any() else floor
            some |= (top >= 0) & (high >= least) & (low <= top)
        alive &= some
    scores = anchors.scores(rows, alive)
    out = []
    for line, ok, top, floor in zip(scores, alive, tops, floors):
        i = np.flatnonzero(ok)
        i = i[(line[i] <= top.max()) & (line[i] >= floor[top >= 0].min(initial=0))]
        i = i[np.argsort(-line[i], kind="stable")]
        falling = -line[i]
        found = []
        for t, f in zip(top.tolist(), floor.tolist()):
            a = int(np.searchsorted(falling, -t, "left"))
            b = min(int(np.searchsorted(falling, -f, "right")), a + k) if t >= 0 else a
            found.append((i[a:b], line[i[a:b]]))
        out.append(found)
    return out


Searcher = Callable[[_Summaries, np.ndarray, np.ndarray, pa.RecordBatch], Iterator[tuple]]


def _per_bucket(work: Callable, width: int) -> Callable:
    """A task over (bucket, kind, rid, vec_id, label, v, tops) sorted by (bucket, kind): rows of a bucket, then its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, rows = None, [], None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                if a == b:
                    continue
                if number[a] != bucket:
                    bucket, parts, rows = number[a], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    parts.append(part)
                    continue
                if rows is None:
                    if not parts:
                        continue
                    table = pa.Table.from_batches(parts).sort_by([("vec_id", "ascending"), ("rid", "ascending")]).combine_chunks().to_batches()[0]
                    rows, parts = (_Summaries(_matrix(table.column(5), width)), *(table.column(c).to_numpy() for c in (2, 3, 4))), []
                for k in range(0, b - a, ANCHORS):
                    yield work(rows, part.slice(k, ANCHORS))

    return run


def _positives_in(width: int, k: int) -> Callable:
    def work(rows, part):
        held, rid, vec_id, label = rows
        anchors, anchor_rid, anchor_label = _Summaries(_matrix(part.column(5), width)), part.column(2).to_numpy(), part.column(4).to_numpy()
        out = [[], [], [], []]
        for name in np.unique(anchor_label):
            mine, same = np.flatnonzero(anchor_label == name), np.flatnonzero(label == name)
            if len(same):
                found = best_of_label(anchors[mine], held[same], rid[same] != anchor_rid[mine][:, None], k)
                for a, (i, score) in zip(mine.tolist(), found):
                    for column, x in zip(out, (np.full(len(i), anchor_rid[a]), rid[same][i], vec_id[same][i], score)):
                        column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], names=["anchor", "rid", "vec_id", "score"])

    return work


def _negatives_in(width: int, k: int) -> Callable:
    def work(rows, part):
        held, rid, vec_id, label = rows
        anchors, anchor_rid, anchor_label = _Summaries(_matrix(part.column(5), width)), part.column(2).to_numpy(), part.column(4).to_numpy()
        given = part.column(6).to_pylist()
        tops = np.full((len(given), max(map(len, given))), -1, np.int64)
        for a, t in enumerate(given):
            tops[a, : len(t)] = t
        out = [[], [], [], [], []]
        for a, lists in enumerate(best_within(anchors, held, label != anchor_label[:, None], tops, k)):
            for j, (i, score) in enumerate(lists):
                for column, x in zip(out, (np.full(len(i), anchor_rid[a]), np.full(len(i), j + 1), rid[i], vec_id[i], score)):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], names=["anchor", "place", "rid", "vec_id", "score"])

    return work


def _searched(rows: DataFrame, anchors: DataFrame, n_buckets: int, work: Callable, width: int, schema: str) -> DataFrame:
    """``work`` on every bucket of the rows with all anchors."""
    columns = ["bucket", "kind", "rid", "vec_id", "label", "v", "tops"]
    dealt = rows.select(F.pmod(F.xxhash64("rid"), F.lit(n_buckets)).alias("bucket"), F.lit(0).alias("kind"), "rid", "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("tops"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_buckets - 1).cast("long"))).alias("bucket"), F.lit(1).alias("kind"), "rid", "vec_id", "label", "v", "tops")
    both = dealt.unionByName(asked).select(*columns).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
    return B.small_batches(both).mapInArrow(_per_bucket(work, width), schema)


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``prepared`` rows."""
    rows = cut_lineage(rows)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_buckets = max(1, -(-n * max(1, width) // cells))
    anchors = rows.filter(is_anchor)
    near = _searched(rows, anchors.withColumn("tops", F.lit(None).cast("array<long>")), n_buckets, _positives_in(width, positives), width, "anchor long, rid long, vec_id long, score long")
    order = W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "rid")
    near = cut_lineage(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))
    tops = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("t")).select(F.col("anchor").alias("rid"), F.transform("t", lambda x: x["score"]).alias("tops"))
    asked = anchors.join(tops, "rid")
    far = _searched(rows, asked, n_buckets, _negatives_in(width, negatives), width, "anchor long, place long, rid long, vec_id long, score long")
    order = W.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "rid")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    found = far.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        near.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "place"]
    )
    named = found.join(anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
