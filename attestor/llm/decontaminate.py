"""Benchmark decontamination by suffix arrays of the training texts.

Each shard, a block of training texts, sorts the suffixes of its word stream. Every suffix of every test item is
looked up in it by binary search; the stretch of array entries that begin with the suffix's window gives all its
places, and each place is prolonged word by word to the longest verbatim match. Places of a text that repeats a
passage are met a bounded number at a time, and only those where a longest match begins are kept. Suffixes whose first words begin
no test window cannot hold a match and are left out of the array. Texts never leave their row, so there is no
shuffle. The test side is a stated query set: it is read in pieces of at most ``PIECE_WORDS`` words, one narrow
pass per piece, so what is broadcast is bounded however large the benchmark is.

A window is ``window`` consecutive words of an item, or the whole item when it has fewer words. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; they are compared by 64-bit hashes.

Defined cases: null or wordless texts and items match nothing; repeated rows are each scanned; equal items are
each reported; an empty benchmark leaves every document clean; further columns of the documents are kept.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

WINDOW = 10
PIECE_WORDS = 500_000
PAIRS_AT_ONCE = 1_000_000
MATCH = "array<struct<item_id:string,doc_start:int,item_start:int,length:int>>"
MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with two columns: ``n_words`` and ``matches``, all longest verbatim matches with benchmark items.

    A match is longest when neither the word before nor the word after it agrees; it holds at least one window.
    Windows of an item that is cut into pieces overlap, so that a match over a cut is reported by both pieces.
    """
    B.small_batches(docs)
    names = [c for c in docs.columns if c not in ("n_words", "matches")]
    out = docs.select(*names, F.lit(0).alias("n_words"), F.array().cast(MATCH).alias("matches"))
    for piece in test_pieces(benchmark, window):
        shared = docs.sparkSession.sparkContext.broadcast(piece)
        out = out.mapInArrow(_scan(shared, window), out.schema)
    return out


def test_pieces(benchmark: DataFrame, window: int = WINDOW) -> Iterator[tuple]:
    """(item ids, first word of the piece within its item, offsets, word hashes) of pieces of bounded size.

    The items' words are hashed on the cluster and come to the driver one Arrow batch at a time.
    """

    def hashed(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for a, b, data, offsets in B.text_blocks(batch.column("text")):
                w = B.words(data, offsets, B.IS_ALNUM)
                for r in range(b - a):
                    own = w.hash[w.first[r] : w.first[r + 1]]
                    step = PIECE_WORDS - window
                    for s in range(0, max(len(own) - window + 1, 1), step):
                        part = own[s : s + PIECE_WORDS - 1]
                        if len(part):
                            yield pa.record_batch([ids.slice(a + r, 1), pa.array([s]), pa.array([len(own)]), pa.array([part.tobytes()])], names=["item_id", "at", "n", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(hashed, "item_id string, at long, n long, words binary")
    held, size = [], 0
    found = False
    for row in rows.toLocalIterator():
        n = len(row["words"]) // 8
        if held and size + n > PIECE_WORDS:
            yield _piece(held)
            held, size, found = [], 0, True
        held.append(row)
        size += n
    if held or not found:
        yield _piece(held)


def _piece(rows: list) -> tuple:
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    return (
        [r["item_id"] for r in rows], np.array([r["at"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64),
        np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64), np.concatenate([*words, np.zeros(0, np.uint64)]),
    )


class TestSuffixes:
    """The windows of a piece, each at its first word, and the seeds that a training suffix must begin with."""

    def __init__(self, piece: tuple, window: int):
        self.ids, self.at, self.whole, offsets, self.words = piece
        n = np.diff(offsets)
        length = np.where(self.whole < window, self.whole, window)  # of the windows of each part
        count = np.maximum(n - length + 1, 0)
        self.item = np.repeat(np.arange(len(n)), count)
        self.pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][self.item]
        self.length = length[self.item]
        self.first, self.last = offsets[:-1][self.item], offsets[1:][self.item]
        self.window = window
        self.seed = int(min(3, self.length.min())) if len(self.length) else 0
        ahead = np.minimum(self.pos[:, None] + np.arange(window), max(len(self.words) - 1, 0))
        self.keys = np.where(np.arange(window) < self.length[:, None], self.words[ahead] if len(self.words) else 0, 0)
        seeds = np.unique(B.runs(self.words, self.seed)[self.pos]) if self.seed else np.zeros(0, np.uint64)
        self.seeds = seeds
        self.filter = np.zeros(2**22, bool)
        self.filter[(seeds >> B.U(42)).astype(np.int64)] = True

    def begins(self, h: np.ndarray) -> np.ndarray:
        """Positions of a word stream whose first words begin some window."""
        seed = B.runs(h, self.seed)
        maybe = np.flatnonzero(self.filter[(seed >> B.U(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.seeds, seed[maybe]), len(self.seeds) - 1)
        return maybe[self.seeds[place] == seed[maybe]]


def suffix_array(h: np.ndarray, end: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their suffixes' first ``depth`` words, and those words; 0 stands for the text's end."""
    at = starts[:, None] + np.arange(depth)
    keys = np.where(at < end[starts][:, None], h[np.minimum(at, len(h) - 1)], 0)
    order = np.lexsort(keys.T[::-1])
    return starts[order], keys[order]


def search(keys: np.ndarray, wanted: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted`` the stretch of sorted ``keys`` whose first ``length`` words equal it: binary searches in step."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
        while (open_ := lo < hi).any():
            q = np.flatnonzero(open_)
            mid = (lo[q] + hi[q]) >> 1
            a, b = keys[mid], wanted[q]
            live = np.arange(keys.shape[1]) < length[q][:, None]
            differ = (a != b) & live
            col = differ.argmax(1)
            same = ~differ[np.arange(len(q)), col]
            less = a[np.arange(len(q)), col] < b[np.arange(len(q)), col]
            go = np.where(same, upper, less)
            lo[q] = np.where(go, mid + 1, lo[q])
            hi[q] = np.where(go, hi[q], mid)
        bounds.append(lo)
    return bounds[0], bounds[1]


def longest_matches(w: B.Words, test: TestSuffixes) -> tuple[np.ndarray, ...]:
    """(row, doc word, item, item word in the piece, length) of all longest matches of a shard, in row order."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not len(test.pos) or len(w.hash) < test.seed:
        return none
    h, end = w.hash, w.first[1:][w.row]
    starts = test.begins(h)
    starts = starts[starts + test.seed <= end[starts]]
    if not len(starts):
        return none
    places, keys = suffix_array(h, end, starts, test.window)
    lo, hi = search(keys, test.keys, test.length)
    # pairs of a window and a place, a bounded number at a time; of those that agree to the left too a longer match tells
    ends = np.cumsum(hi - lo)
    longest: list[tuple[np.ndarray, ...]] = []
    for s in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        n = np.arange(s, min(s + PAIRS_AT_ONCE, int(ends[-1])))
        q = np.searchsorted(ends, n, "right")
        p = places[hi[q] - (ends[q] - n)]
        t = test.pos[q]
        at_left = (t > test.first[q]) & (p > w.first[w.row[p]])
        left = ~at_left
        left[at_left] = h[p[at_left] - 1] != test.words[t[at_left] - 1]
        longest.append((q[left], p[left], t[left]))
    if not longest:
        return none
    q, p, t = (np.concatenate(x) for x in zip(*longest))
    length = test.length[q].copy()
    open_ = np.arange(len(q))
    while len(open_):
        a, b = p[open_] + length[open_], t[open_] + length[open_]
        on = (a < end[p[open_]]) & (b < test.last[q[open_]])
        open_, a, b = open_[on], a[on], b[on]
        open_ = open_[h[a] == test.words[b]]
        length[open_] += 1
    row = w.row[p]
    order = np.lexsort((t, p))
    q, p, t, length, row = (x[order] for x in (q, p, t, length, row))
    return row, p - w.first[row], test.item[q], t - test.first[q] + test.at[test.item[q]], length


def _scan(shared, window: int):
    def run(batches):
        test = TestSuffixes(shared.value, window)
        ids = pa.array(test.ids, pa.string())
        for batch in batches:
            n_words, sizes, parts = [], [], []
            for a, b, data, offsets in B.text_blocks(batch.column("text")):
                w = B.words(data, offsets, B.IS_ALNUM)
                row, doc, item, start, length = longest_matches(w, test)
                n_words.append(np.diff(w.first))
                sizes.append(np.bincount(row, minlength=b - a))
                parts.append((item, doc, start, length))
            if not n_words:
                continue
            item, doc, start, length = (np.concatenate(x) for x in zip(*parts))
            new = pa.StructArray.from_arrays([ids.take(pa.array(item)), *(pa.array(x.astype(np.int32)) for x in (doc, start, length))], fields=list(MATCH_TYPE.value_type))
            size = np.concatenate(sizes)
            old = batch.column("matches")
            had = np.diff(old.offsets.to_numpy()) if len(old) else size
            if had.any():  # matches with earlier pieces stand before these
                both = pa.concat_arrays([old.flatten().cast(MATCH_TYPE.value_type), new])
                first_old, first_new = np.cumsum(had) - had, np.cumsum(size) - size + had.sum()
                pick = np.concatenate([np.r_[first_old[r] : first_old[r] + had[r], first_new[r] : first_new[r] + size[r]] for r in range(len(size))])
                new, size = both.take(pa.array(pick.astype(np.int64))), size + had
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            values = {"n_words": pa.array(np.concatenate(n_words).astype(np.int32)), "matches": pa.ListArray.from_arrays(offsets, new)}
            yield pa.record_batch([values.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, matches, n_hit (words inside a match), items (sorted distinct ids) and contaminated."""
    out = with_matches(docs, benchmark, window)
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        spans, start,
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")),
    )
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return out.withColumns({"n_hit": covered["n"], "items": items}).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""

    def clean(shared):
        def run(batches):
            test = TestSuffixes(shared.value, window)
            for batch in batches:
                hit = [np.zeros(0, bool)]
                for a, b, data, offsets in B.text_blocks(batch.column("text")):
                    row, *_ = longest_matches(B.words(data, offsets, B.IS_ALNUM), test)
                    hit.append(np.bincount(row, minlength=b - a) > 0)
                yield batch.filter(pa.array(~np.concatenate(hit)))

        return run

    out = B.small_batches(docs)
    for piece in test_pieces(benchmark, window):
        out = out.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(piece)), docs.schema)
    return out
