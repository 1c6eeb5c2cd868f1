"""Words, shingles and hashes of whole Arrow text columns in numpy, for use inside ``mapInArrow`` tasks.

A column is worked through in blocks of about ``BLOCK_BYTES``, so a task's memory does not follow its batch;
one text longer than that is a block of its own. Hashes are 64 bits wide and do not depend on the block.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

pa.set_memory_pool(pa.system_memory_pool())  # workers live on between tasks; this pool gives freed memory back

BLOCK_BYTES = 1_000_000
BATCH_ROWS = 2_000
U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20_240_229))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_TEXT = np.ones(256, bool)  # [^\x20\x09-\x0D]
IS_TEXT[[0x20, *range(0x09, 0x0E)]] = False
IS_ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case
IS_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER_CODES = BYTE_CODES[LOWER]

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 65_536)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS``: whole texts are larger than usual rows."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@dataclass
class Words:
    """Words of a block in order: byte range, row, hash; ``first[r]`` is the number of words before row r.

    ``total`` holds running sums of which ``span_hash`` makes the hash of any stretch of bytes.
    """

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    total: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal stretches of ``kind`` bytes, lower-cased in A-Z; no word goes over a row's end."""
    n, rows = len(data), len(offsets) - 1
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    ends = inside[:n] & ~inside[1:]
    edges = offsets[1:-1]
    cut = edges[(edges > 0) & (edges < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER_CODES[data] * up[:n], out=total[1:])
    first = np.searchsorted(start, offsets)
    h = mix((total[end] - total[start]) * down[start])
    return Words(start, end, np.repeat(np.arange(rows), np.diff(first)), h, first, total)


def span_hash(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the lower-cased bytes a to b; a word's hash for a word's range."""
    return mix((w.total[b] - w.total[a]) * powers(len(w.total))[1][a])


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word (rows are not minded)."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * PLACE[k]
    return mix(out)


def shingles(w: Words, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes below 2**63, row) of all ``size``-word shingles; fewer words than that are one shingle."""
    count = np.diff(w.first)
    has = np.zeros(len(w.hash), bool)
    n = len(w.hash) - size + 1
    if n > 0:
        has[:n] = w.row[:n] == w.row[size - 1 :]
    h, row = runs(w.hash, size)[has[: max(n, 0)]], w.row[has]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        sums = np.array([(w.hash[w.first[r] : w.first[r + 1]] * PLACE[: count[r]]).sum() for r in short], np.uint64)
        whole = mix(sums + PLACE[15:16] * count[short].astype(np.uint64))
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h >> U(1), row


def distinct_sorted(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted within each row (rows ascending), repeats removed, and the rows' offsets."""
    at = np.searchsorted(row, np.arange(rows + 1))
    values = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=rows))]).astype(np.int64)


def per_row(op: np.ufunc, values: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    """``op`` folded over ``values[at[r]:at[r+1]]`` for each row r; ``empty`` for rows without values."""
    out = np.full((len(at) - 1, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = op.reduceat(values, at[full], axis=0)
    return out
