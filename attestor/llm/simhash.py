"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits: bit b is 1 if bit b is set in over half of the XXH64 hashes (seed 42) of its 3-word
shingles, repeats included. Two fingerprints link at ``NEAR`` = 3 or fewer differing bits.

1. One narrow pass makes the fingerprints; equal ones are one class from here on, so a group of copies is one row.
2. A fingerprint is cut into two segments of 32 bits, fewer than the four that exact segments would need: of three
   differing bits one segment holds at most one. Each segment is indexed under its 32 *variants*, in each of which
   one bit is deleted; two segments that differ by at most one bit share a variant. Equal variants meet by one
   shuffle, 64 short rows a class.
3. Every bucket is verified bit by bit. A pair whose segments differ meets in one bucket of that segment; pairs whose
   segments are equal are met in the first of the 32 only. A bucket emits the links that join its parts
   (breadth first over what is not yet reached), never all its pairs.
4. A segment value of more than ``HALF`` classes is hot. Rows of buckets that hold one are cut once more: the other segment,
   which differs by at most three bits, goes in two halves of 16 bits under their deletion variants. A bucket then fixes 46 bits and
   holds at most 2**18 classes, 2 MB, whatever the table.
5. Components of the links stay on the cluster; a component's id is its smallest doc_id.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, joined by one space; fewer than three words are one shingle.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; repeated rows and
repeated ids are each returned; a null doc_id is nobody's smallest (a component of such rows alone has a null id); an empty
table gives no rows; further columns are ignored; a text is hashed in pieces, so a very long one takes no more memory.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, fits_broadcast, maybe_broadcast
from . import blocks as B
from .components import connected

SIZE, SEED, NEAR = 3, 42, 3
HALF = 4096  # classes of one segment value beyond which its buckets are cut again; steers the plan, never the result
PIECE = 1 << 20  # bytes of a text that are hashed at a time
FEW = 8  # members of a bucket up to which all its pairs are compared at once
U = np.uint64
_LOWER = bytes(B.LOWER)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about ``PIECE`` bytes at a time; a piece begins with the last two words of the one before."""
    kept: list[bytes] = []
    a = 0
    while a < len(text):
        cut = _SPACE.search(text, a + PIECE) if a + PIECE < len(text) else None
        b = cut.end() if cut else len(text)
        words = kept + text[a:b].translate(_LOWER).split()
        if b < len(text) and len(words) < SIZE:
            kept = words
        else:
            yield words
            kept = words[1 - SIZE :]
        a = b


def shingle_hashes(text: bytes) -> Iterator[bytes]:
    """Eight big-endian bytes for every shingle, about ``PIECE`` bytes of text at a time."""
    digest, some = xxhash.xxh64_digest, False
    for words in _pieces(text):
        if len(words) >= SIZE:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            yield b"".join([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - SIZE].tolist(), ends[SIZE - 1 :].tolist())])
            some = True
        elif words and not some:
            yield digest(b" ".join(words), SEED)


def fingerprint(text: bytes) -> int:
    """The fingerprint as an unsigned number; no words: zero."""
    ones, n = np.zeros(64, np.int64), 0
    for piece in shingle_hashes(text):
        for a in range(0, len(piece), 1 << 17):
            bits = np.frombuffer(piece[a : a + (1 << 17)], np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
            n += len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row's whole text, as a signed number of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for a, b, data, at in B.text_blocks(batch.column(1)):
                prints += [fingerprint(data[at[r] : at[r + 1]].tobytes()) for r in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return B.small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def spanning(members: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links between the given distinct fingerprints that join exactly those that are linked, one fewer than a part has members."""
    left, u, v = members, [], []
    while len(left):
        ready, left = [left[:1]], left[1:]
        while ready and len(left):
            at = ready.pop()
            if len(at) > 1:
                ready.append(at[1:])
            near = np.bitwise_count(left ^ at[0]) <= NEAR
            if near.any():
                ready.append(left[near])
                u.append(np.full(len(ready[-1]), at[0]))
                v.append(ready[-1])
                left = left[~near]
    return u, v


def _bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in whole buckets: rows sorted by (key, fp). Bits 32 to 37 of a key are the segment and its deleted bit."""
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(key)]]))
    variant = key[:, 0].view(np.uint64) >> U(32)
    segment, deleted = variant >> U(5), variant & U(31)
    half = np.where(segment == 0, fp >> U(32), fp & U(0xFFFFFFFF))
    us, vs = [], []
    few = np.repeat((size > 1) & (size <= FEW), size)
    bucket = np.repeat(np.arange(len(first)), size)
    for d in range(1, FEW):
        i = np.flatnonzero(few[:-d] & (bucket[:-d] == bucket[d:])) if len(fp) > d else np.zeros(0, np.int64)
        differ = half[i] ^ half[i + d]
        met = (np.bitwise_count(fp[i] ^ fp[i + d]) <= NEAR) & ((differ == U(1) << deleted[i]) | ((differ == 0) & (deleted[i] == 0)))
        us.append(fp[i[met]])
        vs.append(fp[i[met] + d])
    for b in np.flatnonzero(size > FEW).tolist():
        rows = slice(first[b], first[b] + size[b])
        side = (half[rows] >> deleted[first[b]]) & U(1)
        if deleted[first[b]] == 0 or side.min() != side.max():
            u, v = spanning(fp[rows])
            us += u
            vs += v
    return np.concatenate([np.zeros(0, np.uint64), *us]), np.concatenate([np.zeros(0, np.uint64), *vs])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by (key, sub, fp); the last bucket of a batch waits for the next."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def found(parts):
        u, v = _bucket_links(np.concatenate([k for k, _ in parts]), np.concatenate([f for _, f in parts]))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        fp = batch.column(2).to_numpy().view(np.uint64)
        if not len(fp):
            continue
        last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
        if last or (waiting and (waiting[0][0][0] != key[0]).any()):
            yield found([*waiting, (key[:last], fp[:last])])
            waiting = []
        waiting.append((key[last:], fp[last:]))
    if waiting:
        yield found(waiting)


def links(classes: DataFrame, half: int = HALF) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) whose components are those of all links."""
    # key: segment (1 bit), deleted bit (5), the segment without it (32)
    keyed = classes.select("fp", F.expr(
        "explode(transform(sequence(0, 63), k -> shiftleft(CAST(k AS BIGINT), 32) | "
        "(CASE WHEN k < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END & ~shiftleft(1L, k % 32))))").alias("key"))
    values = classes.select(F.expr("explode(array(struct(0 AS s, shiftrightunsigned(fp, 32) AS x), struct(32 AS s, fp & 4294967295L AS x)))").alias("e")).select("e.*")
    hot = cut_lineage(values.groupBy("s", "x").count().filter(F.col("count") > half).select(
        F.expr("explode(transform(sequence(0, 31), k -> shiftleft(CAST(s + k AS BIGINT), 32) | (x & ~shiftleft(1L, k))))").alias("key")).distinct())
    cold = keyed
    if not hot.isEmpty():
        small = fits_broadcast(hot)
        cold = keyed.join(maybe_broadcast(hot, small), "key", "left_anti")
        again = keyed.join(maybe_broadcast(hot, small), "key", "left_semi").withColumn("x", F.expr("CASE WHEN key < 137438953472L THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"))
        again = again.select("key", F.expr(
            "explode(transform(sequence(0, 31), k -> shiftleft(CAST(k + 1 AS BIGINT), 16) | "
            "(CASE WHEN k < 16 THEN shiftrightunsigned(x, 16) ELSE x & 65535L END & ~shiftleft(1L, k % 16))))").alias("sub"), "fp")
        cold = cold.select("key", F.lit(0).cast("long").alias("sub"), "fp").unionByName(again)
    else:
        cold = cold.select("key", F.lit(0).cast("long").alias("sub"), "fp")
    return cold.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp").mapInArrow(_verify, "u long, v long")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = cut_lineage(fingerprints(docs))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = cut_lineage(connected(links(classes.select("fp"))))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def with_hex(df: DataFrame) -> DataFrame:
    """Adds ``fingerprint``, the 16 lower-case hex digits of fp."""
    return df.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
