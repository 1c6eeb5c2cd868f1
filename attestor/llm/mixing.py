"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks of ``block_docs``. With share w = weight / sum of weights, block i (from 1) of
a source is released at slot floor((i - 1) / w) and due by slot ceil(i / w); at each slot the released block with the
earliest deadline goes next (ties: heavier source, then name). So after any number t of slots each source has had
more than t w - 1 and fewer than t w + 1 blocks.

Weights are whole numbers, so releases and deadlines repeat after one *period* of as many slots as the weights add
up to: the schedule of one period, made on the driver from the weights alone, places every block by arithmetic.
When a source has no block left its share goes to the others in proportion, from that slot on: a new *phase* with a
period of its own. There are at most as many phases as sources. Nothing is dropped or repeated.

Ranks of documents within a source come from counts by (source, bucket of ids) and their running sums, so a
source with a third of all rows is dealt over many tasks. The driver sees weights and counts by source only. The
tables of phases and patterns hold only what is used, at most a row for each block, and are broadcast while small,
else shuffled: any number of sources works. The driver's time grows with the square of their number.

Defined cases: a null source counts as the empty name; a source without a weight, or with one below 1, is mixed
after all others are used up, with weight 1; the last block of a source may be short; repeated rows are ranked one
after another; an empty table gives an empty result. ``position`` leaves gaps after short blocks; it is an order, not a row number.
"""
from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_CHARS, BROADCAST_ROWS, cut_lineage, maybe_broadcast

BLOCK_DOCS = 16
BUCKET_ROWS = 20_000
PARTS, STEPS = 64, 100_000_000
STRETCH = 64  # blocks of a source that look for their phase under one key


def period_slots(weights: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block number from 1, release, deadline) slot by slot, for one period."""
    period = sum(weights.values())
    window = lambda s, i: ((i - 1) * period // weights[s], -(-i * period // weights[s]))
    ready = [(-(-period // w), -w, s, 1) for s, w in weights.items()]
    heapq.heapify(ready)
    waiting: list = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, i)[1], -weights[s], s, i))
        deadline, _, s, i = heapq.heappop(ready)
        yield s, i, window(s, i)[0], deadline
        if i < weights[s]:
            heapq.heappush(waiting, (window(s, i + 1)[0], s, i + 1))


def one_period(weights: dict[str, int]) -> list[tuple[str, int, int, int]]:
    return list(period_slots(weights))


def phases(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[int, int, list, dict[str, tuple[int, int, int]]]]:
    """(first slot, slots of a period, used slots of one period, placed) of each phase; ``blocks``: how many each source has.

    ``placed`` has (first block, block after the last, weight) of the sources that have blocks in the phase.
    """
    done, slot = dict.fromkeys(blocks, 0), 0
    rest = {s: n for s, n in blocks.items() if n}
    while rest:
        active = {s: weights[s] for s in rest if weights.get(s, 0) >= 1} or dict.fromkeys(rest, 1)
        size, pattern, slots_of, length = sum(active.values()), [], {}, 0
        for t, x in enumerate(period_slots(active)):
            pattern.append(x)
            slots_of.setdefault(x[0], []).append(t)
            if len(slots_of[x[0]]) == rest[x[0]]:  # a source ends inside the first period
                length = t + 1
                break
        if not length:  # the slot after a source's last block, for the source that ends first
            length = min((rest[s] - 1) // w * size + slots_of[s][(rest[s] - 1) % w] + 1 for s, w in active.items())
        whole, part = divmod(length, size)
        placed = {}
        for s, at in slots_of.items():
            n = whole * active[s] + bisect_left(at, part) if whole else len(at)
            placed[s] = (done[s], done[s] + n, active[s])
            done[s] += n
            rest[s] -= n
            if not rest[s]:
                del rest[s]
        yield slot, size, pattern, placed
        slot += length


def root_weights(counts: dict[str, int]) -> dict[str, int]:
    """Target weights in proportion to the square root of the sources' sizes, in whole parts.

    There are ``PARTS`` parts for a source on average, so a weight is off by at most half of one; a source whose root is
    under a ``PARTS``-th of the mean gets one part, more than its share. Beyond a thousand sources or so the parts are fewer,
    as the driver steps through a period for each source that ends (``STEPS`` in all).
    """
    roots = {s: Fraction(n**0.5) for s, n in counts.items() if n}
    whole, n = sum(roots.values()), max(1, len(roots))
    total = max(1_000, min(PARTS * n, STEPS // n))
    return {s: max(1, round(total * r / whole)) for s, r in roots.items()}


def ranked(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``docs`` with ``source_key`` and ``source_rank`` (from 0, in an order mixed by hash), and the rows per source."""
    key = F.coalesce("source", F.lit("")).alias("source_key")
    mixed = F.xxhash64("doc_id", F.lit(11))
    n = docs.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    bucket = F.shiftrightunsigned(mixed, 33).cast("double") / F.lit(2.0**31) * buckets  # buckets are stretches of the hash order
    dealt = docs.withColumns({"source_key": key, "mixed": F.shiftrightunsigned(mixed, 1)}).withColumn("bucket", F.least(F.floor(bucket), F.lit(buckets - 1)).cast("int"))
    sizes = cut_lineage(dealt.groupBy("source_key", "bucket").agg(F.count("*").alias("n")))
    per_source = {r[0]: r[1] for r in sizes.groupBy("source_key").agg(F.sum("n")).collect()}
    before = F.sum("n").over(W.partitionBy("source_key").orderBy("bucket")) - F.col("n")
    offsets = sizes.select("source_key", "bucket", before.alias("before"))
    place = F.row_number().over(W.partitionBy("source_key", "bucket").orderBy("mixed", "doc_id")) - 1
    out = dealt.withColumn("place", place).join(offsets, ["source_key", "bucket"]).withColumn("source_rank", F.col("before") + F.col("place"))
    return out.select(*docs.columns, "source_key", "source_rank"), per_source


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` (doc_id, source, ...) with block, slot, phase, release, deadline and position (a total order from 0).

    ``slot`` is the place of the document's block in the mix; ``release`` and ``deadline`` are the block's own, counted
    from the first slot of the mix. Columns of these names are replaced.
    """
    added = ("block", "slot", "phase", "release", "deadline", "position", "source_key", "source_rank", "stretch")
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in added])
    rows, per_source = ranked(docs)
    blocks = {s: -(-n // block_docs) for s, n in per_source.items()}
    weights = root_weights(per_source) if weights is None else weights
    table, spans = [], []
    for k, (first, size, period, placed) in enumerate(phases(blocks, weights)):
        table += [(k, s, i - 1, t, release, deadline) for t, (s, i, release, deadline) in enumerate(period)]
        spans += [(s, k, lo, hi, w, first, size) for s, (lo, hi, w) in placed.items()]
    spark = docs.sparkSession
    # the blocks of each source in each phase and the pattern of each phase's period: both follow from weights and counts
    span = spark.createDataFrame(spans, "source_key string, phase int, lo long, hi long, weight long, first_slot long, period long")
    pattern = spark.createDataFrame(table, "phase int, source_key string, nth long, at long, rel long, due long")
    stretch = lambda c: F.floor(c / STRETCH).cast("long")
    span = span.withColumn("stretch", F.explode(F.sequence(stretch(F.col("lo")), stretch(F.col("hi") - 1))))
    keys = len(spans) + sum(blocks.values()) // STRETCH
    small = lambda n: n <= BROADCAST_ROWS and n * max(map(len, blocks), default=0) <= BROADCAST_CHARS
    rows = rows.withColumn("block", F.floor(F.col("source_rank") / block_docs)).withColumn("stretch", stretch(F.col("block")))
    at = rows.join(maybe_broadcast(span, small(keys)), ["source_key", "stretch"]).filter((F.col("block") >= F.col("lo")) & (F.col("block") < F.col("hi")))
    at = at.withColumn("nth", (F.col("block") - F.col("lo")) % F.col("weight")).withColumn("turn", F.floor((F.col("block") - F.col("lo")) / F.col("weight")))
    at = at.join(maybe_broadcast(pattern, small(len(table))), ["phase", "source_key", "nth"])
    base = F.col("first_slot") + F.col("turn") * F.col("period")
    return at.withColumns(
        {"slot": base + F.col("at"), "release": base + F.col("rel"), "deadline": base + F.col("due")}
    ).withColumn("position", F.col("slot") * block_docs + F.col("source_rank") % block_docs).select(
        *[f"`{c}`" for c in docs.columns], "block", "phase", "slot", "release", "deadline", "position"
    )
