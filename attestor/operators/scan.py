"""Verbatim scans: shared n-grams -> runs of equal words -> left-to-right choice of quotations.

The heavy step is one equi-join of document grams with corpus grams. A gram that is frequent in the corpus is
never paired with all its places. What lies next to a rarer gram is recovered along that gram's diagonal. Runs
made of frequent grams only lie inside stretches of such grams: of equal stretches the earliest stays
(``first_stretches``), which makes most of their grams rare again; what is frequent even then is found by length
(``frequent_runs``), each length matched to one place. No place is dropped on the way.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage, fits_broadcast, maybe_broadcast
from . import grams as G

GRAM = 4
HOT = 256  # corpus places per gram above which pairs are not formed directly
RECORD_HOT = 32  # the same among records, of which every document can hold many
KEYS = ["h", "h2"]
FILTER_WORDS = 1 << 20  # rows of the gram filter at most, so at most 16 MB of it are broadcast
FILTER_BITS = 12  # bits for every different corpus gram while the filter is not full
FILTER_SETS = 4  # bits that a gram sets in its word


# --------------------------------------------------------------------------- seeds and runs


def gram_pairs(doc_grams: DataFrame, src_grams: DataFrame, cap: int, small: bool, has_frequent: bool | None = None) -> DataFrame:
    """(doc_id, src, i, p): equal grams on a diagonal; grams with more than ``cap`` places only beside rarer ones.

    ``src_grams``: (src, p, h, h2). ``small``: the corpus side is proven to fit a broadcast.
    """
    counts = src_grams.groupBy(*KEYS).agg(F.count("*").alias("cnt"))
    if has_frequent is None:
        has_frequent = not counts.filter(F.col("cnt") > cap).isEmpty()
    if not has_frequent:
        return doc_grams.join(maybe_broadcast(src_grams, small), KEYS).select("doc_id", "src", "i", "p", F.lit(True).alias("seed"))
    rare = src_grams.join(counts.filter(F.col("cnt") <= cap), KEYS).select("src", "p", *KEYS)
    pairs = doc_grams.join(maybe_broadcast(rare, small), KEYS).select("doc_id", "src", "i", "p", *KEYS)
    frequent = counts.filter(F.col("cnt") > cap)
    return _with_frequent_neighbours(pairs, doc_grams, src_grams, frequent, small)


def _with_frequent_neighbours(pairs, doc_grams, src_grams, frequent, small) -> DataFrame:
    """Adds the frequent grams that continue a rare seed's diagonal, stretch by stretch inside one document."""
    hot = doc_grams.join(maybe_broadcast(frequent.select(*KEYS), small), KEYS, "left_semi")
    w = W.partitionBy("doc_id").orderBy("i")
    stretches = (
        hot.select("doc_id", "i", (F.col("i") - F.row_number().over(w)).alias("g"))
        .groupBy("doc_id", "g")
        .agg(F.min("i").alias("a"), F.max("i").alias("b"))
    )
    seeds = pairs.select("doc_id", "src", "i", (F.col("p") - F.col("i")).alias("diag"))
    after = seeds.withColumn("edge", F.col("i") + 1).join(stretches.withColumn("edge", F.col("a")), ["doc_id", "edge"])
    ahead = seeds.withColumn("edge", F.col("i") - 1).join(stretches.withColumn("edge", F.col("b")), ["doc_id", "edge"])
    wanted = (
        after.unionByName(ahead)
        .select("doc_id", "src", "diag", F.explode(F.sequence("a", "b")).alias("i"))
        .distinct()
        .withColumn("p", F.col("i") + F.col("diag"))
    )
    equal = wanted.join(hot, ["doc_id", "i"]).join(src_grams, ["src", "p", *KEYS])
    rare = pairs.select("doc_id", "src", "i", "p", F.lit(True).alias("seed"))
    return rare.unionByName(equal.select("doc_id", "src", "i", "p", F.lit(False).alias("seed")))


def equal_runs(pairs: DataFrame) -> DataFrame:
    """Maximal runs of equal words per diagonal: every pair with its run's first and last word.

    Gaps and islands: along a diagonal, ``i - row_number`` is constant inside a run.
    """
    d = ["doc_id", "src", "diag"]
    tagged = pairs.withColumn("diag", F.col("p") - F.col("i"))
    tagged = tagged.withColumn("isle", F.col("i") - F.row_number().over(W.partitionBy(*d).orderBy("i")))
    w = W.partitionBy(*d, "isle")
    return tagged.select(
        "doc_id", "src", "i", "p", "seed", F.min("i").over(w).alias("run_start"), (F.max("i").over(w) + GRAM).alias("run_end")
    )


def runs_only(pairs: DataFrame) -> DataFrame:
    """(doc_id, src, start_w, end_w, src_start): one row per maximal run that holds a seed."""
    return (
        equal_runs(pairs)
        .groupBy("doc_id", "src", "run_start", "run_end", (F.col("p") - F.col("i")).alias("diag"))
        .agg(F.max("seed").alias("seed"))
        .filter("seed")
        .select("doc_id", "src", F.col("run_start").alias("start_w"), F.col("run_end").alias("end_w"), (F.col("run_start") + F.col("diag")).alias("src_start"))
    )


def first_stretches(src: DataFrame, cap: int) -> DataFrame:
    """The grams of ``src`` with more than ``cap`` places, kept only where their stretch stands for the first time.

    A stretch is a maximal row of neighbouring places whose grams are all frequent. Every run made of frequent
    grams lies inside one, and its earliest place inside the earliest of the stretches that read alike.
    """
    frequent = src.groupBy(*KEYS).agg(F.count("*").alias("cnt")).filter(F.col("cnt") > cap).select(*KEYS)
    hot = src.join(frequent, KEYS, "left_semi")
    at = hot.join(_stretch_stops(hot.select(F.col("p").alias("pos"))).withColumnRenamed("pos", "p"), "p")
    # a stretch is told by its grams in order: partial sums of hashes bound to their offset from the stretch's end
    place = F.col("stop") - F.col("p")
    tag = lambda salt: F.sum(F.xxhash64(F.lit(salt), place, *KEYS).cast("decimal(38,0)"))
    texts = at.groupBy("stop").agg(F.min("p").alias("a"), tag(1).alias("t1"), tag(2).alias("t2"))
    first = texts.groupBy((F.col("stop") - F.col("a")).alias("n"), "t1", "t2").agg(F.min("stop").alias("stop"))
    return at.join(first.select("stop"), "stop", "left_semi").select("p", *KEYS)


def frequent_runs(words: DataFrame, stream: DataFrame, again: "Frequent") -> DataFrame:
    """(doc_id, start_w, end_w, diag): longest run at every position made of frequent grams only, at its earliest place.

    Every length inside a frequent stretch of the stream is one key with one place, however often the wording
    occurs. A document position looks lengths up in two steps, coarse and then fine (what matches at a length
    matches at every shorter one), so it joins twice the square root of the longest stretch. The words of a stretch
    are one row, and so are those of a document: no row is sent that carries the words behind each of its places.
    """
    hot = again.places.select(F.col("p").alias("pos"), *KEYS)
    hot = cut_lineage(hot.join(_stretch_stops(hot.select("pos")), "pos"))
    longest = int(hot.agg(F.coalesce(F.max(F.col("stop") - F.col("pos")), F.lit(0))).first()[0]) + GRAM - 1
    cover = hot.select("stop", F.explode(F.sequence(F.col("pos"), F.col("pos") + GRAM - 1)).alias("pos")).distinct()
    texts = cover.join(stream.select("pos", "word"), "pos").groupBy("stop").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("x"))
    texts = texts.select("stop", F.col("x")[0]["pos"].alias("a"), F.col("x.word").alias("words"))
    ats = _not_periodic(hot).groupBy("stop").agg(F.collect_list(F.struct("pos", (F.col("stop") - F.col("pos")).cast("int").alias("room"))).alias("at"))
    rows = texts.join(ats, "stop").select("a", "words", F.transform("at", lambda x: F.struct((x["pos"] - F.col("a")).cast("int").alias("i"), F.lit(GRAM).alias("least"), (x["room"] + (GRAM - 1)).alias("most"))).alias("at"))
    places = cut_lineage(_lengths(rows, "a", first=True).groupBy("len", *KEYS).agg(F.min(F.col("a") + F.col("i")).alias("p")))
    at = cut_lineage(_frequent_ahead(again, longest))
    step = max(1, math.isqrt(longest))
    coarse = _lengths(_asked_lengths(words, at.withColumn("base", F.lit(GRAM))), "doc_id", step).join(places, ["len", *KEYS]).groupBy("doc_id", "i").agg(F.max("len").alias("base"))
    based = cut_lineage(at.join(coarse, ["doc_id", "i"]).select("doc_id", "i", F.least("n", F.col("base") + step - 1).cast("int").alias("n"), "base"))
    fine = _lengths(_asked_lengths(words, based), "doc_id").join(places, ["len", *KEYS])
    best = fine.groupBy("doc_id", "i").agg(F.max_by(F.struct("len", "p"), "len").alias("m"))
    return best.select("doc_id", F.col("i").alias("start_w"), (F.col("i") + F.col("m.len")).alias("end_w"), (F.col("m.p") - F.col("i")).alias("diag"))


def _not_periodic(hot: DataFrame) -> DataFrame:
    """Leaves out places from which a stretch only repeats itself at one distance: all that follows stands earlier too."""
    back = F.col("pos") - F.lag("pos").over(W.partitionBy("stop", *KEYS).orderBy("pos"))
    rest = W.partitionBy("stop").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    back = hot.withColumn("back", F.coalesce(back, F.lit(0)))
    ends = back.withColumn("least", F.min("back").over(rest)).withColumn("most", F.max("back").over(rest))
    return ends.filter((F.col("least") == 0) | (F.col("least") != F.col("most"))).select("pos", "stop")


def _frequent_ahead(again: "Frequent", longest: int) -> DataFrame:
    """(doc_id, i, n): the number of words from every frequent gram of a document to the end of its stretch."""
    at = again.asked.select("doc_id", "i").withColumn("g", F.col("i") - F.row_number().over(W.partitionBy("doc_id").orderBy("i")))
    room = F.max("i").over(W.partitionBy("doc_id", "g")) - F.col("i") + GRAM
    return at.select("doc_id", "i", F.least(F.lit(longest), room).alias("n"))


def _asked_lengths(words: DataFrame, at: DataFrame) -> DataFrame:
    """(doc_id, words, at) for ``_lengths``: a document's places (doc_id, i, base, n) come to its words."""
    ids = at.select("doc_id").distinct()
    words = words.join(maybe_broadcast(ids, fits_broadcast(ids)), "doc_id", "left_semi")
    per = at.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("base").cast("int").alias("least"), F.col("n").cast("int").alias("most"))).alias("at"))
    return words.join(per, "doc_id").select("doc_id", "words", "at")


def _lengths(rows: DataFrame, key: str, step: int = 1, first: bool = False) -> DataFrame:
    """(key, i, len, h, h2): hashes of the words ``words[i:i + len]``, for every ``step``-th length of each place.

    ``rows``: (key, words, at), where ``at`` has structs (i, least, most) of a place and its lengths. With ``first`` a wording comes
    once for a row, at its first place. The hash of a stretch is the difference of two sums of its row, so it costs
    the same at every length.
    """

    def hashed(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                sums = _Sums(batch.column("w")[r].values.to_numpy(zero_copy_only=False))
                i, least, most = (batch.column("at")[r].values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("i", "least", "most"))
                for at, n in _by_length(i, least, most) if first else _by_place(i, least, most, step):
                    h, h2 = sums.of(at, n)
                    if first:
                        keep = np.sort(np.unique(h ^ (h2 << 32), return_index=True)[1]) if len(at) > 1 else slice(None)
                        at, n, h, h2 = at[keep], n[keep], h[keep], h2[keep]
                    whose = batch.column(0).take(pa.array(np.full(len(at), r)))
                    yield pa.RecordBatch.from_arrays([whose, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h), pa.array(h2.astype(np.int32))], [key, "i", "len", *KEYS])

    sent = rows.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("w"), "at")
    return sent.mapInArrow(hashed, f"{key} {dict(rows.dtypes)[key]}, i int, len int, h long, h2 int")


PRIMES = (2147483647, 2147483629, 2147483587)  # of three sums, 93 bits together
BASE = 1_000_003


class _Sums:
    """Running sums of a row of words, each word weighed by a power of the base for its place."""

    def __init__(self, words: np.ndarray):
        plain, n = words.astype(np.int64).view(np.uint64), len(words)
        self.parts = []
        for k, p in enumerate(PRIMES):
            values = ((plain >> np.uint64(k)) % np.uint64(p)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(values * _powers(BASE, n, p) % p)]) % p
            self.parts.append((p, total, _powers(pow(BASE, -1, p), n + 1, p)))

    def of(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = at + n
        a, b, c = ((total[to] - total[at]) % p * back[at] % p for p, total, back in self.parts)
        return a << 31 | b, c


def _powers(base: int, n: int, p: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out[:n]


def _by_length(i: np.ndarray, least: np.ndarray, most: np.ndarray):
    """(places, length) by length, the places in their order."""
    order = np.argsort(i, kind="stable")
    i, least, most = i[order], least[order], most[order]
    for n in range(int(least.min()), int(most.max()) + 1):
        at = i[(least <= n) & (n <= most)]
        if len(at):
            yield at, np.full(len(at), n)


def _by_place(i: np.ndarray, least: np.ndarray, most: np.ndarray, step: int, rows: int = 1 << 18):
    """(places, lengths) in parts of some ``rows`` rows."""
    counts = np.maximum((most - least) // step + 1, 0)
    part = np.cumsum(counts) // rows
    for k in np.unique(part):
        own = part == k
        c = counts[own]
        if c.sum():
            yield np.repeat(i[own], c), np.repeat(least[own], c) + step * (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c))


def _stretch_stops(hot: DataFrame) -> DataFrame:
    """(pos, stop): the first position after ``pos`` that is not in ``hot``.

    Block-wise windows; only one row per block (the first break in it) crosses blocks.
    """
    last = hot.join(hot.select((F.col("pos") - 1).alias("pos")), "pos", "left_anti").withColumn("stop", F.col("pos") + 1)
    marked = hot.join(last, "pos", "left").withColumn("blk", F.floor(F.col("pos") / G.BLOCK))
    first_stop = last.groupBy(F.floor(F.col("pos") / G.BLOCK).alias("blk")).agg(F.min("stop").alias("first_stop"))
    blocks = marked.select("blk").distinct().join(first_stop, "blk", "left")
    later = blocks.select("blk", F.min("first_stop").over(W.orderBy("blk").rowsBetween(1, W.unboundedFollowing)).alias("later_stop"))
    near = F.min("stop").over(W.partitionBy("blk").orderBy("pos").rowsBetween(0, W.unboundedFollowing))
    return marked.withColumn("near_stop", near).join(later, "blk").select("pos", F.coalesce("near_stop", "later_stop").alias("stop"))


# --------------------------------------------------------------------------- filter before the exchange


def _mask(h2: Column) -> Column:
    """The bits a gram sets in its 64-bit word: ``FILTER_SETS`` fields of six bits of the second hash."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h2, 6 * k).bitwiseAND(F.lit(63))) for k in range(FILTER_SETS)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def filter_words(n_grams: int) -> int:
    """64-bit words of a filter for ``n_grams`` different grams; 0 where the largest one would be nearly full."""
    wanted = math.ceil(n_grams * FILTER_BITS / 64)
    return 0 if wanted > 4 * FILTER_WORDS else max(1, min(wanted, FILTER_WORDS))


def gram_filter(src_grams: DataFrame, words: int) -> DataFrame:
    """(word, bits): blocked Bloom filter of the grams, a row per 64-bit word that has a bit.

    Its rows are bit-wise sums, so they are formed map-side before the exchange, and filters of parts of a corpus
    with the same number of words are merged by ``merge_filters``.
    """
    return src_grams.groupBy(F.pmod("h", F.lit(words)).alias("word")).agg(F.bit_or(_mask(F.col("h2"))).alias("bits"))


def merge_filters(*parts: DataFrame) -> DataFrame:
    """The filter of all grams of its parts."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def admitted(doc_grams: DataFrame, filt: DataFrame, words: int) -> DataFrame:
    """Document grams that may stand in the corpus: every gram that does, and few others.

    ``filt`` has at most ``FILTER_WORDS`` rows, so it is broadcast and the grams are dropped where they were made.
    """
    mask = _mask(F.col("h2"))
    has_all = F.col("bits").bitwiseAND(mask) == mask
    return doc_grams.join(F.broadcast(filt), (F.pmod("h", F.lit(words)) == F.col("word")) & has_all, "left_semi")


# --------------------------------------------------------------------------- left-to-right choice


def choose_left_to_right(cands: DataFrame) -> DataFrame:
    """(doc_id, start_w, end_w, p): leftmost start wins, its longest run is taken, the next search begins after it.

    ``cands``: at most one row (doc_id, i, len, p) per word position, so a document's list is no longer than
    the document; the choice itself is a fold over that list.
    """
    acc = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<i:int,len:int,p:bigint>>").alias("picks"))
    row = F.struct(F.col("i").cast("int").alias("i"), F.col("len").cast("int").alias("len"), F.col("p").cast("bigint").alias("p"))
    picks = F.aggregate(
        F.array_sort(F.collect_list(row)),
        acc,
        lambda a, x: F.when(
            x["i"] >= a["cursor"], F.struct((x["i"] + x["len"]).alias("cursor"), F.concat(a["picks"], F.array(x)).alias("picks"))
        ).otherwise(a),
    )
    chosen = cands.groupBy("doc_id").agg(picks["picks"].alias("picks"))
    return chosen.select("doc_id", F.explode("picks").alias("r")).select(
        "doc_id", F.col("r.i").alias("start_w"), (F.col("r.i") + F.col("r.len")).alias("end_w"), F.col("r.p").alias("p")
    )


def choose_among_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, start_w, end_w, p): the choice of ``choose_left_to_right``, made among runs (doc_id, start_w, end_w, diag).

    Runs go by in the order of their starts. All that cover the place where the search stands compete for it, and
    whatever covers it ends no later than the one that is taken.
    """
    pick = "struct<i:int,b:int,diag:bigint>"
    row = F.struct(F.col("start_w").cast("int").alias("a"), F.col("end_w").cast("int").alias("b"), F.col("diag").cast("bigint").alias("diag"))
    none = F.lit(None).cast(pick)
    acc = F.struct(F.lit(0).alias("cursor"), none.alias("best"), F.array().cast(f"array<{pick}>").alias("picks"))

    def step(s: Column, x: Column) -> Column:
        done = s["best"].isNotNull() & (x["a"] > s["best"]["i"])
        settled = F.struct(F.when(done, s["best"]["b"]).otherwise(s["cursor"]).alias("cursor"), F.when(done, none).otherwise(s["best"]).alias("best"), F.when(done, F.concat(s["picks"], F.array(s["best"]))).otherwise(s["picks"]).alias("picks"))
        return X.let(settled, lambda t: _competed(t, x))

    def _competed(t: Column, x: Column) -> Column:
        i = F.greatest(x["a"], t["cursor"])
        new, b = F.struct(i.alias("i"), x["b"].alias("b"), x["diag"].alias("diag")), t["best"]
        wins = (x["b"] - GRAM >= i) & (b.isNull() | (x["b"] > b["b"]) | ((x["b"] == b["b"]) & (x["diag"] < b["diag"])))
        return F.struct(t["cursor"].alias("cursor"), F.when(F.coalesce(wins, F.lit(False)), new).otherwise(b).alias("best"), t["picks"].alias("picks"))

    picks = F.aggregate(F.array_sort(F.collect_list(row)), acc, step, lambda s: F.when(s["best"].isNotNull(), F.concat(s["picks"], F.array(s["best"]))).otherwise(s["picks"]))
    chosen = runs.groupBy("doc_id").agg(picks.alias("picks"))
    return chosen.select("doc_id", F.explode("picks").alias("r")).select("doc_id", F.col("r.i").alias("start_w"), F.col("r.b").alias("end_w"), (F.col("r.i") + F.col("r.diag")).alias("p"))


# --------------------------------------------------------------------------- canon scan

MIN_WEIGHT = 12.0
UNKNOWN_IDF = 6.0


def longest_at(words: DataFrame, tokens: DataFrame, small: bool, cap: int = HOT) -> DataFrame:
    """(doc_id, i, len, p): the longest run of four words or more at every document position that has one."""
    src = G.hashed(G.stream_grams(tokens, GRAM)).select(F.lit(0).cast("bigint").alias("src"), F.col("pos").alias("p"), *KEYS)
    return longest_runs(words, src, tokens, small, cap)


def longest_runs(words: DataFrame, src: DataFrame, stream: DataFrame, small: bool, cap: int = HOT) -> DataFrame:
    """(doc_id, i, len, p): longest run at every document position, at its earliest place.

    ``src``: (src, p, h, h2), the grams of ``stream`` that count; a run goes on while the next place has one.
    """
    at = covering_runs(words, src, stream, small, cap).select("doc_id", "end_w", "diag", F.explode(F.sequence(F.col("start_w"), F.col("end_w") - GRAM)).alias("i"))
    best = at.groupBy("doc_id", "i").agg(F.max(F.struct((F.col("end_w") - F.col("i")).alias("len"), (-F.col("diag") - F.col("i")).alias("np"))).alias("m"))
    return best.select("doc_id", "i", "m.len", (-F.col("m.np")).alias("p"))


def covering_runs(words: DataFrame, src: DataFrame, stream: DataFrame, small: bool, cap: int = HOT) -> DataFrame:
    """(doc_id, start_w, end_w, diag): runs of words that stand in the stream ``diag`` words further on.

    At every document position that has a run, the longest one at its earliest place is among those that cover it; a
    run covers the positions up to its last gram. ``src`` as in ``longest_runs``.
    """

    src = cut_lineage(src.select("p", *KEYS))
    keys = frequent_keys(src, cap)
    frequent = not keys.isEmpty()
    if frequent:  # both sides are read several times below
        words, stream = cut_lineage(words), cut_lineage(stream)
    doc_grams = G.explode_grams(words, GRAM)
    n_words = 0 if small else filter_words(src.agg(F.approx_count_distinct("h")).first()[0])
    if n_words:  # the corpus grams are not broadcast: the document grams would all be shuffled
        doc_grams = admitted(doc_grams, cut_lineage(gram_filter(src, n_words)), n_words)
    if not frequent:
        return diagonal_runs(doc_grams.join(maybe_broadcast(src, small), KEYS))
    hot = Frequent.of(keys, src, doc_grams, small)
    runs = _seeded_runs(doc_grams, src, hot, small)
    once = cut_lineage(first_stretches(hot.places, cap))
    keys = frequent_keys(once, cap)
    if keys.isEmpty():
        return runs.unionByName(diagonal_runs(hot.asked.join(maybe_broadcast(once, small), KEYS)))
    again = Frequent.of(keys, once, hot.asked, small)
    return runs.unionByName(_seeded_runs(hot.asked, once, again, small)).unionByName(frequent_runs(words, stream, again))


def frequent_keys(src: DataFrame, cap: int) -> DataFrame:
    """(h, h2), stored: the grams with more than ``cap`` places."""
    return cut_lineage(src.groupBy(*KEYS).agg(F.count("*").alias("cnt")).filter(F.col("cnt") > cap).select(*KEYS))


def diagonal_runs(pairs: DataFrame) -> DataFrame:
    """(doc_id, start_w, end_w, diag): the maximal runs of equal grams (doc_id, i, p), a row each."""
    w = W.partitionBy("doc_id", "diag").orderBy("i")
    tagged = pairs.select("doc_id", (F.col("p") - F.col("i")).alias("diag"), "i").withColumn("isle", F.col("i") - F.row_number().over(w)).withColumn("gap", F.col("i") - F.lag("i").over(w) > 1)
    # a document that comes twice has each of its grams twice: its isles are told apart on both sides of a gap
    tagged = tagged.withColumn("part", F.count(F.when(F.col("gap"), 1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return tagged.groupBy("doc_id", "diag", "part", "isle").agg(F.min("i").alias("start_w"), (F.max("i") + GRAM).alias("end_w")).select("doc_id", "start_w", "end_w", "diag")


@dataclass
class Frequent:
    """The grams with more places than a plan pairs, stored: ``keys``, their ``places`` (p, h, h2) in the corpus and where documents have them, ``asked`` (doc_id, i, h, h2)."""

    keys: DataFrame
    places: DataFrame
    asked: DataFrame
    few: bool

    @classmethod
    def of(cls, keys: DataFrame, src: DataFrame, doc_grams: DataFrame, small: bool) -> "Frequent":
        few = small or fits_broadcast(keys)
        semi = lambda df: cut_lineage(df.join(maybe_broadcast(keys, few), KEYS, "left_semi"))
        return cls(keys, semi(src.select("p", *KEYS)), semi(doc_grams), few)

    def without(self, grams: DataFrame) -> DataFrame:
        return grams.join(maybe_broadcast(self.keys, self.few), KEYS, "left_anti")


def _seeded_runs(doc_grams: DataFrame, src: DataFrame, hot: Frequent, small: bool) -> DataFrame:
    """Runs that hold a rarer gram, with the frequent grams that continue it on both sides.

    Only a run's ends can touch a stretch of frequent grams, so runs, not their grams, are held against the stretches.
    """
    rare = hot.without(src.select("p", *KEYS))
    seeds = cut_lineage(diagonal_runs(hot.without(doc_grams).join(maybe_broadcast(rare, small), KEYS)))
    w = W.partitionBy("doc_id").orderBy("i")
    stretches = hot.asked.select("doc_id", "i", (F.col("i") - F.row_number().over(w)).alias("g")).groupBy("doc_id", "g").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    after = seeds.select("doc_id", "diag", (F.col("end_w") - GRAM + 1).alias("edge")).join(stretches.withColumn("edge", F.col("a")), ["doc_id", "edge"])
    ahead = seeds.select("doc_id", "diag", (F.col("start_w") - 1).alias("edge")).join(stretches.withColumn("edge", F.col("b")), ["doc_id", "edge"])
    wanted = after.unionByName(ahead).select("doc_id", "diag", F.explode(F.sequence("a", "b")).alias("i")).distinct().withColumn("p", F.col("i") + F.col("diag"))
    equal = diagonal_runs(wanted.join(hot.asked, ["doc_id", "i"]).join(hot.places, ["p", *KEYS]))
    # rare and frequent stretches of a diagonal follow each other: the next begins at the gram after the last
    d = W.partitionBy("doc_id", "diag").orderBy("start_w", "end_w")
    goes_on = F.coalesce(F.col("start_w") == F.lag("end_w").over(d) - GRAM + 1, F.lit(False))
    part = seeds.unionByName(equal).withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("part", F.sum("new").over(d))
    return part.groupBy("doc_id", "diag", "part").agg(F.min("start_w").alias("start_w"), F.max("end_w").alias("end_w")).select("doc_id", "start_w", "end_w", "diag")


def gram_weights(tokens: DataFrame, idf: DataFrame) -> DataFrame:
    """(pos, weight): summed idf of the four words that start at each stream position."""
    weighed = tokens.join(idf.select("word", "idf"), "word", "left").select("pos", F.coalesce("idf", F.lit(UNKNOWN_IDF)).alias("word"))
    return G.stream_grams(weighed, GRAM).select("pos", F.aggregate("words", F.lit(0.0), lambda a, x: a + x).alias("weight"))


def distinctive(cands: DataFrame, tokens: DataFrame, idf: DataFrame, small: bool, min_words: int = 4) -> DataFrame:
    """Runs of five words stand by themselves; a run of four needs a summed idf of ``MIN_WEIGHT``."""
    cands = cands.filter(F.col("len") >= min_words)
    if min_words > 4:
        return cands
    weights = gram_weights(tokens, idf).filter(F.col("weight") >= MIN_WEIGHT).select(F.col("pos").alias("p"), "weight")
    return cands.join(maybe_broadcast(weights, small), "p", "left").filter((F.col("len") >= 5) | F.col("weight").isNotNull()).select("doc_id", "i", "len", "p")


def canon_scan(
    words: DataFrame, match_tokens: DataFrame, idf: DataFrame, small: bool, display_tokens: DataFrame | None = None, min_words: int = 4, cap: int = HOT
) -> DataFrame:
    """Verbatim canon passages in documents: (doc_id, start_w, end_w, p, spelling).

    The display spelling is tried only at positions whose first three words start nothing in the match spelling.
    """
    first = distinctive(longest_at(words, match_tokens, small, cap), match_tokens, idf, small, min_words)
    if display_tokens is None:
        return choose_left_to_right(first).withColumn("spelling", F.lit("match"))
    second = longest_at(words, display_tokens, small, cap)
    seeded = G.hashed(G.stream_grams(match_tokens, 3)).select(*KEYS).distinct()
    taken = G.explode_grams(words, 3).join(maybe_broadcast(seeded, small), KEYS, "left_semi").select("doc_id", "i")
    second = distinctive(second.join(taken, ["doc_id", "i"], "left_anti"), display_tokens, idf, small, min_words)
    # the two spellings are told apart after the choice by the sign of the place
    both = first.unionByName(second.select("doc_id", "i", "len", (-F.col("p") - 1).alias("p")))
    return choose_left_to_right(both).select(
        "doc_id", "start_w", "end_w",
        F.when(F.col("p") < 0, -F.col("p") - 1).otherwise(F.col("p")).alias("p"),
        F.when(F.col("p") < 0, "display").otherwise("match").alias("spelling"),
    )


# --------------------------------------------------------------------------- graded-corpus scan


def record_runs(words: DataFrame, record_words: DataFrame, small: bool, cap: int = RECORD_HOT) -> DataFrame:
    """Left-to-right choice of record runs: (doc_id, start_w, end_w, src, src_start, src_end).

    ``record_words``: (src BIGINT, words). The records lie one after the other in a stream, in the order of
    ``src``; grams never cross their borders, so neither do runs. ``cap`` steers the plan, never the result. Of records
    with the same words only the first is laid: what stands in a later one stands there earlier.
    """
    laid = record_words.filter((F.size("words") >= GRAM) & F.col("src").isNotNull())
    first = laid.groupBy(F.xxhash64("words").alias("t1"), F.sha2(F.array_join("words", "\x1f"), 256).alias("t2")).agg(F.min(F.struct("src", "words")).alias("r"))
    placed = cut_lineage(G.record_positions(cut_lineage(first.select("r.*"))))
    grams = G.explode_grams(placed, GRAM, "pos0").select(F.lit(0).cast("bigint").alias("src"), (F.col("pos0") + F.col("i")).alias("p"), *KEYS)
    tokens = placed.select("pos0", F.posexplode("words").alias("k", "word")).select((F.col("pos0") + F.col("k")).alias("pos"), "word")
    picks = choose_among_runs(covering_runs(words, grams, tokens, small, cap)).withColumn("blk", F.floor(F.col("p") / G.BLOCK))
    spans = placed.select("src", "pos0", (F.col("pos0") + F.size("words")).alias("pos1")).filter("pos1 > pos0")
    spans = spans.withColumn("blk", F.explode(F.sequence(F.floor(F.col("pos0") / G.BLOCK), F.floor((F.col("pos1") - 1) / G.BLOCK))))
    at = picks.join(spans, "blk").filter((F.col("p") >= F.col("pos0")) & (F.col("p") < F.col("pos1")))
    first = F.col("p") - F.col("pos0")
    return at.select("doc_id", "start_w", "end_w", "src", first.alias("src_start"), (first + F.col("end_w") - F.col("start_w")).alias("src_end"))


def merge_neighbours(runs: DataFrame, max_gap: int = 6) -> DataFrame:
    """Joins successive runs of one record when the gap is small and the record goes on."""
    w = W.partitionBy("doc_id").orderBy("start_w")
    goes_on = (
        (F.lag("src").over(w) == F.col("src"))
        & (F.col("start_w") - F.lag("end_w").over(w) <= max_gap)
        & (F.col("src_start") >= F.lag("src_end").over(w) - 2)
    )
    part = runs.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    return part.groupBy("doc_id", "src", "part").agg(F.min("start_w").alias("start_w"), F.max("end_w").alias("end_w")).drop("part")


def record_scan(words: DataFrame, record_words: DataFrame, small: bool, min_words: int = 6, min_content: int = 4, cap: int = RECORD_HOT, script: str = "arabic") -> DataFrame:
    """Verbatim record passages in documents: (doc_id, src, start_w, end_w).

    A document's words meet its runs in one row, so they are not carried along with each of them.
    """
    merged = merge_neighbours(record_runs(words, record_words, small, cap)).filter(F.col("end_w") - F.col("start_w") >= min_words)
    runs = merged.groupBy("doc_id").agg(F.collect_list(F.struct("src", "start_w", "end_w")).alias("runs"))

    def enough(run: Column) -> Column:
        w = F.slice("words", run["start_w"] + 1, run["end_w"] - run["start_w"])
        return X.content_words(X.without_honorifics(w) if script == "arabic" else w) >= min_content

    return runs.join(words, "doc_id").select("doc_id", F.explode(F.filter("runs", enough)).alias("r")).select("doc_id", "r.src", "r.start_w", "r.end_w")


# --------------------------------------------------------------------------- located quotations


def with_offsets(runs: DataFrame, docs: DataFrame, script: str) -> DataFrame:
    """Adds the quoted text and its character offsets; documents without a run are not carried along."""
    at = runs.join(docs.select("doc_id", "text"), "doc_id").withColumn("at", X.word_span_offsets(F.col("text"), F.col("start_w"), F.col("end_w") - 1, script))
    return at.withColumn("start", F.col("at.start")).withColumn("end", F.col("at.end")).withColumn(
        "quote", F.substr("text", F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))
    ).drop("at", "text")


def covered_units(runs: DataFrame, units: DataFrame, positions: DataFrame, separator: str = " ۝ ") -> DataFrame:
    """First and last unit of each stream range, clamped to the first group, with the display texts joined.

    ``runs`` needs (claim_id, p, n_words). A range touches few units: the join is by position block, not a scan.
    """
    size = G.BLOCK
    spans = runs.select("claim_id", F.col("p").alias("a"), (F.col("p") + F.col("n_words")).alias("b")).withColumn(
        "blk", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size)))
    )
    places = positions.select("group_no", "unit_no", "pos0", (F.col("pos0") + F.size("words")).alias("pos1")).filter("pos1 > pos0").withColumn(
        "blk", F.explode(F.sequence(F.floor(F.col("pos0") / size), F.floor((F.col("pos1") - 1) / size)))
    )
    hit = spans.join(places, "blk").filter((F.col("pos0") < F.col("b")) & (F.col("a") < F.col("pos1")))
    touched = hit.select("claim_id", "group_no", "unit_no", "pos0").distinct().join(units.select("group_no", "unit_no", "text_display"), ["group_no", "unit_no"])
    per = touched.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos0", "group_no", "unit_no", "text_display"))).alias("u"))
    group = F.col("u")[0]["group_no"]
    kept = F.filter("u", lambda x: x["group_no"] == group)
    return per.select(
        "claim_id",
        group.alias("group_no"),
        kept[0]["unit_no"].alias("unit_start"),
        F.element_at(kept, -1)["unit_no"].alias("unit_end"),
        F.array_join(F.transform(kept, lambda x: x["text_display"]), separator).alias("source_text"),
    )


def reference_strings(covered: DataFrame, groups: DataFrame, url_base: str) -> DataFrame:
    """Reference text and link of a unit range. ``groups``: (group_no, name)."""
    span = F.when(F.col("unit_start") == F.col("unit_end"), F.col("unit_start").cast("string")).otherwise(F.concat_ws("–", "unit_start", "unit_end"))
    return covered.join(groups.select("group_no", "name"), "group_no").select(
        "*",
        F.concat(F.col("name"), F.lit(" "), F.col("group_no"), F.lit(":"), span).alias("ref"),
        F.concat(F.lit(url_base), F.lit("/"), F.col("group_no"), F.lit("/"), F.col("unit_start")).alias("url"),
    )


def unit_edges(runs: DataFrame, covered: DataFrame, edge_words: DataFrame) -> DataFrame:
    """Whether a match begins with its first unit's first word and runs to its last unit's last word (either spelling).

    ``runs``: (claim_id, first_word, last_word); ``edge_words``: (group_no, unit_no, firsts, lasts) arrays.
    """
    e = edge_words.select("group_no", "unit_no", "firsts", "lasts")
    both = runs.join(covered.select("claim_id", "group_no", "unit_start", "unit_end"), "claim_id")
    both = both.join(e.select("group_no", F.col("unit_no").alias("unit_start"), "firsts"), ["group_no", "unit_start"])
    both = both.join(e.select("group_no", F.col("unit_no").alias("unit_end"), "lasts"), ["group_no", "unit_end"])
    return both.select(
        "claim_id",
        F.array_contains("firsts", F.col("first_word")).alias("starts_at_unit_start"),
        F.array_contains("lasts", F.col("last_word")).alias("ends_at_unit_end"),
    )


def unit_edge_words(units: DataFrame, script: str) -> DataFrame:
    d, m = X.words(F.col("text_display"), script), X.words(F.col("text_match"), script)
    return units.select("group_no", "unit_no", d.alias("d"), m.alias("m")).select(
        "group_no", "unit_no",
        F.array_distinct(F.array(F.get("d", F.lit(0)), F.get("m", F.lit(0)))).alias("firsts"),
        F.array_distinct(F.array(F.try_element_at("d", F.lit(-1)), F.try_element_at("m", F.lit(-1)))).alias("lasts"),
    )
