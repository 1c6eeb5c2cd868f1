"""Source divergence audit with a minimal acyclic transducer as vocabulary.

How far does the word use of one source differ from another's, and from its language as a whole? Terms are
``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A language keeps the terms of at least ``LEAST_DOCS`` of its documents.

1. First pass over the whole texts: in how many documents of a language a term stands. Terms are counted block by
   block, summed by Spark before and after the shuffle.
2. The kept terms are sorted by range. A task turns each stretch of ``PIECE`` terms of a language into a minimal acyclic
   transducer: equal ends of terms share their states, and the numbers on a term's path add up to its ordinal
   in the language, in UTF-8 order (``build``).
3. Second pass: every text is streamed through the transducers, which count ordinals instead of strings. They are broadcast in
   rounds of at most ``ROUND`` bytes, known before; a larger vocabulary takes more rounds over the texts, one after another.
4. Shares are fixed-point, ``p = 1 + 10**9 (count + 1) div (N + V)``; a divergence is ``(p - q)**2 div q``. For the
   sum over all kept terms only terms that both of two sources have are met term by term; those that one or none has
   enter by the counts of equal shares and by the share of a count of zero. Ties of terms go by ordinals.
5. Only terms in the result are spelled out again, by a join with the transducers' own listing.

All arithmetic is in whole numbers (decimals where 64 bits may not do). Every row counts as a document.

Defined cases: null text, lang or source count as ''; a group without terms has its rows in part ``pair`` (value 0 where a language
keeps no term); a language of one source has none there; repeated rows count each; an empty table gives no rows; further
columns are ignored; a text over a block's size is a block of its own, and a kept term takes a state for each byte it shares with none.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import blocks as B

LEAST_DOCS, TERM_RANKS = 3, 200
PIECE = 1 << 16  # terms of one transducer
ROUND = 64 << 20  # bytes of transducers that are broadcast at a time
MERGE = 1 << 19  # counts that a task holds before it sends them on
BLOCK = 2_000_000
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# The transducer: state s has the transitions with keys s * 256 + byte, sorted; the last state is the start.


def build(terms: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of distinct sorted terms; the ``adds`` along a term's path sum up to its place."""
    known: dict[tuple, int] = {}
    finals, below, keys, targets, adds = [], [], [], [], []

    def frozen(final: bool, moves: list) -> int:
        state = known.setdefault((final, tuple(moves)), len(finals))
        if state == len(finals):
            n = int(final)
            for byte, target in moves:
                keys.append(state * 256 + byte)
                targets.append(target)
                adds.append(n)
                n += below[target]
            finals.append(final)
            below.append(n)
        return state

    path: list[list] = [[False, []]]  # of the last term, not frozen yet: (is final, moves)
    last = b""
    for term in terms:
        shared = 0
        for a, b in zip(last, term):
            if a != b:
                break
            shared += 1
        while len(path) > shared + 1:
            end = path.pop()
            path[-1][1].append((last[len(path) - 1], frozen(*end)))
        path += [[False, []] for _ in range(len(term) - shared)]
        path[-1][0] = True
        last = term
    while len(path) > 1:
        end = path.pop()
        path[-1][1].append((last[len(path) - 1], frozen(*end)))
    frozen(*path[0])
    return {"finals": np.array(finals, bool), "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "adds": np.array(adds, np.int32)}


def places(fst: dict[str, np.ndarray], terms: pa.Array) -> np.ndarray:
    """The place of each term, -1 if it is not in the vocabulary; all terms go a byte further at a time."""
    buffers = terms.buffers()
    at = np.frombuffer(buffers[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    n, out = np.diff(at), np.full(len(terms), -1, np.int64)
    alive = np.arange(len(terms))
    state, place = np.full(len(terms), len(fst["finals"]) - 1, np.int64), np.zeros(len(terms), np.int64)
    k, keys = 0, fst["keys"]
    while len(alive):
        ended = n[alive] == k
        done = alive[ended]
        out[done] = np.where(fst["finals"][state[ended]], place[ended], -1)
        alive, state, place = alive[~ended], state[~ended], place[~ended]
        if not len(keys):
            break
        want = state * 256 + data[at[alive] + k]
        i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        on = keys[i] == want
        alive, i = alive[on], i[on]
        state, place = fst["targets"][i].astype(np.int64), place[on] + fst["adds"][i]
        k += 1
    return out


def listed(fst: dict[str, np.ndarray]) -> Iterator[bytes]:
    """The terms in order."""
    first = np.searchsorted(fst["keys"], np.arange(len(fst["finals"]) + 1) * 256).tolist()
    byte, target, final = (fst["keys"] % 256).tolist(), fst["targets"].tolist(), fst["finals"].tolist()
    start = len(final) - 1
    if final[start]:
        yield b""
    path, word = [(start, first[start])], bytearray()
    while path:
        state, move = path.pop()
        if move < first[state + 1]:
            path.append((state, move + 1))
            word.append(byte[move])
            if final[target[move]]:
                yield bytes(word)
            path.append((target[move], first[target[move]]))
        elif word:
            word.pop()


# Passes over the texts.


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, which of them each occurrence is, its row) of a block."""
    inside = IS_LETTER[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    cut = edges[(edges > 0) & (edges < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(begins)
    at = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - start)]).astype(np.int64)
    all_terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(B.LOWER[data[inside]])])
    coded = all_terms.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def _coded(batch: pa.RecordBatch, names: list[str]) -> tuple[pa.Table, np.ndarray]:
    """Distinct values of the columns and which of them each row has."""
    code = np.zeros(batch.num_rows, np.int64)
    for name in names:
        code = code * (batch.num_rows + 1) + batch.column(name).dictionary_encode().indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    return pa.Table.from_batches([batch]).select(names).take(pa.array(first)), code


def _filled(docs: DataFrame) -> DataFrame:
    return B.small_batches(docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))))


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs) of ``_filled`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang = _coded(batch, ["lang"])
            for a, b, data, at in B.text_blocks(batch.column("text"), BLOCK):
                terms, code, row = _terms(data, at)
                if len(code):
                    each = np.unique(row * len(terms) + code)
                    pairs, n = np.unique(lang[a + each // len(terms)] * len(terms) + each % len(terms), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [langs.column("lang").take(pa.array(pairs // len(terms))).combine_chunks().cast(pa.string()), terms.take(pa.array(pairs % len(terms))).cast(pa.large_string()).cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "term", "n"]
                    )

    return docs.select("text", "lang").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("docs"))


PARTS = ("finals", "keys", "targets", "adds")


def transducers(kept: DataFrame, piece: int = PIECE) -> DataFrame:
    """Kept (lang, term) as transducers of a stretch each: (lang, first term, n_terms, size, parts binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = None, []

        def done():
            fst = build([t.encode() for t in held])
            parts = [fst[p].tobytes() for p in PARTS]
            return pa.RecordBatch.from_pylist([{"lang": lang, "first": held[0], "n_terms": len(held), "size": sum(map(len, parts)), **dict(zip(PARTS, parts))}], schema=arrow)

        for batch in batches:
            for name, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (name != lang or len(held) == piece):
                    yield done()
                    held = []
                lang = name
                held.append(term)
        if held:
            yield done()

    arrow = pa.schema([("lang", pa.string()), ("first", pa.string()), ("n_terms", pa.int64()), ("size", pa.int64()), *((p, pa.binary()) for p in PARTS)])
    schema = "lang string, first string, n_terms long, size long, " + ", ".join(f"{p} binary" for p in PARTS)
    cut = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, schema)
    return cut


def _loaded(row) -> dict[str, np.ndarray]:
    return {p: np.frombuffer(row[p], kind) for p, kind in zip(PARTS, (bool, np.int64, np.int32, np.int32))}


def with_bases(pieces: DataFrame) -> DataFrame:
    """Adds ``base``, the number of the language's terms before a piece. Heavy parts are left out of the window."""
    before = W.partitionBy("lang").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    return pieces.select("lang", "first", "n_terms", "size").withColumn("base", F.coalesce(F.sum("n_terms").over(before), F.lit(0)))


def ordinal_counts(docs: DataFrame, pieces: DataFrame, limit: int = ROUND) -> DataFrame:
    """(grp, ord, n): occurrences of each kept term in each group, by streaming all texts through the pieces."""
    listing = sorted(with_bases(pieces).collect(), key=lambda r: (r["lang"], r["base"]))  # a short row for each ``PIECE`` terms
    rounds: list[list] = []
    size = limit + 1
    for r in listing:
        if size + r["size"] > limit:
            rounds.append([])
            size = 0
        rounds[-1].append(r)
        size += r["size"]
    spark, out = docs.sparkSession, None
    for chosen in rounds:
        bases = {(r["lang"], r["first"]): r["base"] for r in chosen}
        lo, hi = (chosen[0]["lang"], chosen[0]["first"]), (chosen[-1]["lang"], chosen[-1]["first"])
        mine = pieces.filter(F.struct("lang", "first").between(F.struct(F.lit(lo[0]), F.lit(lo[1])), F.struct(F.lit(hi[0]), F.lit(hi[1]))))
        held: dict[str, list] = {}
        for r in sorted(mine.collect(), key=lambda r: bases[r["lang"], r["first"]]):
            held.setdefault(r["lang"], []).append((r["first"].encode(), bases[r["lang"], r["first"]], _loaded(r)))
        sent = spark.sparkContext.broadcast(held)
        part = cut_lineage(_streamed(docs, sent).groupBy("grp", "ord").agg(F.sum("n").alias("n")))
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "grp string, ord long, n long")


def _ordinals(pieces: list, terms: pa.Array) -> np.ndarray:
    if len(pieces) == 1:
        found = places(pieces[0][2], terms)
        return np.where(found >= 0, found + pieces[0][1], -1)
    firsts = [p[0] for p in pieces]
    which = np.array([bisect_right(firsts, t) - 1 for t in terms.to_pylist()], np.int64)
    out = np.full(len(terms), -1, np.int64)
    for k in np.unique(which[which >= 0]).tolist():
        i = np.flatnonzero(which == k)
        found = places(pieces[k][2], terms.take(pa.array(i)))
        out[i] = np.where(found >= 0, found + pieces[k][1], -1)
    return out


def _group() -> Column:
    """One string for a language and a source, which stands for no other pair."""
    return F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), F.col("source"))


def _streamed(docs: DataFrame, sent) -> DataFrame:
    """Counts of a task's blocks are summed in it until there are ``MERGE`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        known: dict[str, int] = {}  # the task's groups
        held, n_held = [], 0

        def summed():
            g, ord_, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.lexsort((ord_, g))
            g, ord_, n = g[order], ord_[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (ord_[1:] != ord_[:-1])]))
            return g[first], ord_[first], np.add.reduceat(n, first)

        def sent_on(g, ord_, n):
            names = pa.array(list(known), pa.string())
            return pa.RecordBatch.from_arrays([names.take(pa.array(g)), pa.array(ord_), pa.array(n)], names=["grp", "ord", "n"])

        for batch in batches:
            pairs, group = _coded(batch, ["lang", "grp"])
            langs = np.array(pairs.column("lang").to_pylist(), object)
            ids = np.array([known.setdefault(x, len(known)) for x in pairs.column("grp").to_pylist()], np.int64)
            for a, b, data, at in B.text_blocks(batch.column("text"), BLOCK):
                terms, code, row = _terms(data, at)
                if not len(code):
                    continue
                both, n = np.unique(group[a + row] * len(terms) + code, return_counts=True)
                g, code = both // len(terms), both % len(terms)
                ord_ = np.full(len(both), -1, np.int64)
                for lang in set(langs[g].tolist()) & vocabulary.keys():
                    here = np.flatnonzero(langs[g] == lang)
                    asked, back = np.unique(code[here], return_inverse=True)
                    ord_[here] = _ordinals(vocabulary[lang], terms.take(pa.array(asked)))[back]
                kept = np.flatnonzero(ord_ >= 0)
                held.append((ids[g[kept]], ord_[kept], n[kept].astype(np.int64)))
                n_held += len(kept)
            if n_held > 2 * MERGE:
                held = [summed()]
                n_held = len(held[0][0])
                if n_held > MERGE:
                    yield sent_on(*held[0])
                    held, n_held = [], 0
                    known = {}
        if n_held:
            yield sent_on(*summed())

    return docs.select("text", "lang", _group().alias("grp")).mapInArrow(run, "grp string, ord long, n long")


def spelled(pieces: DataFrame) -> DataFrame:
    """(lang, ord, term): the transducers' own listing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                terms = pa.array([t.decode() for t in listed(_loaded(r))], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(terms), pa.string()), pa.array(r["base"] + np.arange(len(terms))), terms], names=["lang", "ord", "term"])

    based = pieces.join(with_bases(pieces).select("lang", "first", "base"), ["lang", "first"])
    return based.select("lang", "base", *PARTS).mapInArrow(run, "lang string, ord long, term string")


# Shares and divergences.


def _share(count: str) -> Column:
    return F.expr(f"1 + CAST((CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST(total + v AS DECIMAL(20,0)) AS BIGINT)")


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS, piece: int = PIECE, limit: int = ROUND) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs`` (text, lang, source)."""
    docs = _filled(docs)
    kept = document_counts(docs).filter(F.col("docs") >= least_docs)
    pieces = cut_lineage(transducers(kept, piece))
    counts = cut_lineage(ordinal_counts(docs, pieces, limit))

    sizes = pieces.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("seen"))
    groups = docs.select("lang", "source").distinct().withColumn("grp", _group()).join(totals, "grp", "left").join(sizes, "lang", "left").na.fill(0, ["total", "seen", "v"])
    groups = cut_lineage(groups.withColumn("z", F.when(F.col("v") > 0, _share("0L"))))  # z: the share of a count of zero

    shares = counts.join(groups, "grp").withColumn("p", _share("n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    overall = shares.groupBy("lang", "ord").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "ord", _share("n").alias("q"))
    over = shares.join(overall, ["lang", "ord"]).filter("p > q").select("lang", "source", "ord", F.expr(_apart("p", "q")).alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    top = over.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= term_ranks)
    terms = top.join(spelled(pieces), ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    a = shares.select("lang", "ord", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    b = shares.select("lang", "ord", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    met = a.join(b, ["lang", "ord"]).filter("a < b").select(
        "lang", "a", "b",
        F.expr(f"{_apart('pa', 'pb')} - {_apart('pa', 'zb')} - {_apart('za', 'pb')} + {_apart('za', 'zb')}").alias("there"),
        F.expr(f"{_apart('pb', 'pa')} - {_apart('pb', 'za')} - {_apart('zb', 'pa')} + {_apart('zb', 'za')}").alias("back"),
    )
    # sums of the high and the low halves stay within 64 bits for 2**31 terms and are put together as decimals
    halves = [f(c).alias(f"{c}_{k}") for c in ("there", "back") for k, f in (("high", lambda c: F.sum(F.shiftright(c, 32))), ("low", lambda c: F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))))]
    total = lambda c: F.expr(f"CAST({c}_high AS DECIMAL(20,0)) * CAST(4294967296 AS DECIMAL(10,0)) + {c}_low")
    both_ways = met.groupBy("lang", "a", "b").agg(*halves).select("lang", F.explode(F.array(
        F.struct(F.col("a"), F.col("b"), total("there").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), total("back").alias("value")))).alias("e"))
    in_both = both_ways.select("lang", "e.a", "e.b", "e.value")
    ga = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), F.col("seen").alias("na"), "v")
    gb = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.col("seen").alias("nb"))
    pairs = ga.join(gb, "lang").filter("a <> b")  # the pairs that are asked for
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    in_a = alike.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).select("lang", "a", "b", F.expr(f"CAST(k AS DECIMAL(20,0)) * ({_apart('p', 'zb')})").alias("value"))
    in_b = alike.withColumnRenamed("source", "b").join(pairs, ["lang", "b"]).select("lang", "a", "b", F.expr(f"CAST(k AS DECIMAL(20,0)) * ({_apart('za', 'p')})").alias("value"))
    in_none = pairs.select("lang", "a", "b", F.expr(f"IF(v > 0, CAST(v - na - nb AS DECIMAL(20,0)) * ({_apart('za', 'zb')}), 0)").alias("value"))
    parts = [d.withColumn("value", F.col("value").cast("decimal(38,0)")) for d in (in_both, in_a, in_b, in_none)]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    order = W.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    ranked = summed.withColumn("rank", F.row_number().over(order)).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", "rank")
    return ranked.unionByName(terms)
