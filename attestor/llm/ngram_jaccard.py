"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Two texts link when their sets of word shingles have a Jaccard similarity of ``num / den`` or more (0.8).

1. One pass over the texts gives every set a node id, its size and a bitmap signature (a bit per slot, flipped by
   every shingle hashed there; two to four slots for each shingle, so a bitmap's width follows from its size
   band, and the wider of two is folded onto the other). Equal sets are one node from here on. The pass also notes which shingles are
   frequent; the list is cut at ``HINTS`` entries and only steers an order, never a result.
2. Two similar sets of n and m >= n shingles share one of the first ``n - ceil(0.8 n) + 1`` of each in any common
   order. With frequent shingles last, a shared passage or line brings nobody together; what is shared by
   real copies does. A shingle with the nodes that have it up front is a *tile*.
3. Stars: in each tile, the node with the fewest rare shingles meets all others whose size fits. Pairs whose bit
   counts already rule them out go: the slots in which two bitmaps differ are at most the shingles in which
   the sets differ, so ``overlap <= (n + m - differing bits) / 2``. The rest is intersected exactly.
4. Tiles whose other nodes are not all connected by then are cut into units by size band and, when large, by hash, and
   every unit compares the bitmaps of its pairs that are not connected yet. What the bound lets through is
   intersected exactly. So no link that could join two components is missed, and pairs inside a component,
   whose number may grow with the square of a group, are never formed.
5. Components of the exact links.

Shingles are known by 63 bits and nodes by 64: among 10**8 different sets the chance that any two share a node id
is 3 in 10**4.

Defined cases: a null or wordless text has no shingles, links with nothing and is its own component; fewer words
than a shingle are one shingle; repeated rows come back as often as they came; a null ``doc_id`` takes part in
linking but is never a component id unless alone; an empty table gives an empty result; further columns are
ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import blocks as B
from .components import connected

SHINGLE = 5
NUM, DEN = 4, 5  # similarity as a fraction
LEAST_BITS = 64
HINTS = 500_000  # most frequent shingles that the order knows; bounds what is broadcast
HINT_LEAST = 6
UNIT = 512  # nodes of one size band in a unit
FLUSH = 4_000_000
BLOOM_BITS = 23


def jaccard_components(docs: DataFrame, num: int = NUM, den: int = DEN, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) for every row of ``docs`` (doc_id, text)."""
    rows, known = _components(docs, num, den, size)
    out = rows.join(known, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "node")


def deduplicated(docs: DataFrame, num: int = NUM, den: int = DEN, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id stays.

    Of repeated rows of that document one stays, and so do all documents without words.
    """
    _, known = _components(docs, num, den, size)
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("m")
    keep = known.groupBy("root").agg(first).select(F.col("m.node").alias("__node"), F.col("m.first_id").alias("__first"))
    schema = docs.withColumns({"__node": F.lit(0).cast("long"), "__words": F.lit(True)}).schema

    def marked(batches):
        for batch in batches:
            for a, b, h, at in _set_blocks(batch.column("text"), size):
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns, pa.array(_node_ids(h, at).view(np.int64)), pa.array(np.diff(at) > 0)], names=schema.names)

    stays = ~F.col("__words") | F.col("__first").eqNullSafe(F.col("doc_id").cast("long")) & F.col("__kept")
    rows = docs.mapInArrow(marked, schema).join(keep.withColumn("__kept", F.lit(True)), "__node", "left").filter(stays)
    # wordless rows are never repeats of each other
    rows = rows.withColumn("__one", F.when(F.col("__words"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates(["__node", "doc_id", "__one"]).select(*[f"`{c}`" for c in docs.columns])


def _components(docs: DataFrame, num: int, den: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of every row, and (node, first_id, root, component_id) of every node with words."""
    docs = B.small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sets = cut_lineage(docs.mapInArrow(_sets_pass(size), "doc_id long, node long, n long, bits binary, shingle long, cnt long"))
    rows = sets.filter("shingle IS NULL").select("doc_id", "node", "n")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    parts = cut_lineage(connected(jaccard_links(docs, sets, num, den, size)))
    smallest = parts.join(nodes, "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = nodes.join(parts.join(smallest, "root"), "node", "left")
    return rows, joined.select("node", "first_id", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))


def jaccard_links(docs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN, size: int = SHINGLE) -> DataFrame:
    """(u, v) node pairs with an exact similarity of ``num / den`` or more; enough of them to connect all that link."""
    spark = docs.sparkSession
    hints = (
        sets.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= HINT_LEAST)
        .orderBy(F.desc("cnt"), "shingle").limit(HINTS).select("shingle").toArrow()
    )
    order = spark.sparkContext.broadcast(hints.column("shingle").to_numpy().astype(np.uint64)[::-1].copy())
    front = docs.select("text").mapInArrow(_front_pass(order, num, den, size), "tile long, rare float, node long, n long, place int")
    by_tile = front.repartition("tile").sortWithinPartitions("tile", "rare", "n", "node")
    tiles = cut_lineage(by_tile.mapInArrow(_tile_pass, "tile long, pivot long, pivot_n long, node long, n long, place long"))

    about = sets.filter("shingle IS NULL AND n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    about = cut_lineage(about.join(tiles.select("node").distinct(), "node", "left_semi"))

    star = tiles.filter(_sizes_fit(F.col("pivot_n"), F.col("n"), num, den) & (F.col("pivot") != F.col("node")))
    star = star.select(F.least("pivot", "node").alias("u"), F.greatest("pivot", "node").alias("v")).distinct()
    a = about.select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("bits").alias("ub"))
    b = about.select(F.col("node").alias("v"), F.col("n").alias("vn"), F.col("bits").alias("vb"))
    star = star.join(a, "u").join(b, "v").mapInArrow(_bound_pass(num, den), "u long, v long")
    first = cut_lineage(_verified(docs, star, num, den, size))

    labels = cut_lineage(connected(first))
    rest = tiles.filter("pivot <> node").select("tile", "node", "n", "place").join(labels, "node", "left").select("tile", "node", "n", "place", F.coalesce("root", "node").alias("label"))
    mixed = rest.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("cnt")).filter("lo <> hi")
    units = _units(rest.join(mixed.select("tile", "cnt"), "tile"), num, den)
    open_ = units.groupBy("unit").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    units = units.join(open_.select("unit"), "unit", "left_semi").repartition("unit").sortWithinPartitions("unit", "side", "node")
    units = units.mapInArrow(_unit_pass(num, den, False), units.schema).join(about.select("node", "bits"), "node")
    units = units.repartition("unit").sortWithinPartitions("unit", "side", "node")
    pairs = units.mapInArrow(_unit_pass(num, den, True), "u long, v long").distinct()
    second = _verified(docs, pairs, num, den, size)
    return first.unionByName(second)


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


# --------------------------------------------------------------------------- passes over the texts


def _node_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    count = np.diff(at).astype(np.uint64)
    return B.mix(B.per_row(np.add, B.mix(h), at, B.U(0)) + count * B.PLACE[14])


def _set_blocks(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingles, row offsets) of the blocks of a text column."""
    for a, b, data, offsets in B.text_blocks(column):
        h, row = B.shingles(B.words(data, offsets, B.IS_TEXT), b - a, size)
        yield a, b, *B.distinct_sorted(h, row, b - a)


def _bitmaps(h: np.ndarray, at: np.ndarray) -> pa.Array:
    n = np.diff(at)
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(2 * n, LEAST_BITS))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(width)])
    slot = np.repeat(first[:-1], n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(slot, minlength=first[-1]) & 1).astype(bool))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((first // 8).astype(np.int32)), pa.py_buffer(packed)])


def _sets_pass(size: int):
    """Per row its node, size and bitmap; besides, shingles that are repeated within a task, with their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("shingle", pa.int64()), ("cnt", pa.int64())])

    def frequent(parts: list[np.ndarray]) -> pa.RecordBatch:
        value, cnt = np.unique(np.concatenate(parts), return_counts=True)
        keep = cnt >= 2
        k = int(keep.sum())
        return pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), value[keep].view(np.int64), cnt[keep]], schema=schema)

    def run(batches):
        seen, held = [], 0
        for batch in batches:
            for a, b, h, at in _set_blocks(batch.column("text"), size):
                rows = b - a
                bits = _bitmaps(h, at)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, rows), _node_ids(h, at).view(np.int64), np.diff(at), bits, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                    schema=schema,
                )
                seen.append(h)
                held += len(h)
                if held >= FLUSH:
                    yield frequent(seen)
                    seen, held = [], 0
        if seen:
            yield frequent(seen)

    return run


def _front_pass(order, num: int, den: int, size: int):
    """A row (shingle, share of rare shingles, node, size) for each shingle up front, once per node and task."""

    def run(batches):
        known = order.value
        by_value = np.argsort(known)
        sorted_known = known[by_value]
        done: set[int] = set()
        for batch in batches:
            for a, b, h, at in _set_blocks(batch.column("text"), size):
                rows = b - a
                node = _node_ids(h, at)
                fresh = np.zeros(rows, bool)
                for r in np.flatnonzero(np.diff(at)).tolist():
                    x = int(node[r])
                    if x not in done:
                        done.add(x)
                        fresh[r] = True
                row = np.repeat(np.arange(rows), np.diff(at))
                keep = fresh[row]
                h, row = h[keep], row[keep]
                if len(sorted_known):
                    place = np.minimum(np.searchsorted(sorted_known, h), len(sorted_known) - 1)
                    hot = sorted_known[place] == h
                    h = np.where(hot, B.U(2**63) + by_value[place].astype(np.uint64), h)
                h, at2 = B.distinct_sorted(h, row, rows)
                n = np.diff(at2)
                rare = B.per_row(np.add, (h < B.U(2**63)).astype(np.int64), at2, 0) / np.maximum(n, 1)
                take = n - (num * n + den - 1) // den + 1
                take[n == 0] = 0
                row = np.repeat(np.arange(rows), n)
                front = (np.arange(len(h)) - at2[row]) < take[row]
                place = (np.arange(len(h)) - at2[row])[front].astype(np.int32)
                row = row[front]
                yield pa.record_batch(
                    [h[front].view(np.int64), rare[row].astype(np.float32), node[row].view(np.int64), n[row], place],
                    names=["tile", "rare", "node", "n", "place"],
                )

    return run


def _tile_pass(batches):
    """Rows sorted by tile; those of tiles with two nodes or more, each with its tile's first node."""
    held = None  # the open tile so far: tile, pivot, pivot_n, last node, whether the pivot was given out
    names = ["tile", "pivot", "pivot_n", "node", "n", "place"]
    for batch in batches:
        tile, node, n, place = (batch.column(c).to_numpy() for c in ("tile", "node", "n", "place"))
        if not len(tile):
            continue
        new = np.ones(len(tile), bool)
        new[1:] = tile[1:] != tile[:-1]
        same = np.zeros(len(tile), bool)  # the node again, from another task
        same[1:] = ~new[1:] & (node[1:] == node[:-1])
        lead = []
        if held is not None and held[0] == tile[0]:
            new[0] = False
            same[0] = node[0] == held[3]
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        pivot = np.where(group >= 0, node[at[np.maximum(group, 0)]] if len(at) else 0, held[1] if held else 0)
        pivot_n = np.where(group >= 0, n[at[np.maximum(group, 0)]] if len(at) else 0, held[2] if held else 0)
        member = ~new & ~same & (node != pivot)
        given = held is not None and held[4]
        if held is not None and not given and (member & (group < 0)).any():
            lead.append((held[0], held[1], held[2], held[1], held[2], held[5]))
            given = True
        many = np.bincount(group[member & (group >= 0)], minlength=len(at)) > 0 if len(at) else np.zeros(0, bool)
        starts = at[many]
        keep = member.copy()
        keep[starts] = True
        out = [tile[keep], pivot[keep], pivot_n[keep], node[keep], n[keep], place[keep]]
        if lead:
            out = [np.concatenate([[x], y]) for x, y in zip(lead[0], out)]
        if len(out[0]):
            yield pa.record_batch([x.astype(np.int64) for x in out], names=names)
        held = (tile[-1], pivot[-1], pivot_n[-1], node[-1], bool(many[-1]) if len(at) else given, place[at[-1]] if len(at) else held[5])


def _texts_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, text), one text per node of ``wanted``: a bit table of fixed size keeps other texts out of the shuffle."""
    slot = F.shiftrightunsigned("node", 64 - BLOOM_BITS)
    words = wanted.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - BLOOM_BITS}) & 63 AS int))")).alias("b")).toArrow()
    table = np.zeros(2 ** (BLOOM_BITS - 6), np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    bloom = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            column = batch.column("text")
            for a, b, h, at in _set_blocks(column, size):
                node = _node_ids(h, at)
                slot = node >> B.U(64 - BLOOM_BITS)
                maybe = ((bloom.value[slot >> B.U(6)] >> (slot & B.U(63))) & B.U(1)).astype(bool) & (np.diff(at) > 0)
                at_rows = []
                for r in np.flatnonzero(maybe).tolist():
                    x = int(node[r])
                    if x not in seen:
                        seen.add(x)
                        at_rows.append(r)
                if at_rows:
                    yield pa.record_batch([node[at_rows].view(np.int64), column.slice(a, b - a).take(pa.array(at_rows)).cast(pa.string())], names=["node", "text"])

    found = docs.select("text").mapInArrow(run, "node long, text string")
    return cut_lineage(found.groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node", "left_semi"))


# --------------------------------------------------------------------------- bounds and exact test


def _bound(n: np.ndarray, m: np.ndarray, differing: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an overlap that reaches the similarity is possible: num/den of the union, the union being n + m - overlap."""
    return ((n + m - differing) // 2) * (num + den) >= num * (n + m)


def _folded(items: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` bytes; a wider one is halved by laying one half over the other."""
    out = np.empty((len(items), width // 8), np.uint64)
    for k, x in enumerate(items):
        v = np.frombuffer(x, np.uint64)
        while len(v) > width // 8:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[k] = v
    return out


def _bound_pass(num: int, den: int):
    def run(batches):
        for batch in batches:
            ub, vb = batch.column("ub").to_pylist(), batch.column("vb").to_pylist()
            width = np.array([min(len(x), len(y)) for x, y in zip(ub, vb)], np.int64)
            differing = np.zeros(len(width), np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                for part in np.array_split(at, -(-len(at) * w // 4_000_000)):
                    x, y = (_folded([side[k] for k in part], w) for side in (ub, vb))
                    differing[part] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            keep = _bound(batch.column("un").to_numpy(), batch.column("vn").to_numpy(), differing, num, den)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """The pairs whose sets, made again from the texts, reach the similarity."""
    pairs = cut_lineage(pairs)
    texts = _texts_of(docs, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), size)
    a, b = texts.select(F.col("node").alias("u"), F.col("text").alias("ut")), texts.select(F.col("node").alias("v"), F.col("text").alias("vt"))

    def run(batches):
        for batch in batches:
            left, right = batch.column("ut"), batch.column("vt")
            step = 256
            for s in range(0, batch.num_rows, step):
                us, vs = (_sets_list(c.slice(s, step), size) for c in (left, right))
                keep = []
                for k, (x, y) in enumerate(zip(us, vs)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * den >= num * (len(x) + len(y) - both):
                        keep.append(s + k)
                if keep:
                    yield batch.select(["u", "v"]).take(pa.array(keep))

    return pairs.join(a, "u").join(b, "v").mapInArrow(run, "u long, v long")


def _sets_list(column: pa.Array, size: int) -> list[np.ndarray]:
    out = []
    for _, _, h, at in _set_blocks(column, size):
        out += np.split(h, at[1:-1])
    return out


# --------------------------------------------------------------------------- size-banded units


def _units(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Each row of a mixed tile under every unit in which it meets others: its own size band and the next one.

    Bands grow by ``den / num``, so two sizes that fit are in one band or in neighbouring ones. A tile with many
    rows is salted: a unit has about ``UNIT`` nodes from either side, and two rows that may link meet in one unit.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    salts = F.ceil(F.col("cnt") / UNIT).cast("int")
    rows = rows.withColumn("band", band).withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    within = other.select("tile", "node", "n", "place", "label", F.col("band").alias("b"), F.least("salt", "other").alias("s1"), F.greatest("salt", "other").alias("s2"), F.lit(0).alias("kind"), F.when(F.col("salt") <= F.col("other"), 0).otherwise(1).alias("side"))
    lower = other.select("tile", "node", "n", "place", "label", F.col("band").alias("b"), F.col("salt").alias("s1"), F.col("other").alias("s2"), F.lit(1).alias("kind"), F.lit(0).alias("side"))
    upper = other.select("tile", "node", "n", "place", "label", (F.col("band") - 1).alias("b"), F.col("other").alias("s1"), F.col("salt").alias("s2"), F.lit(1).alias("kind"), F.lit(1).alias("side"))
    unit = F.xxhash64("tile", "b", "kind", "s1", "s2").alias("unit")
    own = ((F.col("kind") == 0) & (F.col("s1") == F.col("s2"))).cast("int").alias("own")
    return within.unionByName(lower).unionByName(upper).select(unit, "side", own, "node", "n", "place", "label")


def _unit_pass(num: int, den: int, with_bits: bool):
    """Rows sorted by unit. Without bitmaps: the rows that have a partner; with them: the pairs (u, v) that may link.

    Partners have different labels and fitting sizes, and their places leave room for the overlap: when the
    unit's shingle is the first that two sets share, at most the shingles from there on can be shared. When it is
    not, the tile of the first one brings the two together.
    """

    def partners(n, place, label, side, own):
        left = np.arange(len(n)) if own else np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        step = max(1, 65_536 // max(1, len(right)))
        for s in range(0, len(left), step):
            i, j = left[s : s + step, None], right[None, :]
            room = np.minimum(n[i] - place[i], n[j] - place[j]) * (num + den) >= num * (n[i] + n[j])
            x, y = np.nonzero(room & (label[i] != label[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & ((i < j) | (not own)))
            yield left[s + x], right[y]

    def run(batches):
        rest = None
        for batch in batches:
            table = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not table.num_rows:
                continue
            unit = table.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))
            yield from units(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield from units(rest)

    def units(table):
        if not table.num_rows:
            return
        unit, side, own, node, n, place, label = (table.column(c).to_numpy() for c in ("unit", "side", "own", "node", "n", "place", "label"))
        bits = table.column("bits").to_pylist() if with_bits else None
        has = np.zeros(len(unit), bool)
        edge = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
        us, vs = [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a < 2:
                continue
            maps = _folded(bits[a:b], min(map(len, bits[a:b]))) if with_bits else None
            for x, y in partners(n[a:b], place[a:b], label[a:b], side[a:b], bool(own[a])):
                if not with_bits:
                    has[a + x] = has[a + y] = True
                    continue
                few = max(1, 4_000_000 // (8 * maps.shape[1]))  # pairs at a time
                for k in range(0, len(x), few):
                    p, q = a + x[k : k + few], a + y[k : k + few]
                    ok = _bound(n[p], n[q], np.bitwise_count(maps[p - a] ^ maps[q - a]).sum(1, dtype=np.int64), num, den)
                    us.append(node[p[ok]])
                    vs.append(node[q[ok]])
        if not with_bits:
            yield table.filter(pa.array(has))
        elif us:
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.record_batch([np.minimum(u, v), np.maximum(u, v)], names=["u", "v"])

    return run
