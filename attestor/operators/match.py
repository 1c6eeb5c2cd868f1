"""One quotation against the canon: exact place, other places, fuzzy windows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..session import cut_lineage, maybe_broadcast
from . import grams as G

MIN_EXACT = 3
SEED_BUCKET, BIGRAM_RARE = 4, 10
FIRST_WINDOWS = 4  # windows of a quotation, for each place asked for, that are aligned before the others are held against their scores
STRETCH = 64  # neighbouring windows that are read together


def exact_places(claims_w: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    """(claim_id, p, n_words): every place where all words of a quotation of three words or more stand in a row.

    Equal quotations are looked up once. Head and tail trigrams find the places by two equi-joins; what is left
    is compared in full, word range by word range.
    """
    asked = claims_w.filter(F.size("q") >= MIN_EXACT).select("claim_id", F.size("q").alias("n_words"), "q")
    asked = asked.withColumn("qh", F.xxhash64("q")).withColumn("qh2", F.hash("q"))
    quotes = asked.dropDuplicates(["n_words", "qh", "qh2"])
    gram = lambda words: (F.xxhash64(words), F.hash(words))
    head, tail = gram(F.slice("q", 1, MIN_EXACT)), gram(F.slice("q", F.lit(-MIN_EXACT), F.lit(MIN_EXACT)))
    wanted = quotes.select("n_words", "qh", "qh2", head[0].alias("h"), head[1].alias("h2"), tail[0].alias("th"), tail[1].alias("th2"))
    stream3 = G.hashed(G.stream_grams(tokens, MIN_EXACT)).select(F.col("pos").alias("p"), "h", "h2")
    begins = wanted.join(maybe_broadcast(stream3, small), ["h", "h2"]).withColumn("tp", F.col("p") + F.col("n_words") - MIN_EXACT)
    ends = stream3.select(F.col("p").alias("tp"), F.col("h").alias("th"), F.col("h2").alias("th2"))
    spans = begins.join(maybe_broadcast(ends, small), ["tp", "th", "th2"]).select("n_words", "qh", "qh2", "p")
    found = spans.select("*", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n_words") - 1)).alias("pos")).join(maybe_broadcast(tokens.select("pos", "word"), small), "pos")
    texts = found.groupBy("n_words", "qh", "qh2", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("s"))
    same = texts.filter((F.xxhash64("s") == F.col("qh")) & (F.hash("s") == F.col("qh2"))).select("n_words", "qh", "qh2", "p")
    return asked.join(same, ["n_words", "qh", "qh2"]).select("claim_id", "p", "n_words")


def exact_units(claims_w: DataFrame, positions: DataFrame) -> DataFrame:
    """A quotation of one or two words counts only as a complete unit (its first occurrence)."""
    short = claims_w.filter((F.size("q") > 0) & (F.size("q") < MIN_EXACT)).select("claim_id", F.size("q").alias("n_words"), F.array_join("q", " ").alias("t"))
    whole = positions.filter((F.size("words") < MIN_EXACT) & (F.size("words") > 0)).select(F.array_join("words", " ").alias("t"), "pos0").groupBy("t").agg(F.min("pos0").alias("p"))
    return short.join(whole, "t").select("claim_id", "p", "n_words")


def first_exact(places: DataFrame) -> DataFrame:
    return places.groupBy("claim_id", "n_words").agg(F.min("p").alias("p"))


def other_places(places: DataFrame, tokens: DataFrame, limit: int = 8) -> DataFrame:
    """Distinct further units where the same words stand, at most eight: (claim_id, others)."""
    first = first_exact(places).select("claim_id", F.col("p").alias("p0"))
    rest = places.join(first, "claim_id").filter(F.col("p") != F.col("p0")).select("claim_id", "p")
    at = rest.join(tokens.select(F.col("pos").alias("p"), "group_no", "unit_no"), "p")
    units = at.groupBy("claim_id", "group_no", "unit_no").agg(F.min("p").alias("p"))
    w = W.partitionBy("claim_id").orderBy("p")
    few = units.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    return few.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rn", "group_no", "unit_no"))).alias("o")).select(
        "claim_id", F.transform("o", lambda x: F.struct(x["group_no"].alias("group_no"), x["unit_no"].alias("unit_no"))).alias("others")
    )


def seed_windows(claims_w: DataFrame, tokens: DataFrame, positions: DataFrame, small: bool) -> DataFrame:
    """(claim_id, bucket, votes, seed_rank): every window of the canon with something of the quotation, best-voted first.

    Shared word pairs vote for the place the quotation would begin, pairs of few places twice; a unit that shares a word
    votes for its own beginning. All places count: the order decides what is read first, never what is found.
    """
    stream2 = G.hashed(G.stream_grams(tokens, 2)).select(F.col("pos").alias("p"), "h", "h2")
    counted = stream2.join(stream2.groupBy("h", "h2").agg(F.count("*").alias("cnt")), ["h", "h2"])
    grams = G.explode_grams(claims_w.select("claim_id", F.col("q").alias("words")), 2, "claim_id")
    pairs = grams.join(maybe_broadcast(counted, small), ["h", "h2"]).select(
        "claim_id", F.floor((F.col("p") - F.col("i")) / SEED_BUCKET).alias("bucket"), F.when(F.col("cnt") < BIGRAM_RARE, 2).otherwise(1).alias("vote")
    )
    where = positions.select("pos0", F.explode(F.array_distinct("words")).alias("term"))
    asked = claims_w.select("claim_id", F.explode(F.array_distinct("q")).alias("term"))
    units = asked.join(maybe_broadcast(where, small), "term").select("claim_id", "pos0").distinct()
    votes = pairs.unionByName(units.select("claim_id", F.floor(F.col("pos0") / SEED_BUCKET).alias("bucket"), F.lit(1).alias("vote"))).groupBy("claim_id", "bucket").agg(F.sum("vote").alias("votes"))
    return votes.withColumn("seed_rank", F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc("votes"), "bucket")))


def _aligned(windows: DataFrame, claims_w: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    """(claim_id, seed_rank, p, n_words, score) of windows (claim_id, bucket, seed_rank, floor): their best-aligned spans.

    The windows of a stretch of the canon are read together, so a stretch is sent once for a quotation however many of
    its windows are asked for. Windows that cannot reach the floor are left out.
    """
    n = F.size("q")
    slack = F.greatest(F.lit(4), F.floor(n / 3))
    asked = windows.groupBy("claim_id", "floor", F.floor(F.col("bucket") / STRETCH).alias("stretch")).agg(F.collect_list(F.struct("bucket", "seed_rank")).alias("windows")).join(claims_w, "claim_id")
    at = asked.withColumn("slack", slack.cast("long")).withColumns(
        {"lo": F.greatest(F.lit(0), F.col("stretch") * STRETCH * SEED_BUCKET - F.col("slack")), "hi": (F.col("stretch") + 1) * STRETCH * SEED_BUCKET + n + F.col("slack")}
    )
    size = STRETCH * SEED_BUCKET
    blocks = tokens.groupBy(F.floor(F.col("pos") / size).alias("blk")).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("tw")).select("blk", F.transform("tw", lambda x: x["word"]).alias("w"))
    pieces = at.filter("hi > lo").withColumn("blk", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    texts = pieces.join(maybe_broadcast(blocks, small), "blk").groupBy("claim_id", "stretch").agg(
        F.any_value("q").alias("q"), F.any_value("floor").alias("floor"), F.any_value("slack").alias("slack"), F.any_value("windows").alias("windows"), F.array_sort(F.collect_list(F.struct("blk", "w"))).alias("parts")
    )
    rows = texts.select("claim_id", "q", "floor", "slack", "windows", (F.col("parts")[0]["blk"] * size).alias("base"), F.flatten(F.transform("parts", lambda x: x["w"])).alias("s"))
    found = A.evenly(rows).select("claim_id", F.explode(A.spans_of_windows("q", "s", "base", "slack", "windows", "floor")).alias("x"))
    return found.select("claim_id", "x.seed_rank", "x.p", "x.n_words", "x.score")


def fuzzy_spans(claims_w: DataFrame, tokens: DataFrame, positions: DataFrame, small: bool, places: int = 1) -> DataFrame:
    """(claim_id, p, n_words, score, seed_rank): spans at least as good as the ``places``-th best place (unit) of their quotation.

    Two rounds. The best-voted windows are aligned first; the score of their ``places``-th best unit is the floor of the rest. A pass
    over the letters bounds what a window can reach, and only windows that may come up to the floor are aligned. So
    the result is that of aligning every window.
    """
    seeds = cut_lineage(seed_windows(claims_w, tokens, positions, small))
    none = F.lit(None).cast("double").alias("floor")
    n_first = FIRST_WINDOWS * places
    first = cut_lineage(_aligned(seeds.filter(F.col("seed_rank") <= n_first).select("claim_id", "bucket", "seed_rank", none), claims_w, tokens, small))
    kth = _kth_place(first, tokens, places)
    rest = seeds.filter(F.col("seed_rank") > n_first).join(kth, "claim_id", "left").select("claim_id", "bucket", "seed_rank", F.col("kth").alias("floor"))
    spans = cut_lineage(first.unionByName(_aligned(rest, claims_w, tokens, small)))
    good = spans.join(_kth_place(spans, tokens, places), "claim_id", "left").filter(F.col("kth").isNull() | (F.round("score", 9) >= F.col("kth")))
    return good.select("claim_id", "p", "n_words", "score", "seed_rank")


def _kth_place(spans: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """(claim_id, kth): the score of the k-th best unit in which a span begins; no row where there are fewer."""
    at = spans.join(tokens.select(F.col("pos").alias("p"), "group_no", "unit_no"), "p")
    best = at.groupBy("claim_id", "group_no", "unit_no").agg(F.max(F.round("score", 9)).alias("kth"))
    w = W.partitionBy("claim_id").orderBy(F.desc("kth"), "group_no", "unit_no")
    return best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == k).select("claim_id", "kth")


def match_canon(claims_w: DataFrame, tokens: DataFrame, positions: DataFrame, small: bool) -> DataFrame:
    """Best place of each quotation: (claim_id, kind, similarity, p, n_words). Exact first; the rest goes to the windows."""
    exact = cut_lineage(first_exact(exact_places(claims_w, tokens, small)).unionByName(exact_units(claims_w, positions).select("claim_id", "n_words", "p")))
    open_claims = cut_lineage(claims_w.filter(F.size("q") >= MIN_EXACT).join(exact, "claim_id", "left_anti"))
    spans = fuzzy_spans(open_claims, tokens, positions, small)
    w = W.partitionBy("claim_id").orderBy(F.desc(F.round("score", 9)), "seed_rank")
    best = spans.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    fuzzy = best.select(
        "claim_id", F.when(F.col("score") >= 0.999, "exact").otherwise("fuzzy").alias("kind"), F.round("score", 4).alias("similarity"), "p", "n_words"
    )
    return exact.select("claim_id", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"), "p", "n_words").unionByName(fuzzy)


def matched_words(matches: DataFrame, tokens: DataFrame) -> DataFrame:
    """(claim_id, s): the stream words of each matched range, in order."""
    spans = matches.select("claim_id", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n_words") - 1)).alias("pos"))
    return spans.join(tokens.select("pos", "word"), "pos").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t")).select(
        "claim_id", F.transform("t", lambda x: x["word"]).alias("s")
    )
