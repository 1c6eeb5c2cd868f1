"""Similarity joins of texts: by shared words (prefix filter) and by edits (unchanged pieces), then exact verification."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alignment import evenly


def set_id(words: Column) -> Column:
    """The name of the distinct words of a record, equal for equal sets; null without words."""
    return F.when(F.size(words) > 0, F.sha2(F.array_join(F.sort_array(F.array_distinct(words)), "\x1f"), 256))


def word_sets(records: DataFrame) -> DataFrame:
    """(key, sid, n, ws): the distinct words of each record; ``sid`` names the set, equal sets share it.

    ``records``: (key, words). Records without words have no set.
    """
    sets = records.select("key", set_id(F.col("words")).alias("sid"), F.array_sort(F.array_distinct("words")).alias("ws"))
    return sets.filter("sid IS NOT NULL").select("key", "sid", F.size("ws").alias("n"), "ws")


WORDS_A_MEETING = 60  # words of two sets together for each further word that they must share at the front


def met_sets(sets: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(sid, other): wanted sets and the sets that may be similar to them; no similar pair is missing.

    ``sets``: (sid, n, ws, wanted). Two similar sets of n and m words share ``least = ceil((n + m) t / (1 + t))`` words
    or more. Behind the first k of them, in any common order, ``least - k`` are left on both sides, so these k stand
    near the front of both sets; k grows with the sizes, and a pair counts when it meets in k such words.
    With words first that are rare among the wanted sets few sets meet by chance, and a set with many words
    that no wanted set has meets none: places are counted from behind, where such words need not stand. Words meet as
    numbers; two words of one number only add meetings.
    """
    words = sets.select("sid", "n", "wanted", F.explode("ws").alias("word")).select("sid", "n", "wanted", F.xxhash64("word").alias("word"))
    asked = words.filter("wanted")
    df = asked.groupBy("word").agg(F.count("*").alias("df"))
    behind = F.row_number().over(W.partitionBy("sid").orderBy(F.desc("df"), F.desc("word")))
    # no set of a fitting size asks for a word further behind
    last = F.ceil(F.col("n") * (WORDS_A_MEETING * num - num - den) / F.lit(WORDS_A_MEETING * den))
    front = lambda some: some.join(df.hint("shuffle_hash"), "word").withColumn("behind", behind).filter(F.col("behind") >= last)
    a = front(asked).select("sid", "n", "behind", "word")
    b = front(words).select(F.col("sid").alias("other"), F.col("n").alias("m"), F.col("behind").alias("left"), "word")
    least = F.ceil((F.col("n") + F.col("m")) * num / F.lit(num + den))
    shared = F.least(least, F.floor((F.col("n") + F.col("m")) / F.lit(WORDS_A_MEETING)) + 1)
    fits = (F.col("n") * num <= F.col("m") * den) & (F.col("m") * num <= F.col("n") * den)
    at_front = F.least("behind", "left") >= least - shared + 1
    met = a.join(b, "word").filter((F.col("sid") != F.col("other")) & fits & at_front)
    return met.groupBy("sid", "other", "n", "m").agg(F.count("*").alias("meetings")).filter(F.col("meetings") >= shared).select("sid", "other")


def similar_sets(sets: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(sid, other, shared, similarity) of distinct sets whose Jaccard similarity is ``num / den`` or more, itself left out.

    ``sets``: (sid, n, ws, wanted), one row per set; pairs are made for wanted sets only, with every set. Words are
    carried only into the pairs that ``met_sets`` leaves. Groups of equal texts are one row here.
    """
    met = met_sets(sets, num, den)
    both = met.join(sets.filter("wanted").select("sid", "n", "ws"), "sid").join(sets.select(F.col("sid").alias("other"), F.col("n").alias("m"), F.col("ws").alias("vs")), "other")
    shared = both.select("sid", "other", "n", "m", F.size(F.array_intersect("ws", "vs")).alias("shared"))
    return shared.filter(F.col("shared") * (num + den) >= (F.col("n") + F.col("m")) * num).select(
        "sid", "other", F.col("shared"), (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("similarity")
    )


# --------------------------------------------------------------------------- edit similarity

BUCKET_LETTERS, BUCKETS_A_FOLD = 32, 4  # places are bucketed by the logarithm of their distance from the start


def allowed(length: Column, num: int, den: int) -> Column:
    """The most edits between a text of this length and one no less similar than ``num / den``; the other may be longer."""
    return F.floor(F.floor(length * den / F.lit(num)) * (den - num) / F.lit(den)).cast("int")


def piece_widths(num: int, den: int, least: int) -> list[int]:
    """The widths that pieces of texts of ``least`` letters or more can have: those of long texts tend to num / (den - num)."""
    top = 4 * den * den  # beyond it the width is that of the limit
    return sorted({n // ((n * den // num) * (den - num) // den + 1) for n in range(max(least, 1), max(least, 1) + top)})


def _bucket(place: Column) -> Column:
    return F.floor(F.log(1 + place / F.lit(BUCKET_LETTERS)) * BUCKETS_A_FOLD).cast("int")


def near_texts(wanted: DataFrame, texts: DataFrame, num: int = 22, den: int = 25, least: int = 11) -> DataFrame:
    """(sid, other, edits, similarity) of wanted texts and texts with 1 - edits / longer length >= ``num / den``.

    Both: (sid, t), one row per text; wanted texts have ``least`` letters or more. A wanted text that allows k edits
    is cut into k + 1 pieces of one width. Of two similar texts some piece stands unchanged in the other, moved by no
    more letters than there are pieces before it (each of those holds an edit, or an earlier piece would do) and no
    more than edits are left for the pieces behind it. Pieces meet the other side's substrings by an equi-join on
    letters and place; a place's bucket is as wide as the distance from the start, so each substring is sent
    to a few buckets only. Lengths and places are compared before pairs are shuffled, the rest gets its edit distance.
    """
    n, m = F.length("t"), F.length("t")
    number = F.xxhash64("sid")
    at_key = F.xxhash64("w", "piece", "b").alias("at")
    q = wanted.filter(n >= least).select(number.alias("sid"), n.alias("n"), allowed(n, num, den).alias("k"), "t")
    q = q.withColumn("w", F.floor(F.col("n") / (F.col("k") + 1)).cast("int"))
    cut = q.select("sid", "n", "k", "w", "t", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    pieces = cut.select("sid", "n", "k", "w", "i", F.substr("t", F.col("i") * F.col("w") + 1, "w").alias("piece"), _bucket(F.col("i") * F.col("w")).alias("b")).select("sid", "n", "k", "w", "i", at_key)
    widths = F.explode(F.array(*[F.lit(w) for w in piece_widths(num, den, least)]))
    at = evenly(texts).select(number.alias("other"), "t", m.alias("m"), widths.alias("w")).filter(F.col("m") >= F.col("w"))
    at = at.select("other", "t", "m", "w", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("w"))).alias("p"))
    low, high = F.ceil(F.col("p") * F.col("w") / (F.col("w") + 1)), F.floor(F.col("p") * F.col("w") / F.greatest(F.col("w") - 1, F.lit(1)))
    places = at.select("other", "m", "w", "p", F.substr("t", F.col("p") + 1, "w").alias("piece"), F.explode(F.sequence(_bucket(low), F.when(F.col("w") > 1, _bucket(high)).otherwise(_bucket(F.ceil(F.col("m") * den / F.lit(num)))))).alias("b")).select("other", "m", "p", at_key)
    moved = F.col("p") - F.col("i") * F.col("w")
    lengths = (F.col("n") * num <= F.col("m") * den) & (F.col("m") * num <= F.col("n") * den)
    near = lengths & (F.abs(moved) <= F.col("i")) & (F.abs(moved - (F.col("m") - F.col("n"))) <= F.col("k") - F.col("i"))
    met = pieces.join(places, "at").filter(near).select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct()
    both = met.join(wanted.select(number.alias("a"), "sid", F.col("t").alias("q")), "a").join(texts.select(number.alias("b"), F.col("sid").alias("other"), F.col("t").alias("r")), "b")
    longer = F.greatest(F.length("q"), F.length("r"))
    both = both.withColumn("most", F.floor(longer * (den - num) / F.lit(den)).cast("int")).withColumn("edits", F.expr("levenshtein(q, r, most)"))
    return both.filter("edits >= 0").select("sid", "other", "edits", (1.0 - F.col("edits") / longer).alias("similarity"))
