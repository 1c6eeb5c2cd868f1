"""Corpus token streams, position-keyed n-grams, frequencies and corpus statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage

BLOCK = 4096  # positions per window block when grams are read off a long stream
UNIT_BLOCK = 1000  # units per first-level block of the running totals


def doc_words(docs: DataFrame, script: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words): one narrow pass over the text column."""
    return once(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "words", X.words(F.col("t"), script)).drop("t")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row.

    A one-element generator keeps the optimizer from inlining an expensive expression into every later use of it
    (inside a lambda that would mean once per word).
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Redistributes an input that has fewer splits than the session has cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gram_structs(words: Column, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.struct(
            i.alias("i"),
            F.xxhash64(F.slice(words, i + 1, n)).alias("h"),
            F.hash(F.slice(words, i + 1, n)).alias("h2"),
        ),
    )


def explode_grams(words: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """(key, i, h, h2): one row per n-gram. Two independent hashes (96 bits together) stand for the words.

    The array is zipped with its own shifted copies, so the hashing runs in generated code after the explode.
    """
    length = F.size("words") - (n - 1)
    shifted = F.arrays_zip(*[F.slice("words", F.lit(k + 1), length).alias(f"w{k}") for k in range(n)])
    rows = words.filter(F.size("words") >= n).select(key, F.posexplode(shifted).alias("i", "z"))
    parts = [F.col("z")[f"w{k}"] for k in range(n)]
    return rows.select(key, "i", F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("h2"))


def unit_positions(units: DataFrame, script: str, text_col: str) -> DataFrame:
    """Units with their words and the stream position of their first word.

    The running total is hierarchical (block of units, blocks of a group, groups), so no single task sees the
    whole corpus: only counts travel, never text.
    """
    return _running_positions(once(units.select("group_no", "unit_no", F.col(text_col).alias("t")), "words", X.words(F.col("t"), script)).drop("t"))


def record_positions(record_words: DataFrame) -> DataFrame:
    """(src, words, pos0): records one after the other, in the order of ``src`` (``record_words``: src, words)."""
    grouped = record_words.filter(F.size("words") > 0).select(F.floor(F.col("src") / (UNIT_BLOCK * UNIT_BLOCK)).alias("group_no"), F.col("src").alias("unit_no"), "words")
    return _running_positions(grouped).select(F.col("unit_no").alias("src"), "words", "pos0")


def _running_positions(unit_words: DataFrame) -> DataFrame:
    sized = unit_words.withColumn("n", F.size("words").cast("long")).withColumn("block", F.floor(F.col("unit_no") / UNIT_BLOCK).cast("long"))
    blocks = sized.groupBy("group_no", "block").agg(F.sum("n").alias("bn"))
    groups = blocks.groupBy("group_no").agg(F.sum("bn").alias("gn"))
    before = lambda total, w: F.coalesce(F.sum(total).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    groups = groups.select("group_no", before("gn", W.orderBy("group_no")).alias("g0"))
    blocks = blocks.select("group_no", "block", before("bn", W.partitionBy("group_no").orderBy("block")).alias("b0"))
    return (
        sized.withColumn("u0", before("n", W.partitionBy("group_no", "block").orderBy("unit_no")))
        .join(blocks, ["group_no", "block"])
        .join(groups, "group_no")
        .select("group_no", "unit_no", "words", (F.col("u0") + F.col("b0") + F.col("g0")).alias("pos0"))
    )


def stream_tokens(positions: DataFrame) -> DataFrame:
    """(pos, word, group_no, unit_no): the whole canon as one word stream."""
    return positions.select("group_no", "unit_no", "pos0", F.posexplode("words").alias("k", "word")).select(
        (F.col("pos0") + F.col("k")).alias("pos"), "word", "group_no", "unit_no"
    )


def stream_grams(tokens: DataFrame, n: int, extra: list[str] | None = None) -> DataFrame:
    """n-grams of the stream across unit borders: (pos, words[, extra]).

    The stream is cut into overlapping blocks, so the windows stay small whatever the corpus size.
    """
    block = F.floor(F.col("pos") / BLOCK)
    cut = tokens.withColumn(
        "blk", F.explode(F.when((F.col("pos") % BLOCK < n - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block)))
    )
    w = W.partitionBy("blk").orderBy("pos")
    grams = cut.select(
        "pos", "blk", *(extra or []), F.array(*[F.lead("word", k).over(w) for k in range(n)]).alias("words")
    )
    return grams.filter((F.floor(F.col("pos") / BLOCK) == F.col("blk")) & F.element_at("words", n).isNotNull()).drop("blk")


def hashed(grams: DataFrame) -> DataFrame:
    return grams.select("*", F.xxhash64("words").alias("h"), F.hash("words").alias("h2"))


def position_grams(words: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), key: str = "doc_id") -> DataFrame:
    """(key, n, i, gram): position-keyed grams of every text, as text, for inspection and small lookups."""

    top = max(sizes)
    shifted = F.arrays_zip(*[F.slice("words", F.lit(k + 1), F.size("words")).alias(f"w{k}") for k in range(top)])
    at = words.select(key, F.posexplode(shifted).alias("i", "z"))
    gram = lambda n: F.when(F.col("z")[f"w{n - 1}"].isNotNull(), F.concat_ws(" ", *[F.col("z")[f"w{k}"] for k in range(n)]))
    each = F.array(*[F.struct(F.lit(n).alias("n"), gram(n).alias("gram")) for n in sizes])
    return at.select(key, "i", F.explode(each).alias("g")).filter("g.gram IS NOT NULL").select(key, "g.n", "i", "g.gram")


def capped(postings: DataFrame, by: list[str], cap: int, count: Column | None = None) -> DataFrame:
    """Postings whose key occurs at most ``cap`` times. The count is a partial aggregate before the join back."""
    counts = postings.groupBy(*by).agg((count if count is not None else F.count("*")).alias("cnt")).filter(F.col("cnt") <= cap)
    return postings.join(counts, by)


# --------------------------------------------------------------------------- statistics


def word_idf(unit_words: DataFrame) -> DataFrame:
    """(word, df, idf) with idf = ln(1 + n / df) over units; n is a scalar subquery."""
    total = unit_count(unit_words)
    df = unit_words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.select("word", "df", F.log(1 + total.scalar() / F.col("df")).alias("idf"))


def unit_count(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("n"))


def title_idf(page_stems: DataFrame) -> DataFrame:
    """(stem, df, idf) with idf = ln((n + 1) / (df + 0.5)) over titled pages."""
    n = page_stems.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    df = page_stems.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))
    return df.select("stem", "df", F.log((n.scalar() + 1) / (F.col("df") + 0.5)).alias("idf"))


def postings(records: DataFrame, key: str = "key") -> DataFrame:
    """(term, key, tf, dl): term frequencies and record length, counted inside each row before any shuffle."""
    return (
        records.select(key, F.size("words").alias("dl"), "words")
        .select(key, "dl", F.explode("words").alias("term"))
        .groupBy("term", key, "dl")
        .agg(F.count("*").alias("tf"))
    )


_RECORD = "\x00"  # stands for the record itself among its terms; no word is spelt so


def asked_postings(records: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, Column]:
    """Postings (term, key, tf, dl) of the asked ``terms`` (term), the number of records and their mean length.

    The texts are read once: every record also brings a row for itself, which the statistics are taken from.
    """
    wanted = terms.unionByName(terms.sparkSession.range(1).select(F.lit(_RECORD).alias("term"))).distinct()
    of_record = F.concat(F.array(F.lit(_RECORD)), F.coalesce("words", F.array().cast("array<string>")))
    rows = records.select("key", F.size("words").alias("dl"), F.explode(of_record).alias("term")).join(wanted, "term", "left_semi")
    post = cut_lineage(rows.groupBy("term", "key", "dl").agg(F.count("*").alias("tf")))
    whole = post.filter(F.col("term") == _RECORD)
    n, words, sized = whole.agg(F.coalesce(F.sum("tf"), F.lit(0)), F.sum(F.col("tf") * F.col("dl")), F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).first()
    return post.filter(F.col("term") != _RECORD), n, F.lit(words / sized if sized else None).cast("double")


def corpus_stats(records: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    return records.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))


def term_df(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))
