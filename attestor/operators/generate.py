"""Labelled rows made from corpora: verbatim, changed, abridged, mixed and misattributed quotations.

A keyed hash takes the place of a random generator, so results do not depend on partitioning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import text as X
from ..session import cut_lineage, fits_broadcast, maybe_broadcast
from . import grams as G
from . import retrieve as R
from . import similar as SI

SEED = 1448


def pick_hash(*cols) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), *cols)), 1, 8), 16, 10).cast("bigint")


def sample(units: DataFrame, n: int, key: str = "key") -> DataFrame:
    """``n`` units in hash order: a top-n, not a full sort."""
    return units.withColumn("pick", pick_hash(F.col(key))).orderBy("pick", key).limit(n)


def quoted_rows(units: DataFrame, marker: str, opener: str = "", closer: str = "", key: str = "key", text: str = "text") -> DataFrame:
    """Every unit wrapped with and without a marker, alternating by hash."""
    marked = pick_hash(F.col(key)) % 2 == 0
    wrapped = F.concat(F.lit(marker), F.lit(opener), F.col(text), F.lit(closer))
    return units.select(F.col(key), F.when(marked, wrapped).otherwise(F.concat(F.lit(opener), F.col(text), F.lit(closer))).alias("input_text"), marked.alias("marked"))


def replace_one(units: DataFrame, floor: float = 0.86) -> DataFrame:
    """One inner word replaced by a donor word from another unit that the unit does not contain.

    ``units``: (key BIGINT, words). The donor comes from the next unit in key order within a key range, so
    donors are found by one window over ranges.
    """
    w = W.partitionBy(F.floor(F.col("key") / 1000)).orderBy("key")
    other = F.coalesce(F.lead("words").over(w), F.first("words").over(w))
    n = F.size("words")
    r = units.withColumn("other", other).filter(n >= 5)
    donor = F.filter("other", lambda d: (F.length(d) >= 4) & ~F.array_contains("words", d))
    r = G.once(r, "donor", F.get(donor, F.lit(0))).filter("donor is not null")
    pos = (pick_hash(F.col("key")) % (n - 4) + 2).cast("int")
    r = G.once(r, "pos", pos)
    altered = F.transform("words", lambda x, i: F.when(i == F.col("pos"), F.col("donor")).otherwise(x))
    r = G.once(r, "altered", altered).withColumn("similarity", A.similarity(F.array_join("altered", " "), F.array_join("words", " ")))
    return r.filter(F.col("similarity") >= floor).select("key", "pos", "donor", "altered", "similarity")


def replace_quarter(units: DataFrame, low: float = 0.62, high: float = 0.83) -> DataFrame:
    """At least three words, a quarter of all, replaced by donor words; kept when the similarity is in the band."""
    w = W.partitionBy(F.floor(F.col("key") / 1000)).orderBy("key")
    n = F.size("words")
    r = units.withColumn("other", F.coalesce(F.lead("words").over(w), F.first("words").over(w))).filter(n >= 5)
    donors = F.filter(F.array_distinct("other"), lambda d: (F.length(d) >= 4) & ~F.array_contains("words", d))
    r = G.once(r, "donors", donors).filter(F.size("donors") > 0)
    k = F.greatest(F.lit(3), F.floor(n / 4)).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(pick_hash(F.col("key").cast("string"), i.cast("string")).alias("h"), i.alias("i"))))
    r = G.once(r, "positions", F.transform(F.slice(order, F.lit(1), k), lambda x: x["i"]))
    altered = F.transform(
        "words",
        lambda x, i: F.when(F.array_contains("positions", i), F.element_at("donors", (F.array_position("positions", i) - 1).cast("int") % F.size("donors") + 1)).otherwise(x),
    )
    r = G.once(r, "altered", altered).withColumn("similarity", A.similarity(F.array_join("altered", " "), F.array_join("words", " ")))
    return r.filter(F.col("similarity").between(low, high)).select("key", "positions", "altered", "similarity")


def drop_sevenths(units: DataFrame, low: float = 0.82, high: float = 0.93) -> DataFrame:
    kept = F.filter("words", lambda x, i: (i + 1) % 7 != 0)
    r = G.once(units, "altered", kept).withColumn("similarity", A.similarity(F.array_join("altered", " "), F.array_join("words", " ")))
    return r.filter(F.col("similarity").between(low, high)).select("key", "altered", "similarity")


def mix_four(units: DataFrame, words_out: int = 14) -> DataFrame:
    """Words of four records shuffled by hash, the first fourteen kept. Records are grouped by hash order within ranges."""
    w = W.partitionBy(F.floor(F.col("key") / 1000)).orderBy(pick_hash(F.col("key")), "key")
    g = units.withColumn("rn", F.row_number().over(w) - 1).withColumn("rng", F.floor(F.col("key") / 1000)).withColumn("grp", F.floor(F.col("rn") / 4))
    four = g.groupBy("rng", "grp").agg(F.array_sort(F.collect_list(F.struct("rn", "key", "words"))).alias("u")).filter(F.size("u") == 4)
    ws = F.flatten(F.transform("u", lambda x: F.transform(x["words"], lambda t, i: F.struct(pick_hash(x["key"].cast("string"), i.cast("string")).alias("h"), x["key"].alias("k"), i.alias("i"), t.alias("t")))))
    mixed = F.transform(F.slice(F.array_sort(ws), 1, words_out), lambda x: x["t"])
    return four.select(F.transform("u", lambda x: x["key"]).alias("keys"), mixed.alias("words"), F.array_join(mixed, " ").alias("text"))


def misattributed(units: DataFrame, wrapper: str, text: str = "text") -> DataFrame:
    return units.select("key", F.concat(F.lit(wrapper), F.lit(": «"), F.col(text), F.lit("»")).alias("input_text"), F.lit("attributed_quote").alias("claim_type"), F.lit("contradicted").alias("expected_state"))


def alternate_rows(graded: DataFrame, opening: str = 'The Prophet (peace be upon him) said: "') -> DataFrame:
    """Rows in the alternate language: the part after the first colon of the opening 160 characters, quotes trimmed."""
    t = F.col("en.hadeeth")
    after = F.trim(F.substr(t, F.instr(t, F.lit(":")) + 1))
    quoted = F.when(F.substr(t, F.lit(1), F.lit(160)).contains(":"), after).otherwise(t)
    return graded.filter(F.length(t) > 0).select("key", F.concat(F.lit(opening), F.btrim(quoted, F.lit('"')), F.lit('"')).alias("input_text"))


def rejected_everywhere(grade_rows: DataFrame, corpus: DataFrame, script: str, shortest: int = 8, longest: int = 35, similar: tuple[int, int] = (4, 5), known: float = 0.6) -> DataFrame:
    """Grade texts whose every near copy rejects them and whose words no sound corpus holds: (key, grade_class, copies, best).

    ``grade_rows``: (key, text, grade_class); ``corpus``: (key, text). Near copies share four fifths of the distinct
    words of both (a join of all grade texts with themselves, each group of equal texts one row); ``copies`` is the number of
    rows they are, the row itself included. A text's words are taken once. ``best`` is the best aligned candidate of the corpus, 0 where there is none.
    """
    texts = G.once(grade_rows.filter("key IS NOT NULL").select("key", "grade_class", "text"), "words", R.normal_words(F.col("text"), script))
    texts = cut_lineage(texts.select("key", "grade_class", "words", F.size("words").alias("n_words"), SI.set_id(F.col("words")).alias("sid")))
    rows = texts.filter("sid IS NOT NULL").select("key", "sid").join(texts.select("key", "grade_class"), "key")
    rejects = F.col("grade_class").isin("weak", "fabricated")
    own = rows.filter(rejects).join(texts.filter(F.col("n_words").between(shortest, longest)).select("key"), "key", "left_semi").select("key", "grade_class", "sid")
    classes = rows.groupBy("sid").agg(F.collect_set("grade_class").alias("classes"), F.count("*").alias("members"))
    sets = texts.filter("sid IS NOT NULL").groupBy("sid").agg(F.any_value("words").alias("words")).select("sid", F.array_distinct("words").alias("ws")).join(classes, "sid")
    sets = sets.join(own.select("sid").distinct().withColumn("wanted", F.lit(True)), "sid", "left").fillna(False, ["wanted"])
    sets = cut_lineage(sets.select("sid", F.monotonically_increasing_id().alias("no"), F.size("ws").alias("n"), "ws", "wanted", "classes", "members"))
    asked = sets.filter("wanted").select("sid", "no")
    near = SI.similar_sets(sets.select(F.col("no").alias("sid"), "n", "ws", "wanted"), *similar).select(F.col("sid").alias("no"), "other").unionByName(asked.select("no", F.col("no").alias("other")))
    around = near.join(sets.select(F.col("no").alias("other"), "classes", "members"), "other").groupBy("no").agg(
        F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"), F.sum("members").alias("copies")
    )
    rejecting = F.forall("classes", lambda x: x.isin("weak", "fabricated", "unknown"))
    consistent = ~((F.col("grade_class") == "weak") & F.array_contains("classes", "fabricated"))
    left = cut_lineage(own.join(around.join(asked, "no"), "sid").filter(rejecting & consistent).select("key", "grade_class", "copies"))
    keys = left.select("key").distinct()
    claims = cut_lineage(texts.join(maybe_broadcast(keys, fits_broadcast(keys)), "key", "left_semi").select(F.col("key").alias("claim_id"), "words"))
    held = G.once(corpus.select("key", "text"), "words", R.normal_words(F.col("text"), script)).drop("text")
    found = R.bm25(claims.select("claim_id", X.query_terms(F.col("words")).alias("terms")), held)
    best = R.best_similarity(found, claims.withColumnRenamed("words", "q"), held).select("claim_id", F.col("similarity").alias("best"))
    scored = left.join(best.withColumnRenamed("claim_id", "key"), "key", "left").fillna(0.0, ["best"])
    return scored.filter(F.col("best") < known)


def compose_documents(leads: DataFrame, supporting: DataFrame, opener: str, bridge: str, closer: str) -> DataFrame:
    """Composite documents: a lead row each, every second one with a supporting row, framed by opener and closer.

    ``leads``, ``supporting``: (n, id, input_text, expected_state) with n counted from 1. Supporting rows are reused
    in turn.
    """
    size = supporting.agg(F.count("*")).scalar()
    pair = leads.withColumn("m", F.when((F.col("n") % 2 == 0) & (size > 0), (F.col("n") / 2 - 1).cast("bigint") % size + 1))
    s = supporting.select(F.col("n").alias("m"), F.col("id").alias("s_id"), F.col("input_text").alias("s_text"), F.col("expected_state").alias("s_state"))
    j = pair.join(s, "m", "left")
    row = lambda i, st: F.struct(F.col(i).alias("id"), F.col(st).alias("expected_state"))
    return j.select(
        F.col("n").alias("doc_id"),
        F.concat_ws("\n", F.lit(opener), "input_text", F.when(F.col("s_id").isNotNull(), F.lit(bridge)), "s_text", F.lit(closer)).alias("text"),
        F.when(F.col("s_id").isNotNull(), F.array(row("id", "expected_state"), row("s_id", "s_state"))).otherwise(F.array(row("id", "expected_state"))).alias("expected"),
    )


def chance_level(spans: DataFrame) -> DataFrame:
    """Nearest-span similarity of shuffled texts by length: (words, n, median, p99, max)."""
    return spans.groupBy("words").agg(
        F.count("*").alias("n"), F.percentile("similarity", F.lit(0.5)).alias("median"), F.percentile("similarity", F.lit(0.99)).alias("p99"), F.max("similarity").alias("max")
    )
