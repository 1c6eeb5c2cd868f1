"""Reference corpora read from files into tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import grams as G


def pipe_rows(lines: DataFrame) -> DataFrame:
    """``group|unit|text`` lines -> (group_no, unit_no, text); blank and ``#`` lines are skipped."""
    kept = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    part = F.split("value", r"\|", 3)
    return kept.select(part[0].cast("int").alias("group_no"), part[1].cast("int").alias("unit_no"), F.trim(part[2]).alias("text"))


def canon_from_rows(display: DataFrame, match: DataFrame, script: str = "arabic", keep_opening: tuple[int, ...] = (1, 9)) -> DataFrame:
    """Both spellings joined on (group, unit); the opening formula shared by the groups leaves their first unit.

    The formula is unit 1 of group 1. Groups in ``keep_opening`` keep their first unit as it is.
    """
    both = display.withColumnRenamed("text", "text_display").join(match.withColumnRenamed("text", "text_match"), ["group_no", "unit_no"])
    formula = both.filter("group_no = 1 and unit_no = 1").select("text_display", "text_match")
    n = formula.select(F.size(F.split(X.squeeze(F.col("text_display")), " "))).scalar()
    norm = formula.select(X.normalize(F.col("text_match"), script)).scalar()
    mw, dw = F.split(X.squeeze(F.col("text_match")), " "), F.split(X.squeeze(F.col("text_display")), " ")
    opens = (F.col("unit_no") == 1) & ~F.col("group_no").isin(*keep_opening) & (X.normalize(F.array_join(F.slice(mw, F.lit(1), n), " "), script) == norm)
    rest = lambda ws: F.array_join(F.slice(ws, n + 1, F.greatest(F.size(ws) - n, F.lit(0))), " ")
    return both.select(
        "group_no", "unit_no", F.when(opens, rest(dw)).otherwise(F.col("text_display")).alias("text_display"), F.when(opens, rest(mw)).otherwise(F.col("text_match")).alias("text_match")
    )


def read_canon(spark: SparkSession, display_path: str, match_path: str, script: str = "arabic") -> DataFrame:
    return canon_from_rows(pipe_rows(spark.read.text(display_path)), pipe_rows(spark.read.text(match_path)), script)


def group_rows(lines: DataFrame) -> DataFrame:
    """Group dimension from XML elements ``<sura index=".." name=".." tname=".." ayas=".." type=".."/>``."""
    attr = lambda name: F.regexp_extract("value", rf'\b{name}="([^"]*)"', 1)
    rows = lines.filter(F.col("value").rlike(r"<sura\s[^>]+/>"))
    return rows.select(attr("index").cast("int").alias("group_no"), attr("name").alias("name"), attr("tname").alias("name_en"), attr("ayas").cast("int").alias("units"), attr("type").alias("type"))


def ungraded_rows(rows: DataFrame, script: str = "arabic") -> DataFrame:
    """(book, num_text, text) -> (book, num, text, norm): numbered rows whose normal form is not empty."""
    kept = rows.filter(F.trim(F.col("num_text")).rlike(r"^\d+$") & F.col("text").isNotNull())
    shown = kept.select("book", F.trim("num_text").cast("int").alias("num"), X.clean_display(F.col("text")).alias("text"))
    return shown.withColumn("norm", X.normalize(F.col("text"), script, drop_honorifics=True)).filter("norm != ''")


def read_ungraded(spark: SparkSession, path: str, book: str, script: str = "arabic") -> DataFrame:
    raw = spark.read.schema("num_text string, text string").option("multiLine", True).option("escape", '"').csv(path)
    return ungraded_rows(raw.withColumn("book", F.lit(book)), script)


def with_row_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """Dense ids in a global order without a one-task sort: a range-partitioned sort, then per-partition offsets."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("rn", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").withColumn("doc_id", (F.col("before") + F.col("rn")).cast("bigint")).drop("part", "rn", "before")


def write_ungraded(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("book").parquet(path)


def count_per_book(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book").agg(F.count("*").alias("n"))


def graded_rows(raw: DataFrame) -> DataFrame:
    """Nested records, one row each: key, text and display fields plus the optional translation."""
    r = raw.select(F.explode("hadeeths").alias("r")).select("r.*")
    ref = F.when(F.trim(F.coalesce("attribution", F.lit(""))) != "", F.trim("attribution")).otherwise(F.concat(F.lit("#"), F.col("id")))
    return r.select(
        F.col("id").alias("key"), "title", F.col("hadeeth").alias("text"), F.col("hadeeth_intro").alias("intro"), "attribution", ref.alias("ref"),
        F.nullif(F.trim("grade"), F.lit("")).alias("grade"), "explanation", "url", "categories", "en",
    )


def read_graded(spark: SparkSession, path: str) -> DataFrame:
    return graded_rows(spark.read.schema(S.GRADED_FILE).option("multiLine", True).json(path))


SITE_PAGE = r"^https?://([^/]+)/([^/?#]+)/([^/?#]+)"


def titled_pages(urls: DataFrame, collection: Column, title: Column, uid: Column, min_length: int = 8) -> DataFrame:
    """(collection, title, uid, url): squeezed titles that say something, first address per uid in url order."""
    parts = urls.select(F.trim("url").alias("url"), F.trim(collection).alias("collection"), X.squeeze(title).alias("title"), F.trim(uid).alias("uid"), "pos")
    named = parts.filter((F.length("title") >= min_length) & ~F.col("title").rlike(V.NUMBERED_TITLE))
    first = W.partitionBy("uid").orderBy("pos")
    return named.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("collection", "title", "uid", "url")


def voice_library_pages(urls: DataFrame) -> DataFrame:
    """Pages addressed ``<site>/<lang>/voice_library/lessonDetails/<collection>/<title>/<uuid>``."""
    pattern = r"^https://[^/]+/ar/voice_library/lessonDetails/([^/]+)/([^/]+)/([0-9a-f-]{36})$"
    decoded = F.url_decode(F.regexp_replace(F.trim("url"), r"\+", "%2B"))
    part = lambda i: F.regexp_extract(decoded, pattern, i)
    return titled_pages(urls.filter(decoded.rlike(pattern)), part(1), part(2), part(3))


def snapshot(corpora: dict[str, DataFrame], newest: Column) -> DataFrame:
    """One row: newest date and the size of every corpus."""
    parts = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, df in corpora.items()]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    listed = F.array_sort(F.collect_list(F.struct("name", "n")))
    joined = F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["name"], x["n"].cast("string"))), " · ")
    return counts.agg(joined.alias("sizes")).select(F.concat_ws(" · ", F.date_format(newest, "yyyy.MM.dd"), "sizes").alias("data_version"))


__all__ = [n for n in dir() if not n.startswith("_") and n != "G"]
