"""Interval joins on (doc_id, character range), bucketed so that only neighbours meet."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 512


def _bucketed(df: DataFrame, prefix: str, reach: int) -> DataFrame:
    renamed = df.select("doc_id", *[F.col(c).alias(prefix + c) for c in df.columns if c != "doc_id"])
    lo, hi = F.floor((F.col(prefix + "start") - reach) / WIDTH), F.floor((F.col(prefix + "end") - 1 + reach) / WIDTH)
    return renamed.withColumn(prefix + "lo", lo).withColumn("bucket", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def near_pairs(a: DataFrame, b: DataFrame, reach: int = 0, left: str = "a_", right: str = "b_") -> DataFrame:
    """Every (a, b) of one document whose ranges share a character or lie within ``reach`` of each other, once.

    Both sides need doc_id, start, end. Ranges are spread over fixed-width buckets and met by an equi-join, so a
    long document is split by position instead of forming all pairs.
    """
    x, y = _bucketed(a, left, reach), _bucketed(b, right, 0)
    first = F.col("bucket") == F.greatest(left + "lo", right + "lo")
    close = (F.col(left + "start") - reach < F.col(right + "end")) & (F.col(right + "start") < F.col(left + "end") + reach)
    return x.join(y, ["doc_id", "bucket"]).filter(first & close).drop("bucket", left + "lo", right + "lo")


def shared(left: str = "a_", right: str = "b_") -> Column:
    return F.greatest(F.lit(0), F.least(left + "end", right + "end") - F.greatest(left + "start", right + "start"))


def length(prefix: str) -> Column:
    return F.col(prefix + "end") - F.col(prefix + "start")
