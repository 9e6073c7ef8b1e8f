"""Interval joins within a key, cut into buckets so that no long file is a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bucket: intervals go to each bucket they touch, points to one.
BUCKET = 64


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str = "line", start: str = "start_line", end: str = "end_line", bucket: int = BUCKET) -> DataFrame:
    """Points inside intervals (ends included) of the same key. Column names of the sides don't overlap but for on.

    The join is an equi-join on the key and the bucket, with the exact test after it: a point has one
    bucket, so no pair is found twice, and the work is that of intervals over a bucket's points.
    """
    spread = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    filed = points.withColumn("bucket", F.floor(F.col(at) / bucket))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    return filed.join(spread, [*on, "bucket"]).where(inside).drop("bucket")


def range_join(inner: DataFrame, outer: DataFrame, on: list[str], inside: Column, start: str, outer_start: str, outer_end: str, bucket: int = BUCKET) -> DataFrame:
    """Pairs of inner and outer intervals of the same key that pass `inside`, which must imply that the
    inner one starts within the outer one."""
    return interval_join(inner, outer, on, start, outer_start, outer_end, bucket).where(inside)


def first_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row a key: the first in order. A top-1 window, which Spark limits before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
