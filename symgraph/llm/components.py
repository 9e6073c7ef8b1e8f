"""Connected components of links between ids, on any number of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, rekeyed, sorted_in, written


def _least(links: DataFrame) -> DataFrame:
    """u, v, m: each directed link with the least of u and all ends of its links."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(rekeyed(F.col("u")).alias("k"), F.least("u", "m").alias("m"))
    return links.withColumn("k", rekeyed(F.col("u"))).join(sorted_in(least), "k").drop("k")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.*")


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long, any order, no nulls). Returns u and component, the least id it reaches,
    for each id that has a link and isn't that least one itself.

    Alternates large-star and small-star steps: every step replaces links by as many or fewer, and
    the longest path shrinks to about its logarithm. No id's links meet in one task: the least of
    them is a partial aggregate, and the join that hands it out is one that Spark may split.
    """
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        count = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(count) == state or not count[0]:
            return now.select("u", F.col("v").alias("component"))
        state = tuple(count)
        large = _least(_both_ways(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        before, now = now, written(small.select(ends.alias("l")).select("l.*").where("u <> v").distinct(), "links")
        discard(before)
