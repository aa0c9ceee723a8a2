"""Shares of articles brought to one scale across sites and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstream.operators.aggregates import cumulative_buckets, project_quantile

HOUR, DAY = 3_600_000, 86_400_000
# The ages up to which engagements are kept apart; the last one has no end.
AGE_ENDS = (4 * HOUR, 6 * HOUR, 12 * HOUR, 18 * HOUR, DAY, 2 * DAY, 3 * DAY, 5 * DAY, 7 * DAY, 14 * DAY, 30 * DAY, 90 * DAY, (1 << 63) - 1)


def normal_count(count: Column, site_articles: Column, site_shares: Column, all_articles: Column, all_shares: Column) -> Column:
    """A share count scaled down to the general level where its site's articles are shared more than others; never up.

    A site without articles or shares leaves the count as it is.
    """
    factor = F.try_divide(all_shares / all_articles, F.try_divide(site_shares, site_articles))
    return F.floor(F.coalesce(F.least(count.cast("double"), count * factor), count.cast("double"))).cast("bigint")


def youngest_end(age: Column, ends: tuple[int, ...] = AGE_ENDS) -> Column:
    """The nearest of the ages' ends that lies beyond an age; negative ages are 0."""
    return F.array_min(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e > F.greatest(age, F.lit(0))))


def site_totals(rows: DataFrame, site: str, count: str) -> DataFrame:
    """(site, articles, shares): rows have one engagement an article, the latest."""
    return rows.groupBy(site).agg(F.count("*").alias("articles"), F.sum(count).alias("shares"))


def share_scores(rows: DataFrame, site: str, count: str, age: str, ends: tuple[int, ...] = AGE_ENDS) -> DataFrame:
    """Rows with `normal`, their count on the general scale, and `share_score`: its quantile among all rows of the youngest range of ages that holds the row.

    Every row counts for all ranges that end after its age. Totals and distributions are one row a site and a range.
    Null sites, counts and ages have a null score.
    """
    known = rows.filter(F.col(site).isNotNull() & F.col(count).isNotNull())
    totals = site_totals(known, site, count)
    every = totals.agg(F.sum("articles").alias("a"), F.sum("shares").alias("s"))
    scaled = rows.join(totals.withColumnsRenamed({"articles": "__a", "shares": "__s"}), site, "left")
    scaled = scaled.withColumn("__all", every.select(F.struct("a", "s")).scalar())
    scaled = scaled.withColumn("normal", F.when(F.col(site).isNotNull(), normal_count(F.col(count), F.col("__a"), F.col("__s"), F.col("__all.a"), F.col("__all.s"))))
    scaled = scaled.drop("__a", "__s", "__all").withColumn("__end", youngest_end(F.col(age), ends))
    dist = cumulative_buckets(scaled.filter("normal is not null"), F.greatest(F.col(age), F.lit(0)), list(ends), F.col("normal")).select(F.col("end").alias("__end"), "distribution")
    out = scaled.join(F.broadcast(dist), "__end", "left")  # as many rows as ends
    return out.withColumn("share_score", project_quantile(F.col("distribution"), F.col("normal"))).drop("__end", "distribution")
