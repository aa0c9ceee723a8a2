"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstream.operators.skewed import heavy_keys, key_profile
from loomstream.plans import suite_platform, suite_relational, suite_text
from loomstream.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "article"), "origin", "published_time", "url_id", "word_count", 0.04)


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    out = key_profile(table(spark, d, "article"), "origin", "published_time", "url_id", "word_count")
    return out.withColumn("share", F.round("share", 9)).withColumn("mean_gap", F.round("mean_gap", 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_profile": p4_profile} | suite_relational.QUERIES
FLAGSHIP = suite_text.FLAGSHIP
REGISTERED = (suite_platform, suite_text)  # importing them registers their queries
SQL: dict[str, str] = {
    "p4_found": """SELECT origin FROM article WHERE origin IS NOT NULL GROUP BY origin
        HAVING count(DISTINCT url_id) > 0.04 * (SELECT count(DISTINCT url_id) FROM article)""",
    "p4_profile": """
        WITH r AS (SELECT DISTINCT origin, url_id, published_time, word_count FROM article),
        g AS (SELECT *, published_time - lag(published_time) OVER (PARTITION BY origin ORDER BY published_time, url_id) AS gap FROM r)
        SELECT g.origin, (SELECT count(*) FROM article a WHERE a.origin IS NOT DISTINCT FROM g.origin) AS n_rows, count(*) AS n_records,
               min(published_time) AS first_time, max(published_time) AS last_time, max(gap) AS max_gap, round(count(*) / (SELECT count(*) FROM r), 9) AS share, round(avg(gap), 3) AS mean_gap, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS sum_word_count
        FROM g GROUP BY g.origin""",
} | suite_relational.SQL
