"""The pN_ queries of the llm operators and the SQL some of them can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstream.llm import boilerplate, encoding, leaks, mixing, near_duplicates, reading, repeated_lines, subjects, truncation
from loomstream.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    art = table(spark, d, "article", "url_id", "origin", "paragraph")
    return repeated_lines.repeated_occurrences(art, "origin", "url_id", "paragraph").select(F.col("doc").alias("url_id"), "pos")


def p1_sequences(spark: SparkSession, d: str) -> DataFrame:
    art = table(spark, d, "article", "url_id", "origin", "paragraph")
    return repeated_lines.repeated_sequences(art, "origin", "url_id", "paragraph")


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Articles without the lines repeated in their origin, as the number of elements and characters left."""
    out = repeated_lines.without_repeated_lines(table(spark, d, "article", "url_id", "origin", "paragraph"), "origin", "url_id", "paragraph")
    left = F.coalesce(F.when(F.col("paragraph").isNotNull(), F.size("paragraph")), F.lit(0)).cast("bigint")
    chars = F.coalesce(F.aggregate("paragraph", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.length(p), F.lit(0))), F.lit(0)).cast("bigint")
    return out.select("url_id", left.alias("elements"), chars.alias("characters"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_values(table(spark, d, "article"), table(spark, d, "documents", "doc_id", "text", "lang"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(table(spark, d, "article"), table(spark, d, "documents", "doc_id", "text", "lang"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_values(table(spark, d, "article")).select("url_id", "field", "pos").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_values(table(spark, d, "article")).distinct()


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(
        table(spark, d, "article"), table(spark, d, "trained_article_classification"), table(spark, d, "subject_area"), table(spark, d, "documents"), least=1, most=2
    )  # every article has one or two, as the table's description says


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("url_id", "subject").distinct()


def p5_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("url_id", "subject").distinct().groupBy("subject").agg(F.count("*").alias("articles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture(table(spark, d, "article"), table(spark, d, "documents")).distinct()


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Articles with their own body only, as the number of elements and characters left."""
    out = boilerplate.bodies(table(spark, d, "article"), table(spark, d, "documents"))
    chars = F.aggregate("body", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)))
    return out.select("url_id", F.size("body").alias("elements"), chars.alias("characters"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    sets = near_duplicates.article_sets(table(spark, d, "article"), table(spark, d, "documents"))
    return near_duplicates.record_pairs(sets, 0.5).select(F.col("id_a").alias("url_id_a"), F.col("id_b").alias("url_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    sets = near_duplicates.article_sets(table(spark, d, "article"), table(spark, d, "documents"))
    return near_duplicates.record_groups(sets, 0.5).withColumnRenamed("id", "url_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unreachable_sources(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_label")).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    out = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_label"))
    return out.groupBy("reading_level").agg(F.count("*").alias("documents"), F.round(F.avg("difficulty"), 4).alias("mean_difficulty"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_sequences, p1_cleaned, p2_found, p2_rates, p3_found, p3_restored, p5_found, p5_composition, p6_found, p6_bodies, p7_found, p7_groups, p8_found, p9_found, p9_mix, p10_found, p10_profile)
}

SQL: dict[str, str] = {
    "p1_found": r"""
        WITH lines AS (
            SELECT DISTINCT origin, url_id, pos - 1 AS pos, regexp_replace(lower(paragraph[pos]), '[^\p{L}]+', '', 'g') AS line
            FROM (SELECT origin, url_id, paragraph, unnest(range(1, len(paragraph) + 1)) AS pos FROM article WHERE origin IS NOT NULL)
            WHERE length(trim(paragraph[pos])) > 0),
        repeated AS (SELECT origin, line FROM lines GROUP BY 1, 2 HAVING count(DISTINCT url_id) >= 5)
        SELECT DISTINCT url_id, CAST(pos AS INTEGER) AS pos FROM lines JOIN repeated USING (origin, line)""",
    "p1_cleaned": r"""
        WITH lines AS (
            SELECT DISTINCT origin, url_id, pos, regexp_replace(lower(paragraph[pos]), '[^\p{L}]+', '', 'g') AS line
            FROM (SELECT origin, url_id, paragraph, unnest(range(1, len(paragraph) + 1)) AS pos FROM article WHERE origin IS NOT NULL)
            WHERE length(trim(paragraph[pos])) > 0),
        repeated AS (SELECT origin, line FROM lines GROUP BY 1, 2 HAVING count(DISTINCT url_id) >= 5),
        gone AS (SELECT origin, url_id, list(DISTINCT pos) AS pos FROM lines JOIN repeated USING (origin, line) GROUP BY 1, 2),
        kept AS (SELECT a.url_id, list_filter(a.paragraph, lambda p, i: NOT coalesce(list_contains(g.pos, i), false)) AS p FROM article a LEFT JOIN gone g ON a.url_id = g.url_id AND a.origin = g.origin)
        SELECT url_id, CAST(coalesce(len(p), 0) AS BIGINT) AS elements, CAST(coalesce(list_sum(list_transform(p, lambda x: coalesce(length(x), 0))), 0) AS BIGINT) AS characters FROM kept""",
    "p8_found": r"""
        WITH d AS (SELECT doc_id AS id, string_split_regex(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
        e AS (SELECT item_id AS id, string_split_regex(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM eval_item),
        dw AS (SELECT id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 13)) AS k FROM d)),
        ew AS (SELECT id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 13)) AS k FROM e))
        SELECT DISTINCT dw.id AS doc_id, ew.id AS item_id FROM dw JOIN ew USING (g)""",
}
