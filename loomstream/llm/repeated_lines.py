"""Lines repeated across one source's documents: distributed PrefixSpan over line-identifier sequences.

A document is the sequence of its lines; two lines are equal when their letters are (case, digits, spacing,
punctuation and other signs don't count). Level 1 of PrefixSpan counts, per source, the distinct documents of
each line; infrequent lines are dropped from the documents, whose remaining lines are numbered anew. Level k
projects: every occurrence of a frequent sequence is extended by the lines that follow it in its document, at most
`max_gap` places further (None: anywhere), and the extensions are counted again, until none is frequent. What is
deleted is all occurrences of frequent sequences, single lines included.

The state of a level is one row per sequence and place where it ends, so a document's lines are never copied. With
max_gap = 1 the sequences are blocks of lines that travel together and the state of a level is no larger than the
occurrences of level 1; without a bound it has every subsequence, as the method defines, which is exponential in the
length of a block.

Skew: counts go through distinct (source, line, document) rows, which hash evenly, then partial sums; in the joins
back to the occurrences the lines and sequences that are heavy (a bounded number) are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.session import skew_join, written

MIN_SUPPORT = 5


def line_key(line: Column) -> Column:
    """64-bit identifier of a line's letters; null for a null or blank line."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(F.length(F.trim(line)) > 0, F.xxhash64(letters))


def line_rows(df: DataFrame, source: str, doc: str, lines: str) -> DataFrame:
    """(source, doc, pos, line): null sources, documents and blank lines have no rows."""
    rows = df.filter(F.col(source).isNotNull() & F.col(doc).isNotNull()).select(
        F.col(source).alias("source"), F.col(doc).alias("doc"), F.posexplode(F.transform(lines, line_key)).alias("pos", "line")
    )
    return rows.filter(F.col("line").isNotNull())


def _supported(rows: DataFrame, item: str, min_support: int) -> DataFrame:
    """(source, item, support), written; a supported item is one with at least min_support documents."""
    distinct = rows.select("source", item, "doc").distinct()
    return written(distinct.groupBy("source", item).agg(F.count("*").alias("support")).filter(F.col("support") >= min_support), "supported")


def frequent_lines(df: DataFrame, source: str, doc: str, lines: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Level 1: (source, doc, pos, line, support) of every occurrence of a line in at least min_support documents."""
    rows = line_rows(df, source, doc, lines)
    return skew_join(rows, _supported(rows, "line", min_support), ["source", "line"], "support").distinct()


def sequence_occurrences(df: DataFrame, source: str, doc: str, lines: str, min_support: int = MIN_SUPPORT, max_gap: int | None = 1, max_length: int | None = None) -> DataFrame:
    """(source, doc, pos, length, sequence, support): where each frequent sequence of lines ends in each document.

    `sequence` is an identifier chained over its lines, `pos` the place of its last line. Lengths run from 1 until no
    sequence is frequent (or to max_length). A document delivered twice counts once. Empty tables and null line arrays
    give no rows; very long lines are hashed whole.
    """
    first = written(frequent_lines(df, source, doc, lines, min_support), "level")
    at = Window.partitionBy("source", "doc").orderBy("pos")
    base = written(first.select("source", "doc", "pos", "line", F.row_number().over(at).alias("at")), "projected")
    found = first.select("source", "doc", "pos", F.lit(1).alias("length"), F.col("line").alias("sequence"), "support")
    state = base.select("source", "doc", "at", F.col("line").alias("sequence"))
    length = 1
    while max_length is None or length < max_length:
        length += 1
        if max_gap == 1:
            step = state.select("source", "doc", (F.col("at") + 1).alias("at"), F.col("sequence").alias("prefix"))
            grown = step.join(base, ["source", "doc", "at"])
        else:
            step = state.select("source", "doc", F.col("at").alias("from"), F.col("sequence").alias("prefix"))
            near = F.col("at") > F.col("from")
            near = near if max_gap is None else near & (F.col("at") <= F.col("from") + max_gap)
            grown = step.join(base, ["source", "doc"]).filter(near)
        grown = written(grown.select("source", "doc", "pos", "at", F.xxhash64("prefix", "line").alias("sequence")).distinct(), "grown")
        frequent = _supported(grown, "sequence", min_support)
        if frequent.isEmpty():
            break
        kept = written(skew_join(grown, frequent, ["source", "sequence"], "support"), "level")
        found = found.unionByName(kept.select("source", "doc", "pos", F.lit(length).alias("length"), "sequence", "support"))
        state = kept.select("source", "doc", "at", "sequence")
    return found


def repeated_occurrences(df: DataFrame, source: str, doc: str, lines: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(source, doc, pos): the places that the mined sequences cover - what is to be deleted.

    The lines of a frequent sequence are frequent themselves and end sequences of their own, so the places where
    sequences of any length end are all places that they cover.
    """
    return sequence_occurrences(df, source, doc, lines, min_support).select("source", "doc", "pos").distinct()


def repeated_sequences(df: DataFrame, source: str, doc: str, lines: str, min_support: int = MIN_SUPPORT, max_gap: int | None = 1, max_length: int | None = None) -> DataFrame:
    """Frequent line sequences per source: (source, length, sequence, support)."""
    found = sequence_occurrences(df, source, doc, lines, min_support, max_gap, max_length)
    return found.select("source", "length", "sequence", "support").distinct()


def without_repeated_lines(df: DataFrame, source: str, doc: str, lines: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """df with the occurrences of frequent sequences taken out of the lines column.

    Rows without a source or document id are kept as they are; all other columns stay.
    """
    gone = repeated_occurrences(df, source, doc, lines, min_support).groupBy(F.col("source").alias("__source"), F.col("doc").alias("__doc")).agg(F.collect_set("pos").alias("__gone"))
    out = df.join(gone, (df[doc] == gone["__doc"]) & (df[source] == gone["__source"]), "left")
    kept = F.filter(F.col(lines), lambda _, i: ~F.array_contains("__gone", i))
    return out.withColumn(lines, F.when(F.col("__gone").isNull() | F.col(source).isNull(), F.col(lines)).otherwise(kept)).select(*df.columns)
