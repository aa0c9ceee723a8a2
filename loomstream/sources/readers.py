"""Readers of the formats the data comes in, and the sinks it goes to."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False) -> DataFrame:
    """RFC-4180 CSV: quoted fields with commas, doubled quotes and line ends; blank lines are dropped (read_csv_lines keeps them)."""
    r = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("header", header)
    return (r.schema(schema) if schema else r).csv(path)


def read_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, fields): every line of CSV files as an array, a blank line as one empty field.

    Carriage returns are ignored, quoted fields may hold line ends and doubled quotes. Each file is one row while it is
    split, so this is for files of modest size.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("v"))
    whole = whole.withColumn("v", F.regexp_replace("v", "\n$", ""))
    # a line or field ends where an even number of quotes follows it to the end
    even = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    lines = whole.select("file", F.posexplode(F.split("v", "\n" + even)).alias("line", "v"))
    plain = lambda f: F.regexp_replace(F.when(f.rlike(r'^"(?s:.*)"$'), F.substring(f, 2, F.length(f) - 2)).otherwise(f), '""', '"')
    return lines.select("file", "line", F.transform(F.split("v", "," + even), plain).alias("fields"))


def read_lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(value): the lines of text files; with `comments`, blank lines and those that begin with // are left out."""
    lines = spark.read.text(path)
    return lines.filter(~F.trim("value").startswith("//") & (F.trim("value") != "")) if comments else lines


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(link): entries of RSS and Atom files: the link's href, else its text, else the guid."""
    schema = "link array<struct<_VALUE string, _href string>>, guid string"
    both = [spark.read.format("xml").option("rowTag", tag).schema(schema).load(path) for tag in ("item", "entry")]
    rows = reduce(DataFrame.unionByName, both)
    href = F.get(F.filter(F.transform("link", lambda x: x["_href"]), lambda x: x.isNotNull()), F.lit(0))
    text = F.get(F.filter(F.transform("link", lambda x: F.trim(x["_VALUE"])), lambda x: x != ""), F.lit(0))
    return rows.select(F.coalesce(href, text, F.trim("guid")).alias("link")).filter("link is not null")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(company, title, start, end): positions of profile XML, open-ended ones first, then by end, latest first."""
    schema = "company struct<name string>, title string, `start-date` struct<year int, month int>, `end-date` struct<year int, month int>"
    rows = spark.read.format("xml").option("rowTag", "position").schema(schema).load(path)
    months = lambda c: F.col(f"`{c}`.year") * 12 + F.coalesce(F.col(f"`{c}`.month"), F.lit(1))
    out = rows.select(F.col("company.name").alias("company"), "title", months("start-date").alias("start"), months("end-date").alias("end"))
    return out.orderBy(F.desc_nulls_first("end"), F.desc_nulls_last("start"), "company")


def instance_types(lines: DataFrame) -> DataFrame:
    """(topic, subtopic, type) of N-Triples lines `<subject> <predicate> <type> .`; a subject `Name_(kind)` has a subtopic."""
    triple = r"^<[^>]*/([^/>]+)> <[^>]*> <[^>]*[/#]([^/#>]+)> \."
    name = F.translate(F.try_url_decode(F.regexp_extract("value", triple, 1)), "_", " ")
    kind = F.regexp_extract("value", triple, 2)
    out = lines.select(name.alias("name"), kind.alias("type")).filter("type <> ''")
    parts = r"^(.*?)\s*\(([^)]*)\)$"
    sub = F.regexp_extract("name", parts, 2)
    return out.select(F.when(sub != "", F.regexp_extract("name", parts, 1)).otherwise(F.col("name")).alias("topic"), F.when(sub != "", sub).alias("subtopic"), "type")


def long_abstracts(lines: DataFrame, max_name: int = 255, max_text: int = 65_535) -> DataFrame:
    """(article_name, text) of N-Quads lines with an English literal; overlong and repeated names are dropped."""
    quad = r'^<[^>]*/([^/>]+)> <[^>]*> "(.*)"@en '
    rows = lines.select(F.regexp_extract("value", quad, 1).alias("article_name"), F.regexp_extract("value", quad, 2).alias("text"))
    rows = rows.filter((F.col("article_name") != "") & (F.length("article_name") < max_name) & (F.length("text") < max_text))
    return rows.groupBy("article_name").agg(F.min("text").alias("text"))


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key the table doesn't have yet, each key once (resumable import)."""
    fresh = incoming.join(existing.select(key).distinct(), key, "left_anti")
    rest = [c for c in incoming.columns if c != key]
    return fresh.groupBy(key).agg(*[F.min(c).alias(c) for c in rest]).select(*incoming.columns)


def ner_lines(lines: DataFrame, kind: str) -> DataFrame:
    """(value, valid): only tags of one kind are kept in `<START:kind> ... <END>` text; valid when tags pair up without nesting."""
    other = r"<START:(?!" + re.escape(kind) + r">)[^>]+>\s*(.*?)\s*<END>"
    starts, ends = F.regexp_count("value", F.lit(r"<START:[^>]+>")), F.regexp_count("value", F.lit("<END>"))
    nested = F.col("value").rlike(r"<START:[^>]+>(?:(?!<END>).)*<START:")
    return lines.select(F.regexp_replace("value", other, "$1").alias("value"), ((starts == ends) & ~nested).alias("valid"))


_TOKEN = re.compile(r'\s*(?:#[^\n]*|([A-Za-z_]\w*)|([{}:])|"((?:[^"\\]|\\.)*)"|(-?\d+\.\d*|-?\d+))')


def parse_text_proto(text: str) -> dict[str, list]:
    """Text-format message: every field is a list of values; nested messages are dicts of the same form."""
    tokens: list[tuple[str, object]] = []
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read at {text[at : at + 30]!r}")
        at = m.end()
        if m[1]:
            tokens.append(("name", m[1]))
        elif m[2]:
            tokens.append((m[2], m[2]))
        elif m[3] is not None:
            tokens.append(("value", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[3])))
        elif m[4]:
            tokens.append(("value", float(m[4]) if "." in m[4] else int(m[4])))

    def message(i: int, depth: int) -> tuple[dict[str, list], int]:
        out: dict[str, list] = {}
        while i < len(tokens):
            kind, what = tokens[i]
            if kind == "}":
                if not depth:
                    raise ValueError("a brace too many")
                return out, i + 1
            if kind != "name":
                raise ValueError(f"a field was expected, not {what!r}")
            i += 1
            if i < len(tokens) and tokens[i][0] == ":":
                i += 1
            if i < len(tokens) and tokens[i][0] == "{":
                value, i = message(i + 1, depth + 1)
            else:
                k, value = tokens[i]
                value = {"true": True, "false": False}.get(value, value) if k == "name" else value
                i += 1
            out.setdefault(str(what), []).append(value)
        if depth:
            raise ValueError("a brace is missing")
        return out, i

    return message(0, 0)[0]


MANIFEST_SCHEMA = (
    "short_name string, root_domain string, aka_root_domain array<string>, start_url array<string>, subdomain_blacklist array<string>, "
    "path_blacklist array<struct<needle string, location string>>, paragraph_selector array<string>, "
    "article_url_pattern array<struct<subdomain string, path_regex string, query_regex string>>, whitelisted_query_parameter array<string>, rss_url array<string>, is_https boolean"
)


PERSONA_SCHEMA = (
    "name string, email string, good_url array<string>, bad_url array<string>, linked_in_contact_name array<string>, address_book_contact_name array<string>, "
    "interest array<struct<type string, industry_code bigint, keyword string>>"
)


def personas(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """One row per persona in text format: who they are, which pages they call good or bad, and their interests. A name and an e-mail address are required."""
    rows = []
    for text in texts:
        m = parse_text_proto(text)
        if not m.get("name") or not m.get("email"):
            raise ValueError("a persona has a name and an email")
        interests = [(x.get("type", [None])[0], x.get("industry_code", [None])[0], x.get("entity", [{}])[0].get("keyword", [None])[0]) for x in m.get("interest", [])]
        rows.append((m["name"][0], m["email"][0], *(m.get(k, []) for k in ("good_url", "bad_url", "linked_in_contact_name", "address_book_contact_name")), interests))
    return spark.createDataFrame(rows, PERSONA_SCHEMA)


def manifests(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """One row per site manifest in text format; a handful of configuration files, read on the driver."""
    rows = []
    for text in texts:
        m = parse_text_proto(text)
        one = lambda k, m=m: m.get(k, [None])[0]
        sub = lambda k, names, m=m: [{n: x.get(n, [None])[0] for n in names} for x in m.get(k, [])]
        places = [x | {"location": x["location"] or "STARTS_WITH"} for x in sub("path_blacklist", ("needle", "location"))]
        rows.append((one("short_name"), one("root_domain"), m.get("aka_root_domain", []), m.get("start_url", []), m.get("subdomain_blacklist", []), places, m.get("paragraph_selector", []),
                     sub("article_url_pattern", ("subdomain", "path_regex", "query_regex")), m.get("whitelisted_query_parameter", []), m.get("rss_url", []), bool(one("is_https"))))
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)


def json_urls(raw: Column, base: str) -> Column:
    """URLs of an API answer `{"items": [{"slug": ..., "date": "yyyy-mm-dd..."}]}`: base/yyyy/mm/dd/slug."""
    items = F.from_json(raw, "items array<struct<slug string, date string>>")["items"]
    return F.transform(F.filter(items, lambda x: x["slug"].isNotNull()), lambda x: F.concat_ws("/", F.lit(base), F.translate(F.substring(x["date"], 1, 10), "-", "/"), x["slug"]))


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def each_batch(df: DataFrame, deliver, checkpoint: str):
    """A stream delivered batch by batch to deliver(df, batch id) until the input is used up."""
    return df.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_side_table(df: DataFrame, path: str) -> None:
    """A vector, distribution or normaliser table as gzip-compressed Parquet, replacing what is there."""
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def read_side_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read back with the schema it must have: a column that is missing is null, others are left out."""
    return spark.read.schema(schema).parquet(path)
