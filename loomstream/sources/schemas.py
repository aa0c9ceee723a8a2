"""Schemas with annotations in the field metadata, and what follows from them: validation, JSON and document forms.

Metadata keys: storage (STANDARD, PRIMARY_KEY, INDEX, UNIQUE_INDEX, DO_NOT_STORE), required, max_len, enum, and
client (INCLUDE, INCLUDE_AS_NUMBER, EXCLUDE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def note(name: str, kind: T.DataType, **meta) -> T.StructField:
    return T.StructField(name, kind, True, meta)


KEYWORD = T.StructType([
    note("keyword", T.StringType(), required=True, max_len=767, storage="INDEX"), note("strength", T.IntegerType()), note("type", T.StringType()),
    note("source", T.StringType(), client="EXCLUDE"), note("paragraph_number", T.IntegerType(), client="EXCLUDE"),
])
ENGAGEMENT = T.StructType([
    note("site", T.StringType(), enum=["FACEBOOK", "TWITTER"]), note("share_count", T.LongType()), note("share_score", T.DoubleType()), note("like_count", T.LongType()),
    note("comment_count", T.LongType()), note("create_time", T.LongType()),
])
FEATURE = T.StructType([note("feature_id", T.IntegerType(), required=True, storage="INDEX"), note("similarity", T.DoubleType())])
ARTICLE = T.StructType([
    note("url_id", T.StringType(), storage="PRIMARY_KEY", required=True, max_len=24), note("url", T.StringType(), required=True, max_len=767, storage="INDEX"),
    note("title", T.StringType(), max_len=256), note("type", T.StringType()), note("author", T.StringType()), note("origin", T.StringType()), note("copyright", T.StringType()),
    note("description", T.StringType(), max_len=2048), note("image_url", T.StringType()), note("paragraph", T.ArrayType(T.StringType()), client="EXCLUDE"),
    note("published_time", T.LongType(), storage="INDEX"), note("modified_time", T.LongType()), note("crawl_time", T.LongType(), client="INCLUDE_AS_NUMBER"), note("word_count", T.LongType()),
    note("keyword", T.ArrayType(KEYWORD)), note("social_engagement", T.ArrayType(ENGAGEMENT)), note("feature", T.ArrayType(FEATURE)), note("deduping_stems", T.ArrayType(T.StringType()), client="EXCLUDE"),
    note("retain", T.BooleanType(), client="EXCLUDE"), note("score", T.DoubleType(), storage="DO_NOT_STORE"), note("hot_count", T.IntegerType(), storage="DO_NOT_STORE"),
])
URL = T.StructType([
    note("id", T.StringType(), storage="PRIMARY_KEY", required=True, max_len=24), note("url", T.StringType(), storage="UNIQUE_INDEX", required=True, max_len=767),
    note("origin_url", T.StringType()), note("discovery_time", T.LongType()), note("last_crawl_start_time", T.LongType(), storage="INDEX"),
    note("last_crawl_finish_time", T.LongType()), note("crawl_priority", T.LongType(), storage="INDEX"),
])
LINK = T.StructType([note(n, T.StringType(), required=True, max_len=24, storage="INDEX") for n in ("origin_url_id", "destination_url_id")] + [note(n, T.LongType()) for n in ("discovery_time", "last_found_time")])
USER_ACTION = T.StructType([
    note("id", T.StringType(), storage="PRIMARY_KEY", required=True), note("user_id", T.StringType(), required=True, storage="INDEX"), note("action_type", T.StringType(), required=True),
    note("url_id", T.StringType()), note("url", T.StringType()), note("create_time", T.LongType()), note("read_start_time", T.LongType()), note("read_end_time", T.LongType()),
])
TABLES = {"article": ARTICLE, "url": URL, "url_link": LINK, "user_action": USER_ACTION}


def primary_key(schema: T.StructType) -> str | None:
    keys = [f.name for f in schema if f.metadata.get("storage") == "PRIMARY_KEY"]
    if len(keys) > 1:
        raise ValueError(f"more than one primary key: {keys}")
    return keys[0] if keys else None


def indexed_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    out: list[str] = []
    for f in schema:
        if f.metadata.get("storage") in ("INDEX", "UNIQUE_INDEX"):
            out.append(prefix + f.name)
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType):
            out += indexed_paths(kind, f"{prefix}{f.name}.")
    return out


def field_type(schema: T.StructType, path: str) -> T.DataType:
    """Type of a dotted path; arrays of structs are walked through."""
    at: T.DataType = schema
    for part in path.split("."):
        at = at.elementType if isinstance(at, T.ArrayType) else at
        if not isinstance(at, T.StructType) or part not in at.fieldNames():
            raise ValueError(f"no such field: {path}")
        at = at[part].dataType
    return at


_PYTHON = {"string": str, "bigint": int, "int": int, "double": (int, float), "boolean": bool}


def accepts(schema: T.StructType, path: str, value) -> bool:
    """Whether a value fits the field: a list for repeated fields, a dict for structs, an enum's name for enums."""
    kind = field_type(schema, path)
    top = schema[path.split(".")[0]]

    def fits(v, k: T.DataType) -> bool:
        if isinstance(k, T.ArrayType):
            return isinstance(v, list) and all(fits(x, k.elementType) for x in v)
        if isinstance(k, T.StructType):
            return isinstance(v, dict) and all(n in k.fieldNames() and fits(x, k[n].dataType) for n, x in v.items())
        ok = isinstance(v, _PYTHON[k.simpleString()])
        return ok and not (isinstance(v, bool) and k.simpleString() != "boolean")

    return fits(value, kind) and ("enum" not in top.metadata or value in top.metadata["enum"])


def violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with `violation`: the first rule a row breaks (required, max_len, enum, nested ones included), or null."""

    def rules(s: T.StructType, label: str) -> list[tuple[str, object]]:
        """(reason, test of the struct given as a function from field name to column)."""
        out: list[tuple[str, object]] = []
        for f in s:
            name, meta = f"{label}{f.name}", f.metadata
            if meta.get("required"):
                out.append((f"{name} is required", _test(f.name, lambda c: c.isNull())))
            if "max_len" in meta:
                out.append((f"{name} is too long", _test(f.name, _longer(meta["max_len"]))))
            if "enum" in meta:
                out.append((f"{name} is unknown", _test(f.name, _outside(meta["enum"]))))
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                out += [(reason, _test(f.name, _any_element(test))) for reason, test in rules(f.dataType.elementType, f"{name}.")]
        return out

    present = set(df.columns)
    found = [F.when(F.coalesce(test(F.col), F.lit(False)), F.lit(reason)) for reason, test in rules(T.StructType([f for f in schema if f.name in present]), "")]
    return df.withColumn("violation", F.coalesce(*found, F.lit(None).cast("string")))


def _test(name: str, of):
    return lambda at: of(at(name))


def _longer(n: int):
    return lambda c: F.length(c) > n


def _outside(values: list):
    return lambda c: ~c.isin(values)


def _any_element(test):
    return lambda c: F.exists(c, lambda x: F.coalesce(test(lambda name: x[name]), F.lit(False)))


def stored(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Without transient columns; empty arrays become null, as they are not kept."""
    cols = [f for f in schema if f.name in df.columns and f.metadata.get("storage") != "DO_NOT_STORE"]
    return df.select(*[F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in cols])


def to_json(schema: T.StructType) -> Column:
    """Client JSON of a row: excluded fields left out, 64-bit integers as strings unless INCLUDE_AS_NUMBER, no nulls or empty arrays."""

    def shape(f: T.StructField, c: Column) -> Column:
        if isinstance(f.dataType, T.LongType) and f.metadata.get("client") != "INCLUDE_AS_NUMBER":
            return c.cast("string")
        if isinstance(f.dataType, T.StructType):
            return F.struct(*[shape(x, c[x.name]).alias(x.name) for x in f.dataType if x.metadata.get("client") != "EXCLUDE"])
        if isinstance(f.dataType, T.ArrayType):
            inner = T.StructField(f.name, f.dataType.elementType, True, f.metadata)
            return F.when(F.size(c) > 0, F.transform(c, lambda x: shape(inner, x)))
        return c

    cols = [shape(f, F.col(f.name)).alias(f.name) for f in schema if f.metadata.get("client") != "EXCLUDE" and f.metadata.get("storage") != "DO_NOT_STORE"]
    return F.to_json(F.struct(*cols))


def to_document(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(_id, document): the stored form with the primary key as _id."""
    key = primary_key(schema)
    kept = stored(df, schema)
    return kept.select(F.col(key).alias("_id"), F.to_json(F.struct(*[c for c in kept.columns if c != key])).alias("document"))


def from_document(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Back from to_document(); unknown fields are ignored, missing ones are null."""
    key = primary_key(schema)
    rest = T.StructType([f for f in schema if f.name != key and f.metadata.get("storage") != "DO_NOT_STORE"])
    return df.select(F.col("_id").alias(key), F.from_json("document", rest).alias("d")).select(key, "d.*")


def from_rows(df: DataFrame, schema: T.StructType, blob: str, pulled: list[str]) -> DataFrame:
    """Messages of rows that keep a JSON blob beside pulled-out columns: the columns win, a null column clears its field.

    Has `violation`, the first rule a message breaks, or null; a blob that can't be read has only the pulled fields.
    """
    kept = T.StructType([f for f in schema if f.metadata.get("storage") != "DO_NOT_STORE"])
    read = df.withColumn("__m", F.from_json(blob, kept))
    out = read.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in pulled else F.col(f"__m.{f.name}").alias(f.name) for f in kept])
    return violations(out, schema)
