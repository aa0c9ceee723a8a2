"""Tables by name, and changes to them as rewrites: every function returns the new content; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstream.operators.aggregates import order_statistic
from loomstream.plans.query import Query


class Store:
    """Parquet tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def open(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def get(self, name: str, key: str, values: list | DataFrame) -> DataFrame:
        """Rows with these keys; missing keys are absent, repeated ones count once."""
        df = self.open(name)
        if isinstance(values, DataFrame):
            return df.join(values.select(key).distinct(), key, "left_semi")
        return df.filter(F.col(key).isin(list(dict.fromkeys(values)))) if values else df.limit(0)


def update(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with a change take the changed columns; keys without a row are ignored. Keys in `changes` are unique."""
    cols = [c for c in changes.columns if c != key]
    hit = changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in cols])
    out = df.join(hit, key, "left")
    return out.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def upsert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key; new keys are added."""
    return df.join(rows.select(key), key, "left_anti").select(*df.columns).unionByName(rows.select(*df.columns))


def insert_new(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Existing keys stay as they are; a new key is added once."""
    one = Window.partitionBy(key).orderBy(*[c for c in rows.columns if c != key])
    fresh = rows.join(df.select(key), key, "left_anti").withColumn("__n", F.row_number().over(one)).filter("__n = 1")
    return df.unionByName(fresh.select(*df.columns))


def set_field(df: DataFrame, key: str, value, name: str, new: Column) -> DataFrame:
    """One row's field set; a key that no row has is an error."""
    if df.filter(F.col(key) == value).isEmpty():
        raise KeyError(f"no row has {key} {value!r}")
    return df.withColumn(name, F.when(F.col(key) == value, new).otherwise(F.col(name)))


def put_urls(urls: DataFrame, wanted: DataFrame, key: str = "url", order: str = "ord", new_id: Column | None = None) -> DataFrame:
    """(ord, key, id, is_new) for every wanted row, in the order they came in: the id there is, or a new one, the same for repeats."""
    new_id = F.substring(F.sha2(F.col(key), 256), 1, 24) if new_id is None else new_id
    have = urls.groupBy(key).agg(F.min("id").alias("__id"))
    out = wanted.select(order, key).join(have, key, "left")
    return out.select(order, key, F.coalesce("__id", new_id).alias("id"), F.col("__id").isNull().alias("is_new"))


def create_table(spark: SparkSession, name: str, schema, path: str, buckets: int = 0) -> None:
    """An empty table of the schema's stored columns; with buckets, clustered by its primary key, so that lookups and joins by it don't shuffle."""
    from loomstream.sources.schemas import primary_key, stored

    writer = stored(spark.createDataFrame([], schema), schema).write.mode("errorifexists").option("path", path)
    if buckets:
        writer = writer.bucketBy(buckets, primary_key(schema)).sortBy(primary_key(schema))
    writer.saveAsTable(name)


def push(df: DataFrame, condition: Column, name: str, values: Column) -> DataFrame:
    """Append to an array field; null is an empty array."""
    old = F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType))
    return df.withColumn(name, F.when(condition, F.concat(old, values)).otherwise(F.col(name)))


def push_once(df: DataFrame, condition: Column, name: str, value: Column) -> DataFrame:
    return push(df, condition & ~F.coalesce(F.array_contains(name, value), F.lit(False)), name, F.array(value))


def delete(df: DataFrame, query: Query, key: str) -> DataFrame:
    """Without the rows the query selects; with a limit, without as many as it allows."""
    if query.count is None and not query.sorts:
        return df.filter(~F.coalesce(query.condition(df), F.lit(False)))
    return df.join(query.run(df).select(key), key, "left_anti")


def prune(df: DataFrame, keep: int, time: str, key: str, retain: str) -> DataFrame:
    """Retained rows and the newest others, `keep` in all; ties at the border stay.

    The border is an order statistic, looked up in the one range of times that holds it.
    """
    others = df.filter(~F.coalesce(F.col(retain), F.lit(False)))
    retained = df.filter(F.coalesce(F.col(retain), F.lit(False))).count()
    room = max(0, keep - retained)
    if not room:
        return df.filter(F.coalesce(F.col(retain), F.lit(False)))
    border = order_statistic(others, time, room - 1, descending=True).first()
    return df if border is None else df.filter(F.coalesce(F.col(retain), F.lit(False)) | (F.col(time) >= border[0]))


def cascade(urls: DataFrame, articles: DataFrame, links: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(urls, articles, links) without the bad URL ids, links in both directions."""
    ids = bad.select("id").distinct()
    a = articles.join(ids, articles.url_id == ids.id, "left_anti")
    k = links.join(ids, links.origin_url_id == ids.id, "left_anti").join(ids, links.destination_url_id == ids.id, "left_anti")
    return urls.join(ids, "id", "left_anti"), a, k
