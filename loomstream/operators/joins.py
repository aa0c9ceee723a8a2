"""Joins a content platform needs, as equi-joins that shuffle on their keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.functions.urls import host, suffixes
from loomstream.session import salted_join, written


def domain_suffix_join(rows: DataFrame, url: str, sites: DataFrame, domains: list[str], how: str = "left") -> DataFrame:
    """Each row with the site whose root or aka domain is the longest suffix of the URL's host.

    The suffixes of each distinct host are exploded and met by an equi-join with the sites' domains; `domains` are
    string or array columns of sites. Rows without a site have nulls ('left') or go ('inner'); columns of sites whose
    names the rows have too are left out. A domain that several sites claim belongs to the one first by its other columns.
    """
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) if sites.schema[c].dataType.typeName() == "array" else F.array(F.col(c)) for c in domains]
    extra = [c for c in sites.columns if c not in rows.columns]
    known = sites.select(F.explode(F.array_distinct(F.concat(*arrays))).alias("__domain"), *extra).filter("__domain is not null")
    known = first_wins(known, ["__domain"], [F.asc(c) for c in extra if not sites.schema[c].dataType.typeName() == "map"] or [F.asc("__domain")])
    hosts = rows.select(host(F.col(url)).alias("__host")).filter("__host is not null").distinct()
    tried = hosts.select("__host", F.posexplode(suffixes(F.col("__host"))).alias("__at", "__domain"))
    best = tried.join(known.select("__domain"), "__domain").groupBy("__host").agg(F.min_by("__domain", "__at").alias("__domain"))
    out = rows.withColumn("__host", host(F.col(url))).join(best, "__host", how)
    return out.join(known, "__domain", how).drop("__domain", "__host")


def default_rating(rows: DataFrame, ratings: DataFrame, key: str, rating: str, default: float, enough: Callable[[], Column]) -> DataFrame:
    """Rows with the rating of their key, or the default where it is missing or rests on too little."""
    good = ratings.select(key, F.when(enough(), F.col(rating)).alias("__r"))
    return rows.join(good, key, "left").withColumn(rating, F.coalesce("__r", F.lit(default))).drop("__r")


def shared_item_pairs(df: DataFrame, key: str, items: str, least: int, time: str | None = None, window: int = 0, salts: int = 8) -> DataFrame:
    """(key_a, key_b, shared) with key_a < key_b: rows with at least `least` common items, at most `window` apart in time.

    Two rows that share `least` items also share one that is not among the least - 1 most frequent items of either.
    So only the rarer items of each row enter the inverted index, and a frequent item meets itself only where rows
    have nothing rarer; rows carry their arrays, so that candidates are checked where they meet. With a window, rows meet by item and
    time bucket as well. Keys are unique; null keys, times and items have no part.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.array_distinct(items).alias("own"), (F.col(time) if time else F.lit(0)).cast("bigint").alias("t")).filter("t is not null")
    each = written(rows.select("k", "t", F.explode("own").alias("item")).filter("item is not null"), "items")
    often = each.groupBy("item").agg(F.count("*").alias("n"))
    ranked = salted_join(each, often, ["item"], salts=salts).groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("by"))
    ranked = written(ranked.select("k", "t", F.col("by.item").alias("by")).filter(F.size("by") >= least), "by_rarity")
    rare = ranked.select("k", "t", "by", F.explode(F.slice("by", F.lit(1), F.size("by") - (least - 1))).alias("item"))
    at = F.floor(F.col("t") / window) if window else F.lit(0)
    a = rare.select(F.col("k").alias("ka"), "item", at.alias("w"), F.col("t").alias("ta"), F.col("by").alias("ba"))
    b = rare.select(F.col("k").alias("kb"), "item", (F.explode(F.array(at, at - 1)) if window else at).alias("w"), F.col("t").alias("tb"), F.col("by").alias("bb"))
    met = a.join(b, ["item", "w"]).filter((F.col("tb") > F.col("ta")) | (F.col("tb") == F.col("ta")) & (F.col("ka") < F.col("kb")))
    if window:
        met = met.filter(F.col("tb") - F.col("ta") <= window)
    # a pair meets at each of its common rare items; it counts at the rarest, so nothing is to be made distinct
    both = met.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "item", F.array_intersect("ba", "bb").alias("common"))
    return both.filter((F.size("common") >= least) & (F.get("common", F.lit(0)) == F.col("item"))).select("key_a", "key_b", F.size("common").cast("bigint").alias("shared"))


def without_near(candidates: DataFrame, earlier: DataFrame, group: str, key: str, items: str, time: str, least: int, window: int) -> DataFrame:
    """Candidates that share fewer than `least` items, or are further than `window` away, from every earlier row of their group."""
    c = candidates.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(time).alias("t"), F.explode(F.array_distinct(items)).alias("item"))
    e = earlier.select(F.col(group).alias("g"), F.col(key).alias("ek"), F.col(time).alias("et"), F.explode(F.array_distinct(items)).alias("item"))
    near = c.join(e, ["g", "item"]).filter(F.abs(F.col("t") - F.col("et")) <= window).groupBy("g", "k", "ek").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return candidates.join(near.select(F.col("g").alias(group), F.col("k").alias(key)).distinct(), [group, key], "left_anti")


def conflict_anti_join(rows: DataFrame, tombstones: DataFrame, group: str, key: Column, kind: Column, closure: DataFrame) -> DataFrame:
    """Rows of a group without those that conflict with a tombstone: equal key, and kinds one of which is the other's ancestor.

    `closure` has (value, ancestor), each value its own ancestor too. The theta condition becomes an equi-join on
    (group, key, kind) with the kinds related to each tombstone's.
    """
    related = closure.select(F.col("value").alias("__k"), F.col("ancestor").alias("__other")).unionByName(closure.select(F.col("ancestor").alias("__k"), F.col("value").alias("__other"))).distinct()
    dead = tombstones.select(F.col(group), key.alias("__key"), kind.alias("__k")).join(related, "__k").select(group, "__key", F.col("__other").alias("__kind")).distinct()
    return rows.withColumn("__key", key).withColumn("__kind", kind).join(dead, [group, "__key", "__kind"], "left_anti").drop("__key", "__kind")


def prefix_anti_join(rows: DataFrame, name: str, existing: DataFrame, other: str, least: int = 1) -> DataFrame:
    """Rows whose name is no prefix of any existing name; names shorter than `least` are no prefix, null names stay.

    Existing names are exploded to all their prefixes and met by equality. Prefixes are as many as the name's letters,
    but only those that begin like some row's name are made: both sides meet on their first `least` letters before.
    """
    heads = rows.select(F.substring(name, 1, least).alias("__h"), F.length(name).alias("__n")).filter(F.col("__n") >= least)
    heads = heads.groupBy("__h").agg(F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    known = existing.select(F.col(other).alias("__e")).filter(F.length(other) >= least).distinct().withColumn("__h", F.substring("__e", 1, least))
    near = known.join(heads, "__h").withColumn("__hi", F.least("__hi", F.length("__e"))).filter("__lo <= __hi")
    starts = near.select(F.expr("explode(transform(sequence(__lo, __hi), n -> substring(__e, 1, n)))").alias(name)).distinct()
    return rows.join(starts, name, "left_anti").select(*rows.columns)


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(value, ancestor, distance) of a hierarchy, each value at distance 0 from itself; of several ways the shortest.

    Distances double from round to round on written tables, so a chain of n values takes log n rounds. A value that is
    its own ancestor is an error. Null parents and children are no edges.
    """
    up = edges.select(F.col(child).cast("string").alias("value"), F.col(parent).cast("string").alias("ancestor")).filter("ancestor is not null and value is not null").distinct()
    known = written(up.withColumn("distance", F.lit(1).cast("bigint")), "closure")
    before = known.count()
    while True:
        far = known.select("value", F.col("ancestor").alias("mid"), F.col("distance").alias("d")).join(known.select(F.col("value").alias("mid"), "ancestor", "distance"), "mid")
        far = far.select("value", "ancestor", (F.col("d") + F.col("distance")).alias("distance"))
        known = written(known.unionByName(far).groupBy("value", "ancestor").agg(F.min("distance").alias("distance")), "closure")
        if not known.filter("value = ancestor").isEmpty():
            raise ValueError("the hierarchy has a cycle")
        if (now := known.count()) == before:
            break
        before = now
    every = known.select(F.explode(F.array("value", "ancestor")).alias("value"))
    if child in edges.columns:
        every = every.unionByName(edges.select(F.col(child).cast("string").alias("value")).filter("value is not null"))
    own = every.distinct().select("value", F.col("value").alias("ancestor"), F.lit(0).cast("bigint").alias("distance"))
    return own.unionByName(known)


def descendants(closure_: DataFrame, value: str) -> DataFrame:
    """(value, distance): the values below one, itself included."""
    return closure_.filter(F.col("ancestor") == value).select("value", "distance")


def contained_elements_join(rows: DataFrame, array: str, element: str, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows exploded by an array of structs and joined where a field of the element equals the other side's key."""
    return rows.withColumn("__e", F.explode(array)).withColumn(key, F.col(f"__e.{element}")).join(other, key, how).drop("__e")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def branch_union(branches: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Union of branches; a key in several branches comes from the first."""
    out = None
    for i, b in enumerate(branches):
        b = b.withColumn("branch", F.lit(i))
        out = b if out is None else out.unionByName(b)
    return first_wins(out, [key], [F.col("branch"), *order])


def interleaved(streams: list[DataFrame], group: str, time: str, key: str) -> DataFrame:
    """Several streams of each group as one, newest first: (columns, source, rank); ties by source, then key."""
    out = None
    for i, s in enumerate(streams):
        s = s.withColumn("source", F.lit(i))
        out = s if out is None else out.unionByName(s)
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(time), "source", key)
    return out.withColumn("rank", F.row_number().over(order))


def range_lookup(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Rows with the range low <= value <= high that holds them, by an equi-join on buckets of `width`; rows without one are left out.

    Ranges are listed in every bucket they touch, so width is about that of a common range. Overlapping ranges give a row each.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    listed = ranges.withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    return rows.withColumn("__b", bucket(value)).join(listed, "__b").filter((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("__b")
