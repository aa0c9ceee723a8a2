"""Aggregations and per-group ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from loomstream.session import written

#: The 30 percentiles an empirical distribution is described by.
PERCENTILES = (0.0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 1.0)


def distribution(value: Column) -> Column:
    """array<struct<percentile, value>>: linear interpolation at (n - 1) p. No values give null.

    For groups of modest size, as one buffer holds a group's values; distributions() has no such bound.
    """
    q = F.percentile(value, F.array(*[F.lit(p) for p in PERCENTILES]))
    return F.transform(F.arrays_zip(F.array(*[F.lit(p) for p in PERCENTILES]).alias("p"), q.alias("v")), lambda z: F.struct(z["p"].alias("percentile"), z["v"].alias("value")))


def distributions(df: DataFrame, keys: list[str], value: Column, partitions: int = 0) -> DataFrame:
    """(keys, n, distribution): distribution() of every group, however large and uneven the groups are.

    Rows are range-partitioned by keys and value and counted per partition; the ranks that the percentiles ask for are
    looked up in the partitions that hold them, so no task sees more than its range and nothing goes to the driver.
    Null values are left out; groups without values have no row; the null key is a group.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(F.lit(0).alias("__0"), *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys, 1)])  # a struct of nulls equals itself
    rows = df.select(group.alias("__g"), value.cast("double").alias("__v")).filter("__v is not null")
    ranged = written(rows.repartitionByRange(n, "__g", "__v").withColumn("__p", F.spark_partition_id()), "ranges")
    counts = written(ranged.groupBy("__g", "__p").agg(F.count("*").alias("__c")), "counts")
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    points = counts.groupBy("__g").agg(F.sum("__c").alias("n")).select("__g", "n", F.explode(F.array(*[F.lit(p) for p in PERCENTILES])).alias("percentile"))
    points = points.withColumn("__at", (F.col("n") - 1) * F.col("percentile"))
    ranks = points.select("__g", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__rank")).distinct()
    placed = ranks.join(parts, "__g").filter("__rank >= __before and __rank < __before + __c").select("__g", "__p", "__rank", (F.col("__rank") - F.col("__before") + 1).alias("__n"))
    order = Window.partitionBy("__g", "__p").orderBy("__v")
    few = ranged.join(placed.select("__g", "__p").distinct(), ["__g", "__p"], "left_semi").withColumn("__n", F.row_number().over(order))
    found = written(few.join(placed, ["__g", "__p", "__n"]).select("__g", "__rank", "__v"), "ranks")
    low = points.withColumn("__rank", F.floor("__at")).join(found.withColumnRenamed("__v", "__low"), ["__g", "__rank"])
    both = low.withColumn("__rank", F.ceil("__at")).join(found.withColumnRenamed("__v", "__high"), ["__g", "__rank"])
    value_at = F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__at") - F.floor("__at"))
    out = both.groupBy("__g").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("percentile", value_at.alias("value")))).alias("distribution"))
    return out.select(*[F.col(f"__g.__{i}").alias(k) for i, k in enumerate(keys, 1)], "n", "distribution")


def project_quantile(dist: Column, x: Column) -> Column:
    """Quantile of x under a distribution: interpolated between the points around it; 0 below the first, 1 above the last."""
    around = F.struct(F.array_max(F.filter(dist, lambda z: z["value"] <= x)).alias("low"), F.array_min(F.filter(dist, lambda z: z["value"] >= x)).alias("high"))

    def between(s: Column) -> Column:
        low, high = s["low"], s["high"]
        span = high["value"] - low["value"]
        inside = F.when(span == 0, low["percentile"]).otherwise(low["percentile"] + (x - low["value"]) / span * (high["percentile"] - low["percentile"]))
        return F.when(high.isNull(), 1.0).when(low.isNull(), 0.0).otherwise(inside)

    once = F.get(F.transform(F.array(around), between), F.lit(0))  # the two points are looked up once
    return F.when(dist.isNull() | x.isNull(), None).otherwise(once)


def click_through(rows: DataFrame, keys: list[str], clicked: Column) -> DataFrame:
    """(keys, instances, clicks, rate)."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("instances"), F.count_if(clicked).alias("clicks"))
    return out.withColumn("rate", F.col("clicks") / F.col("instances"))


def rated(rates: DataFrame, rate: str = "rate", name: str = "rating") -> DataFrame:
    """Each row's rate as a quantile of all rows' rates; the distribution is a scalar subquery."""
    dist = distributions(rates, [], F.col(rate)).select("distribution").scalar()
    return rates.withColumn("__d", dist).withColumn(name, project_quantile(F.col("__d"), F.col(rate))).drop("__d")


def cumulative_buckets(rows: DataFrame, age: Column, ends: list[int], value: Column) -> DataFrame:
    """(end, n, distribution): every row counts for all ranges that end after its age; `ends` are few."""
    hit = rows.select(value.alias("v"), F.explode(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e > age)).alias("end"))
    sizes = hit.groupBy("end").agg(F.count("*").alias("n"))
    return sizes.join(distributions(hit, ["end"], F.col("v")).drop("n"), "end", "left")


def zero_filled(rows: DataFrame, key: str, dimension: DataFrame, aggs: list[Column]) -> DataFrame:
    """Aggregates per key with zeros for the keys of the dimension that have no rows."""
    out = rows.groupBy(key).agg(*aggs)
    return dimension.select(key).distinct().join(out, key, "left").fillna(0)


def histogram(rows: DataFrame, value: Column, buckets: int) -> DataFrame:
    """(bucket, n) over [0, 1]: 1.0 falls into the last bucket, what is outside into -1; empty buckets are listed."""
    b = F.when((value < 0) | (value > 1), F.lit(-1)).otherwise(F.least(F.floor(value * buckets), F.lit(buckets - 1))).cast("int")
    got = rows.select(b.alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    all_ = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return all_.join(got, "bucket", "full").fillna(0, ["n"])


def confusion(rows: DataFrame, label: Column, score: Column, cut: float = 0.5) -> DataFrame:
    yes = score >= cut
    out = rows.agg(
        F.count_if(label & yes).alias("true_positive"), F.count_if(label & ~yes).alias("false_negative"), F.count_if(~label & yes).alias("false_positive"), F.count_if(~label & ~yes).alias("true_negative")
    )
    good = F.col("true_positive") + F.col("true_negative")
    return out.withColumn("accuracy", F.try_divide(good, good + F.col("false_negative") + F.col("false_positive")))


def conditional_means(rows: DataFrame, values: list[str], flag: Column) -> DataFrame:
    """(name, overall, with_flag, without_flag) of several columns in one pass."""
    aggs = []
    for v in values:
        aggs.append(F.struct(F.lit(v).alias("name"), F.avg(v).alias("overall"), F.avg(F.when(flag, F.col(v))).alias("with_flag"), F.avg(F.when(~flag, F.col(v))).alias("without_flag")))
    return rows.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def separation(rows: DataFrame, flag: Column, output: Column) -> DataFrame:
    """(divider, separation): divider = (3 mean of flagged + mean of others) / 4; distances from it on the right side summed."""
    s = rows.agg(
        F.avg(F.when(flag, output)).alias("hi"), F.avg(F.when(~flag, output)).alias("lo"), F.sum(F.when(flag, output).otherwise(-output)).alias("signed"),
        F.count_if(flag).alias("np"), F.count_if(~flag).alias("nn"),
    )
    divider = (3 * F.col("hi") + F.col("lo")) / 4
    return s.select(divider.alias("divider"), (F.col("signed") + divider * (F.col("nn") - F.col("np"))).alias("separation"))


def band_accuracy(rows: DataFrame, good: Column, score: Column) -> DataFrame:
    """(good_upper, bad_lower, n): good rows in the upper half of the score range, bad ones in the lower, in quarters of it."""
    x = rows.select(good.alias("g"), score.alias("s"), rows.agg(F.min(score)).scalar().alias("__lo"), rows.agg(F.max(score)).scalar().alias("__hi"))
    band = F.least(F.floor(F.try_divide(F.col("s") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * 4), F.lit(3))
    return x.select("g", band.alias("b")).agg(F.count_if(F.col("g") & (F.col("b") >= 2)).alias("good_upper"), F.count_if(~F.col("g") & (F.col("b") < 2)).alias("bad_lower"), F.count("*").alias("n"))


def pair_quality(pairs_found: DataFrame, pairs_true: DataFrame) -> DataFrame:
    """(tp, fp, fn, score) of unordered pairs (a, b): 10 tp - (5 fn + 2 fp), each pair counted in both directions."""
    f, t = pairs_found.select("a", "b").distinct().withColumn("f", F.lit(1)), pairs_true.select("a", "b").distinct().withColumn("t", F.lit(1))
    m = f.join(t, ["a", "b"], "full").agg(*[F.count_if(c).alias(n) for c, n in ((F.col("f").isNotNull() & F.col("t").isNotNull(), "tp"), (F.col("t").isNull(), "fp"), (F.col("f").isNull(), "fn"))])
    return m.withColumn("score", 2 * (10 * F.col("tp") - (5 * F.col("fn") + 2 * F.col("fp"))))


def relevance(articles: DataFrame, element: str) -> DataFrame:
    """(element, feature_id, sum, count, through): features of the articles whose keywords have the element; distinct per article."""
    k = articles.select("url_id", "published_time", F.explode(F.array_distinct(F.transform("keyword", lambda x: F.lower(x[element])))).alias(element), "feature")
    f = k.select("url_id", element, "published_time", F.inline("feature"))
    return f.groupBy(element, "feature_id").agg(F.sum("similarity").alias("sum"), F.count("similarity").alias("count"), F.max("published_time").alias("through"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_list(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n keys of largest value, ties by key."""
    return df.groupBy(key).agg(F.max(value).alias(value)).orderBy(F.desc(value), F.asc(key)).limit(n)


def order_statistic(df: DataFrame, value: str, rank: int, descending: bool = False, partitions: int = 0) -> DataFrame:
    """(value): the value at a 0-based rank, nulls left out; no row when the rank is beyond the end.

    Rows are range-partitioned and counted per partition; only the partition that holds the rank is ordered, so no
    task sees more than its range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc(value) if descending else F.asc(value)
    rows = df.select(value).filter(F.col(value).isNotNull())
    ranged = written(rows.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id()), "ranges")
    for part, count in sorted((r[0], r[1]) for r in ranged.groupBy("__p").count().collect()):  # one row a partition
        if rank < count:
            return ranged.filter(F.col("__p") == part).orderBy(order).offset(rank).limit(1).select(value)
        rank -= count
    return rows.limit(0)


def in_ranges(df: DataFrame, keys: list[str], order: list[Column], partitions: int = 0) -> DataFrame:
    """Rows with __g (their keys) and __p, written: range-partitioned by keys and order, so that a heavy key lies in many
    partitions, one after the other. Windows over (__g, __p) and what is stitched over __g in the order of __p see no key whole."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(F.lit(0).alias("__0"), *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys, 1)])  # a struct of nulls equals itself
    return written(df.withColumn("__g", group).repartitionByRange(n, "__g", *order).withColumn("__p", F.spark_partition_id()), "ranges")


def _ranges_of_key(first: int, last: int) -> WindowSpec:
    """Over the ranges of a key, from `first` to `last` places away."""
    return Window.partitionBy("__g").orderBy("__p").rowsBetween(first, last)


def islands(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str = "island", partitions: int = 0) -> DataFrame:
    """Number of each run of equal values in the order of a group (nulls are equal), counted over ranges and stitched."""
    w = Window.partitionBy("__g", "__p").orderBy(*order)
    ranged = in_ranges(df.withColumn("__v", F.struct(value.alias("v"))), keys, order, partitions)
    rows = ranged.withColumn("__new", (~F.col("__v").eqNullSafe(F.coalesce(F.lag("__v").over(w), F.col("__v")))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    ends = rows.groupBy("__g", "__p").agg(F.min_by("__v", F.struct(*order)).alias("__first"), F.max_by("__v", F.struct(*order)).alias("__last"), F.sum("__new").alias("__inner"))
    border = (~F.col("__first").eqNullSafe(F.lag("__last").over(Window.partitionBy("__g").orderBy("__p")))).cast("int")
    ends = ends.withColumn("__border", border)
    ends = ends.select("__g", "__p", (F.col("__border") + F.coalesce(F.sum(F.col("__inner") + F.col("__border")).over(_ranges_of_key(Window.unboundedPreceding, -1)), F.lit(0))).alias("__base"))
    out = rows.join(ends, ["__g", "__p"]).withColumn(name, F.col("__base") + F.col("__run"))
    return out.select(*df.columns, name)


def followed_by(df: DataFrame, keys: list[str], order: list[Column], event: Column, name: str, partitions: int = 0) -> DataFrame:
    """Whether the event happens at the row or later in its group (gap-fill backwards), within its range or a later one; never across groups."""
    ranged = in_ranges(df.withColumn("__e", F.coalesce(event.cast("int"), F.lit(0))), keys, order, partitions)
    w = Window.partitionBy("__g", "__p").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ends = ranged.groupBy("__g", "__p").agg(F.max("__e").alias("__any")).select("__g", "__p", F.coalesce(F.max("__any").over(_ranges_of_key(1, Window.unboundedFollowing)), F.lit(0)).alias("__later"))
    out = ranged.withColumn("__here", F.max("__e").over(w)).join(ends, ["__g", "__p"])
    return out.withColumn(name, F.greatest("__here", "__later") == 1).select(*df.columns, name)


def last_times(df: DataFrame, key: str, time: str, n: int = 5, apart: int = 3_600_000, partitions: int = 0) -> DataFrame:
    """(key, times): the newest n times of each key that come more than `apart` after the time before, newest first."""
    ranged = in_ranges(df.select(key, time).filter(F.col(time).isNotNull()), [key], [F.col(time)], partitions)
    w = Window.partitionBy("__g", "__p").orderBy(time)
    ends = ranged.groupBy("__g", "__p").agg(F.max(time).alias("__last")).select("__g", "__p", F.max("__last").over(_ranges_of_key(Window.unboundedPreceding, -1)).alias("__before"))
    rows = ranged.withColumn("__b", F.lag(time).over(w)).join(ends, ["__g", "__p"]).withColumn("__b", F.coalesce("__b", "__before"))
    few = top_per_group(rows.filter(F.col("__b").isNull() | (F.col(time) - F.col("__b") > apart)).select(key, time), [key], [F.desc(time)], n)
    return few.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(time))).alias("times"))


def every_nth(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "holdback", partitions: int = 0) -> DataFrame:
    """Marks rows 1, n + 1, 2 n + 1 ... of each group."""
    ranged = in_ranges(df, keys, order, partitions)
    ends = ranged.groupBy("__g", "__p").agg(F.count("*").alias("__c")).select("__g", "__p", F.coalesce(F.sum("__c").over(_ranges_of_key(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__g", "__p").orderBy(*order))
    out = ranged.withColumn("__at", at).join(ends, ["__g", "__p"])
    return out.withColumn(name, (F.col("__at") + F.col("__before") - 1) % n == 0).select(*df.columns, name)


def best_of_islands(df: DataFrame, keys: list[str], order: list[Column], value: Column, depth: Column, tie: str) -> DataFrame:
    """Of each run of equal values in a group's order the row of greatest depth (ties by `tie`), with `island` and the run's `length`."""
    runs = islands(df, keys, order, value)
    w = Window.partitionBy(*keys, "island")
    ranked = runs.withColumn("length", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(depth.desc_nulls_last(), F.asc(tie))))
    return ranked.filter("__n = 1").drop("__n")


def applicable(df: DataFrame, keys: list[str], time: str, tie: str, click: str, now: int, after: int = 172_800_000, fresh: int = 28_800_000) -> DataFrame:
    """Rows that teach: clicked ones, those before a click of their group, and those after its last click that lie
    less than `after` from that click and were made less than `fresh` before `now`. Groups without a click have none."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    later = F.count_if(F.col(click).isNotNull()).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)) > 0
    last = F.last(click, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tail = F.coalesce((F.abs(F.col(time) - last) < after) & (F.lit(now) - F.col(time) < fresh), F.lit(False))
    return df.withColumn("__keep", later | tail).filter("__keep").drop("__keep")
