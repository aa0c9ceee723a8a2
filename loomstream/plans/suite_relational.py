"""Predicates, sorts, sets, joins, aggregates and windows over the news and sales tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstream.functions import urls
from loomstream.operators import aggregates as A
from loomstream.operators import joins as J
from loomstream.plans.query import Query
from loomstream.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- predicates (P), sorts and limits (T)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def flt_equals(s, d):
    return Query().where_equals("c_mktsegment", ["BUILDING", "MACHINERY"]).run(table(s, d, "customer", "c_custkey", "c_mktsegment"))


@query("SELECT c_custkey FROM customer WHERE false")
def flt_equals_nothing(s, d):
    return Query().where_equals("c_mktsegment", []).run(table(s, d, "customer", "c_custkey", "c_mktsegment")).select("c_custkey")


@query("SELECT id, action_type FROM user_action WHERE url NOT IN ('x') AND action_type NOT IN ('SCROLL_PAST', 'READ_ARTICLE')")
def flt_not_equals(s, d):
    q = Query().where_not_equals("url", "x").where_not_equals("action_type", ["SCROLL_PAST", "READ_ARTICLE"]).where_not_equals("id", [])
    return q.run(table(s, d, "user_action", "id", "url", "action_type")).select("id", "action_type")


@query("SELECT id, url FROM user_action WHERE url IS NULL OR url <> 'x'")
def flt_not_equals_document(s, d):
    return Query(dialect="document").where_not_equals("url", "x").run(table(s, d, "user_action", "id", "url"))


@query("SELECT url_id, origin FROM article WHERE lower(origin) IN ('copperwire', 'the daily quern')")
def flt_equals_ignore_case(s, d):
    return Query().where_equals_ignore_case("origin", ["COPPERWIRE", "The Daily Quern"]).run(table(s, d, "article", "url_id", "origin"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F') AND o_custkey NOT IN (1, 2, 3)")
def flt_numbers_and_enums(s, d):
    q = Query().where_equals("o_orderstatus", "F").where_not_equals("o_custkey", [1, 2, 3])
    return q.run(table(s, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey")).drop("o_custkey")


@query("SELECT url_id, word_count FROM article WHERE word_count > 200 AND word_count <= 400 AND published_time >= 1400000000000 AND published_time < 1450000000000")
def flt_ranges(s, d):
    q = Query().where_greater("word_count", 200).where_at_most("word_count", 400).where_at_least("published_time", 1400000000000).where_less("published_time", 1450000000000)
    return q.run(table(s, d, "article", "url_id", "word_count", "published_time")).drop("published_time")


@query("SELECT url_id, title FROM article WHERE title LIKE 'Why %' AND title NOT LIKE '%risky' AND title ILIKE '%THINKS%' AND NOT title ILIKE '%SCHOOL%'")
def flt_like(s, d):
    q = Query().where_like("title", "Why %").where_not_like("title", "%risky").where_ilike("title", "%THINKS%").where_not_ilike("title", "%SCHOOL%")
    return q.run(table(s, d, "article", "url_id", "title"))


@query("SELECT short_name, CASE WHEN is_https THEN 'yes' ELSE 'not true' END AS https FROM site_manifest WHERE is_https OR is_https IS NOT TRUE")
def flt_booleans(s, d):
    m = table(s, d, "site_manifest", "short_name", "is_https")
    yes, no = Query().where_true("is_https").run(m), Query().where_not_true("is_https").run(m)
    return yes.select("short_name", F.lit("yes").alias("https")).unionByName(no.select("short_name", F.lit("not true").alias("https")))


@query("SELECT url_id FROM trained_article_classification WHERE checked = false UNION ALL SELECT url_id FROM trained_article_classification WHERE checked IS DISTINCT FROM false")
def flt_false(s, d):
    t = table(s, d, "trained_article_classification", "url_id", "checked")
    return Query().where_false("checked").run(t).select("url_id").unionByName(Query().where_not_false("checked").run(t).select("url_id"))


@query("SELECT id, url FROM url WHERE last_crawl_start_time IS NOT NULL AND last_crawl_finish_time IS NULL")
def flt_nulls(s, d):
    return Query().where_not_null("last_crawl_start_time").where_null("last_crawl_finish_time").run(table(s, d, "url")).select("id", "url")


@query("SELECT short_name FROM site_manifest WHERE aka_root_domain IS NULL OR len(aka_root_domain) = 0")
def flt_null_arrays(s, d):
    return Query(dialect="document").where_null("aka_root_domain").run(table(s, d, "site_manifest")).select("short_name")


@query("SELECT url_id FROM article WHERE len(list_filter(keyword, lambda k: k.type = 'p')) > 0 AND len(list_filter(feature, lambda f: f.similarity > 0.9)) > 0")
def flt_nested_any(s, d):
    return Query().where_equals("keyword.type", "p").where_greater("feature.similarity", 0.9).run(table(s, d, "article", "url_id", "keyword", "feature")).select("url_id")


@query("SELECT url_id FROM article WHERE coalesce(len(list_filter(keyword, lambda k: k.type = 'p')), 0) = 0")
def flt_nested_none(s, d):
    return Query().where_not_equals("keyword.type", "p").run(table(s, d, "article", "url_id", "keyword")).select("url_id")


@query("SELECT id, crawl_priority, 'new' AS reason, 7 AS reason_code FROM url WHERE last_crawl_start_time IS NULL ORDER BY crawl_priority DESC NULLS LAST, id LIMIT 50")
def flt_composed_with_reason(s, d):
    only_new = Query().where_null("last_crawl_start_time")
    q = Query(key="id").where(only_new).where(None).descending("crawl_priority").limit(50).with_constant("reason", "new").with_constant("reason_code", 7)
    return q.run(table(s, d, "url", "id", "crawl_priority", "last_crawl_start_time")).drop("last_crawl_start_time")


@query("SELECT count(*) AS n FROM url WHERE crawl_priority >= 500")
def flt_count(s, d):
    return Query().where_at_least("crawl_priority", 500).size(table(s, d, "url"))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_brand NULLS FIRST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 40 OFFSET 15")
def srt_sort_limit_offset(s, d):
    return Query(key="p_partkey").ascending("p_brand").descending("p_retailprice").limit(40, 15).run(table(s, d, "part", "p_partkey", "p_brand", "p_retailprice"))


@query("SELECT id, discovery_time FROM url ORDER BY discovery_time DESC NULLS LAST, id LIMIT 1 OFFSET 20")
def srt_first_with_offset(s, d):
    return Query(key="id").descending("discovery_time").limit(500, 20).first(table(s, d, "url", "id", "discovery_time"))


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def srt_top_list(s, d):
    return A.top_list(table(s, d, "orders", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", 100)


@query("SELECT published_time FROM article ORDER BY published_time DESC NULLS LAST LIMIT 1 OFFSET 100")
def srt_offset_statistic(s, d):
    return A.order_statistic(table(s, d, "article", "published_time"), "published_time", 100, descending=True)


@query("SELECT p_name, row_number() OVER (ORDER BY CASE WHEN starts_with(lower(p_name), 'b') THEN 0 ELSE 1 END, p_name, p_partkey) AS rank FROM part WHERE lower(p_name) LIKE '%b%' ORDER BY rank LIMIT 60")
def srt_prefix_first(s, d):
    p = table(s, d, "part", "p_partkey", "p_name").filter(F.lower("p_name").contains("b"))
    few = p.orderBy(F.when(F.lower("p_name").startswith("b"), 0).otherwise(1), "p_name", "p_partkey").limit(60)
    w = A.Window.orderBy(F.when(F.lower("p_name").startswith("b"), 0).otherwise(1), "p_name", "p_partkey")
    return few.select("p_name", F.row_number().over(w).cast("bigint").alias("rank"))


@query("""SELECT url_id, rank FROM (SELECT url_id, row_number() OVER (ORDER BY pinned DESC, published_time DESC NULLS LAST, url_id) AS rank FROM (
    SELECT url_id, max(published_time) AS published_time, url_id = (SELECT min(url_id) FROM article) AS pinned FROM article GROUP BY url_id)) WHERE rank <= 51""")
def srt_pinned_first_look_ahead(s, d):
    a = table(s, d, "article", "url_id", "published_time").groupBy("url_id").agg(F.max("published_time").alias("published_time"))
    pin = a.agg(F.min("url_id")).scalar()
    o = [F.desc(F.col("url_id") == F.col("pin")), F.desc_nulls_last("published_time"), F.asc("url_id")]
    few = a.withColumn("pin", pin).orderBy(*o).limit(51)
    return few.select("url_id", F.row_number().over(A.Window.orderBy(*o)).cast("bigint").alias("rank"))


# ---------------------------------------------------------------- sets (U)


@query("""SELECT url_id, branch FROM (SELECT url_id, branch, row_number() OVER (PARTITION BY url_id ORDER BY branch) AS n FROM (
    SELECT DISTINCT url_id, 0 AS branch FROM article WHERE origin = 'Copperwire' UNION ALL
    SELECT DISTINCT url_id, 1 FROM article WHERE word_count > 400 UNION ALL SELECT DISTINCT url_id, 2 FROM article WHERE type = 'news')) WHERE n = 1""")
def set_branch_union(s, d):
    a = table(s, d, "article", "url_id", "origin", "word_count", "type")
    parts = [a.filter(c).select("url_id").distinct() for c in (F.col("origin") == "Copperwire", F.col("word_count") > 400, F.col("type") == "news")]
    return J.branch_union(parts, "url_id", [])


@query("SELECT c_custkey AS k FROM customer WHERE c_nationkey = 1 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def set_union_all(s, d):
    c = table(s, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    return c.filter("c_nationkey = 1").select(F.col("c_custkey").alias("k")).unionByName(c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))


@query("SELECT id FROM url EXCEPT SELECT url_id FROM article")
def set_not_yet_crawled(s, d):
    return table(s, d, "url", "id").distinct().join(table(s, d, "article", F.col("url_id").alias("id")), "id", "left_anti")


@query("""SELECT url_id, len(list_intersect(f, [10001, 10004, 10022, 10030])) AS shared, len(f) + 4 - 2 * len(list_intersect(f, [10001, 10004, 10022, 10030])) AS apart
    FROM (SELECT url_id, list_distinct(list_transform(feature, lambda x: x.feature_id)) AS f FROM article WHERE feature IS NOT NULL)""")
def set_array_algebra(s, d):
    own, mine = F.array_distinct(F.transform("feature", lambda x: x["feature_id"])), F.array(*[F.lit(x) for x in (10001, 10004, 10022, 10030)])
    shared, apart = F.size(F.array_intersect(own, mine)), F.size(F.array_union(F.array_except(own, mine), F.array_except(mine, own)))
    return table(s, d, "article", "url_id", "feature").filter("feature is not null").select("url_id", shared.cast("bigint").alias("shared"), apart.cast("bigint").alias("apart"))


# ---------------------------------------------------------------- joins (J)


@query("""SELECT u.id, u.last_crawl_start_time IS NOT NULL AS started, a.url_id IS NOT NULL AS has_article FROM url u LEFT JOIN (SELECT DISTINCT url_id FROM article) a ON u.id = a.url_id""")
def jn_left_lookup(s, d):
    a = table(s, d, "article", "url_id").distinct()
    u = table(s, d, "url", "id", "last_crawl_start_time")
    return u.join(a, u.id == a.url_id, "left").select("id", F.col("last_crawl_start_time").isNotNull().alias("started"), F.col("url_id").isNotNull().alias("has_article"))


@query(r"""WITH dom AS (SELECT short_name, unnest(list_distinct(list_concat([root_domain], coalesce(aka_root_domain, [])))) AS domain FROM site_manifest),
    u AS (SELECT id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM url),
    hit AS (SELECT u.id, d.short_name, row_number() OVER (PARTITION BY u.id ORDER BY length(d.domain) DESC) AS n FROM u JOIN dom d ON u.host = d.domain OR ends_with(u.host, '.' || d.domain))
    SELECT u.id, h.short_name FROM u LEFT JOIN hit h ON u.id = h.id AND h.n = 1""")
def jn_domain_suffix(s, d):
    m = table(s, d, "site_manifest", "short_name", "root_domain", "aka_root_domain")
    return J.domain_suffix_join(table(s, d, "url", "id", "url"), "url", m, ["root_domain", "aka_root_domain"]).select("id", "short_name")


@query("""WITH t AS (SELECT url_id AS k, title, max(coalesce(published_time, 0)) AS t FROM article WHERE title IS NOT NULL GROUP BY url_id, title),
    w AS (SELECT DISTINCT k, t, s FROM (SELECT k, t, unnest(list_transform(list_filter(string_split(lower(title), ' '), lambda x: length(x) >= 6), lambda x: x[1:6])) AS s FROM t))
    SELECT a.k AS key_a, b.k AS key_b, CAST(count(DISTINCT a.s) AS BIGINT) AS shared FROM w a JOIN w b ON a.s = b.s AND a.k < b.k AND abs(a.t - b.t) <= 108000000 GROUP BY 1, 2 HAVING count(DISTINCT a.s) >= 3""")
def jn_shared_stems(s, d):
    a = table(s, d, "article", "url_id", "title", "published_time").filter("title is not null").groupBy("url_id", "title").agg(F.max(F.coalesce("published_time", F.lit(0))).alias("t"))
    stems = F.transform(F.filter(F.split(F.lower("title"), " "), lambda x: F.length(x) >= 6), lambda x: F.substring(x, 1, 6))
    return J.shared_item_pairs(a.withColumn("stems", stems), "url_id", "stems", 3, "t", 108_000_000)


@query("""WITH w AS (SELECT DISTINCT user_id, id, create_time AS t, unnest(string_split(substr(url, 9), '/')) AS item FROM user_action WHERE action_type = 'SCROLL_PAST' AND url IS NOT NULL),
    e AS (SELECT DISTINCT user_id, id, create_time AS t, unnest(string_split(substr(url, 9), '/')) AS item FROM user_action WHERE action_type = 'SHARE' AND url IS NOT NULL)
    SELECT DISTINCT u.id, u.user_id FROM user_action u WHERE action_type = 'SCROLL_PAST' AND url IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM w JOIN e ON w.user_id = e.user_id AND w.item = e.item AND abs(w.t - e.t) <= 864000000 WHERE w.id = u.id AND w.user_id = u.user_id GROUP BY e.id HAVING count(*) >= 3)""")
def jn_without_near_earlier(s, d):
    a = table(s, d, "user_action", "id", "user_id", "action_type", "url", "create_time").filter("url is not null").withColumn("items", F.split(F.expr("substr(url, 9)"), "/")).distinct()
    out = J.without_near(a.filter("action_type = 'SCROLL_PAST'"), a.filter("action_type = 'SHARE'"), "user_id", "id", "items", "create_time", 3, 864_000_000)
    return out.select("id", "user_id").distinct()


@query("""WITH k AS (SELECT DISTINCT url_id, lower(k.keyword) AS keyword FROM (SELECT url_id, unnest(keyword) AS k FROM article)),
    top AS (SELECT keyword FROM k GROUP BY 1 HAVING count(*) >= 5)
    SELECT k.keyword, count(*) AS articles FROM k JOIN top USING (keyword) GROUP BY 1""")
def jn_contained_elements(s, d):
    a = table(s, d, "article", "url_id", "keyword")
    known = a.select(F.explode("keyword").alias("k"), "url_id").select(F.lower("k.keyword").alias("keyword"), "url_id").distinct()
    top = known.groupBy("keyword").agg(F.count("*").alias("n")).filter("n >= 5").select("keyword")
    met = J.contained_elements_join(a.select("url_id", F.transform("keyword", lambda k: F.struct(F.lower(k["keyword"]).alias("low"))).alias("ks")), "ks", "low", top, "keyword")
    return met.select("keyword", "url_id").distinct().groupBy("keyword").agg(F.count("*").alias("articles"))


@query("""SELECT DISTINCT a.user_id, a.url_id FROM (SELECT * FROM user_action WHERE action_type <> 'UNFAVORITE') a
    WHERE url_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM user_action t WHERE t.action_type = 'X_OUT' AND t.user_id = a.user_id AND t.url_id = a.url_id)""")
def jn_conflict_anti(s, d):
    a = table(s, d, "user_action", "user_id", "url_id", "action_type").filter("url_id is not null")
    closure = s.createDataFrame([("act", "act")], "value string, ancestor string")
    kept = J.conflict_anti_join(a.filter("action_type <> 'UNFAVORITE'"), a.filter("action_type = 'X_OUT'"), "user_id", F.col("url_id"), F.lit("act"), closure)
    return kept.select("user_id", "url_id").distinct()


@query("""SELECT DISTINCT user_id FROM user_action WHERE user_id NOT IN (SELECT user_id FROM user_action WHERE create_time >= (SELECT max(create_time) FROM user_action) - 64800000)""")
def jn_recent_anti(s, d):
    a = table(s, d, "user_action", "user_id", "create_time")
    recent = a.filter(F.col("create_time") >= a.agg(F.max("create_time")).scalar() - 64_800_000).select("user_id").distinct()
    return a.select("user_id").distinct().join(recent, "user_id", "left_anti")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE starts_with(s.s_name, 'Supplier#00000000' || CAST(p_partkey % 20 AS VARCHAR)))""")
def jn_prefix_anti(s, d):
    p = table(s, d, "part", "p_partkey").withColumn("name", F.concat(F.lit("Supplier#00000000"), (F.col("p_partkey") % 20).cast("string")))
    return J.prefix_anti_join(p, "name", table(s, d, "supplier", "s_name"), "s_name").select("p_partkey")


@query("""WITH RECURSIVE e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'world' FROM region),
    up AS (SELECT v, v AS a, CAST(0 AS BIGINT) AS distance FROM (SELECT c AS v FROM e UNION SELECT p FROM e) UNION ALL SELECT up.v, e.p, distance + 1 FROM up JOIN e ON up.a = e.c)
    SELECT v AS value, a AS ancestor, distance FROM up""")
def jn_hierarchy_closure(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("c"), F.col("r_name").alias("p"))
    return J.closure(n.unionByName(table(s, d, "region").select(F.col("r_name").alias("c"), F.lit("world").alias("p"))), "c", "p")


@query("""SELECT l.destination_url_id AS url_id, count(*) AS inlinks, count(DISTINCT o.origin) AS sites FROM (SELECT DISTINCT origin_url_id, destination_url_id FROM url_link) l
    JOIN (SELECT DISTINCT url_id, origin FROM article) o ON l.origin_url_id = o.url_id GROUP BY 1""")
def jn_link_sources(s, d):
    k = table(s, d, "url_link", "origin_url_id", "destination_url_id").distinct()
    o = table(s, d, "article", "url_id", "origin").distinct()
    return k.join(o, k.origin_url_id == o.url_id).groupBy(F.col("destination_url_id").alias("url_id")).agg(F.count("*").alias("inlinks"), F.count_distinct("origin").alias("sites"))


@query("""WITH r AS (SELECT action_type, count(*) AS n, avg(CASE WHEN read_end_time IS NOT NULL THEN 1.0 ELSE 0.0 END) AS rating FROM user_action GROUP BY 1)
    SELECT DISTINCT u.action_type, CASE WHEN r.n >= 200 THEN r.rating ELSE 0.4 END AS rating FROM user_action u LEFT JOIN r USING (action_type)""")
def jn_default_rating(s, d):
    a = table(s, d, "user_action", "action_type", "read_end_time")
    r = a.groupBy("action_type").agg(F.count("*").alias("n"), F.avg(F.when(F.col("read_end_time").isNotNull(), 1.0).otherwise(0.0)).alias("rating"))
    return J.default_rating(a.select("action_type").distinct(), r, "action_type", "rating", 0.4, lambda: F.col("n") >= 200)


@query("""SELECT user_id, url_id, CAST(copy AS INTEGER) AS copy FROM (SELECT user_id, url_id, action_type, unnest(CASE WHEN action_type = 'FAVORITE' THEN [0, 1] ELSE [0] END) AS copy
    FROM user_action WHERE url_id IS NOT NULL AND action_type IN ('FAVORITE', 'X_OUT'))""")
def jn_replicated_rows(s, d):
    a = table(s, d, "user_action", "user_id", "url_id", "action_type").filter("url_id is not null and action_type in ('FAVORITE', 'X_OUT')")
    copies = F.when(F.col("action_type") == "FAVORITE", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return a.select("user_id", "url_id", F.explode(copies).alias("copy"))


# ---------------------------------------------------------------- aggregates (A)


@query("""WITH r AS (SELECT origin, count(*) AS instances, count(*) FILTER (action_type = 'TAP_FROM_STREAM') AS clicks FROM user_action JOIN (SELECT DISTINCT url_id, origin FROM article) USING (url_id) GROUP BY 1)
    SELECT origin, instances, clicks, clicks / instances AS rate FROM r""")
def agg_click_rate(s, d):
    a = table(s, d, "user_action", "url_id", "action_type").join(table(s, d, "article", "url_id", "origin").distinct(), "url_id")
    return A.click_through(a, ["origin"], F.col("action_type") == "TAP_FROM_STREAM")


@query("""WITH k AS (SELECT DISTINCT url_id, published_time, lower(k.keyword) AS keyword, feature FROM (SELECT url_id, published_time, feature, unnest(keyword) AS k FROM article)),
    f AS (SELECT url_id, published_time, keyword, unnest(feature) AS f FROM k)
    SELECT keyword, f.feature_id AS feature_id, round(sum(f.similarity), 5) AS sum, count(f.similarity) AS count, max(published_time) AS through FROM f GROUP BY 1, 2""")
def agg_keyword_relevance(s, d):
    a = J.first_wins(table(s, d, "article", "url_id", "published_time", "keyword", "feature", "crawl_time"), ["url_id"], [F.asc("crawl_time")])
    return A.relevance(a, "keyword").withColumn("sum", F.round("sum", 5))


@query("""WITH e AS (SELECT url_id, origin, unnest(social_engagement) AS e FROM article), l AS (SELECT origin, url_id, max_by(e.share_count, e.create_time) AS shares FROM e WHERE e.site = 'FACEBOOK' GROUP BY 1, 2),
    t AS (SELECT origin, count(*) AS articles, CAST(sum(shares) AS BIGINT) AS shares FROM l GROUP BY 1)
    SELECT short_name AS origin, coalesce(articles, 0) AS articles, coalesce(shares, 0) AS shares FROM site_manifest LEFT JOIN t ON short_name = origin""")
def agg_share_totals(s, d):
    e = table(s, d, "article", "url_id", "origin", "social_engagement").select("url_id", "origin", F.inline("social_engagement")).filter("site = 'FACEBOOK'")
    last = e.groupBy("origin", "url_id").agg(F.max_by("share_count", "create_time").alias("shares"))
    dim = table(s, d, "site_manifest", F.col("short_name").alias("origin"))
    return A.zero_filled(last, "origin", dim, [F.count("*").alias("articles"), F.sum("shares").alias("shares")])


@query("""WITH e AS (SELECT published_time, unnest(social_engagement) AS e FROM article), a AS (SELECT e.share_count AS v, e.create_time - published_time AS age FROM e),
    b AS (SELECT unnest([3600000, 21600000, 86400000, 604800000, 9000000000000]) AS stop)
    SELECT CAST(stop AS BIGINT) AS stop, count(*) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90 FROM a JOIN b ON age < stop GROUP BY 1""")
def agg_cumulative_age_buckets(s, d):
    e = table(s, d, "article", "published_time", "social_engagement").select("published_time", F.inline("social_engagement")).withColumn("age", F.col("create_time") - F.col("published_time"))
    b = A.cumulative_buckets(e, F.col("age"), [3_600_000, 21_600_000, 86_400_000, 604_800_000, 9_000_000_000_000], F.col("share_count"))
    at = lambda p: F.get(F.transform(F.filter("distribution", lambda z: z["percentile"] == p), lambda z: z["value"]), F.lit(0))
    return b.select(F.col("end").alias("stop"), "n", at(0.5).alias("median"), at(0.9).alias("p90"))


@query("""WITH k AS (SELECT k.type AS kind, lower(k.keyword) AS keyword FROM (SELECT unnest(keyword) AS k FROM article)), c AS (SELECT kind, keyword, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT kind, keyword, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, keyword) AS INTEGER) AS rank FROM c) WHERE rank <= 20""")
def agg_keyword_popularity(s, d):
    k = table(s, d, "article", "keyword").select(F.explode("keyword").alias("k")).groupBy(F.col("k.type").alias("kind"), F.lower("k.keyword").alias("keyword")).agg(F.count("*").alias("n"))
    return A.top_per_group(k, ["kind"], [F.desc("n"), F.asc("keyword")], 20)


@query("""WITH f AS (SELECT lower(k.keyword) AS keyword, f.feature_id AS feature_id FROM (SELECT k, unnest(feature) AS f FROM (SELECT feature, unnest(keyword) AS k FROM article))),
    c AS (SELECT keyword, feature_id, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, feature_id) AS rank FROM c)
    SELECT keyword, max(CASE WHEN rank = 1 THEN feature_id END) AS top_1, max(CASE WHEN rank = 2 THEN feature_id END) AS top_2, max(CASE WHEN rank = 3 THEN feature_id END) AS top_3 FROM r WHERE rank <= 3 GROUP BY 1""")
def agg_top3_features(s, d):
    f = table(s, d, "article", "keyword", "feature").select("feature", F.explode("keyword").alias("k")).select(F.lower("k.keyword").alias("keyword"), F.inline("feature"))
    r = A.top_per_group(f.groupBy("keyword", "feature_id").agg(F.count("*").alias("n")), ["keyword"], [F.desc("n"), F.asc("feature_id")], 3)
    return r.groupBy("keyword").pivot("rank", [1, 2, 3]).agg(F.max("feature_id")).toDF("keyword", "top_1", "top_2", "top_3")


@query("""WITH c AS (SELECT user_id, action_type, count(*) AS n FROM user_action GROUP BY 1, 2) SELECT user_id, CAST(greatest(1, max(n)) AS BIGINT) AS badge FROM c GROUP BY 1""")
def agg_max_of_counts(s, d):
    c = table(s, d, "user_action", "user_id", "action_type").groupBy("user_id", "action_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.greatest(F.lit(1), F.max("n")).cast("bigint").alias("badge"))


@query("""WITH b AS (SELECT CAST(floor((create_time % 86400000) / 3600000) AS INTEGER) AS hour, action_type = 'TAP_FROM_STREAM' AS clicked FROM user_action),
    c AS (SELECT hour, count(*) AS n, avg(CASE WHEN clicked THEN 1.0 ELSE 0.0 END) AS rate FROM b GROUP BY 1)
    SELECT CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS n, rate FROM range(24) t(h) LEFT JOIN c ON h = hour""")
def agg_rate_by_dense_bucket(s, d):
    a = table(s, d, "user_action", "create_time", "action_type").select(F.floor(F.col("create_time") % 86_400_000 / 3_600_000).cast("int").alias("hour"), (F.col("action_type") == "TAP_FROM_STREAM").alias("c"))
    c = a.groupBy("hour").agg(F.count("*").alias("n"), F.avg(F.when(F.col("c"), 1.0).otherwise(0.0)).alias("rate"))
    return s.range(24).select(F.col("id").cast("int").alias("hour")).join(c, "hour", "left").fillna(0, ["n"])


@query("""WITH f AS (SELECT f.similarity AS v FROM (SELECT unnest(feature) AS f FROM article)), b AS (SELECT CASE WHEN v < 0 OR v > 1 THEN -1 ELSE least(floor(v * 100), 99) END AS bucket FROM f WHERE v IS NOT NULL),
    c AS (SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n FROM b GROUP BY 1) SELECT CAST(coalesce(bucket, r) AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM range(100) t(r) FULL JOIN c ON r = bucket""")
def agg_histogram(s, d):
    return A.histogram(table(s, d, "article", "feature").select(F.inline("feature")), F.col("similarity"), 100)


@query("""WITH x AS (SELECT l_quantity AS q, l_discount AS d, l_returnflag = 'R' AS r FROM lineitem)
    SELECT 'l_quantity' AS name, round(avg(q), 4) AS overall, round(avg(q) FILTER (r), 4) AS with_flag, round(avg(q) FILTER (NOT r), 4) AS without_flag FROM x UNION ALL
    SELECT 'l_discount', round(avg(d), 4), round(avg(d) FILTER (r), 4), round(avg(d) FILTER (NOT r), 4) FROM x""")
def agg_conditional_means(s, d):
    return A.conditional_means(table(s, d, "lineitem", "l_quantity", "l_discount", "l_returnflag"), ["l_quantity", "l_discount"], F.col("l_returnflag") == "R").select("name", *[F.round(c, 4).alias(c) for c in ("overall", "with_flag", "without_flag")])


@query("""WITH x AS (SELECT t.checked AS y, coalesce(list_max(list_transform(a.feature, lambda f: f.similarity)), 0) AS s FROM trained_article_classification t
      JOIN (SELECT url_id, any_value(feature) AS feature FROM article GROUP BY 1) a USING (url_id) WHERE checked IS NOT NULL),
    c AS (SELECT count(*) FILTER (y AND s >= 0.5) AS tp, count(*) FILTER (y AND s < 0.5) AS fn, count(*) FILTER (NOT y AND s >= 0.5) AS fp, count(*) FILTER (NOT y AND s < 0.5) AS tn FROM x)
    SELECT tp AS true_positive, fn AS false_negative, fp AS false_positive, tn AS true_negative, (tp + tn) / (tp + fn + fp + tn) AS accuracy FROM c""")
def agg_confusion(s, d):
    a = table(s, d, "article", "url_id", "feature").dropDuplicates(["url_id"])
    x = table(s, d, "trained_article_classification", "url_id", "checked").filter("checked is not null").join(a, "url_id")
    best = F.coalesce(F.array_max(F.transform("feature", lambda f: f["similarity"])), F.lit(0.0))
    return A.confusion(x, F.col("checked"), best)


@query("""WITH s AS (SELECT avg(value) FILTER (event_type = 'click') AS hi, avg(value) FILTER (event_type <> 'click') AS lo FROM events), v AS (SELECT (3 * hi + lo) / 4 AS divider FROM s)
    SELECT round(divider, 4) AS divider, round(sum(CASE WHEN event_type = 'click' THEN value - divider ELSE divider - value END), 2) AS separation FROM events, v GROUP BY divider""")
def agg_separation(s, d):
    return A.separation(table(s, d, "events", "event_type", "value"), F.col("event_type") == "click", F.col("value")).select(F.round("divider", 4).alias("divider"), F.round("separation", 2).alias("separation"))


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_type = 'click' AS g, least(floor((value - lo) / (hi - lo) * 4), 3) AS b FROM events, r)
    SELECT count(*) FILTER (g AND b >= 2) AS good_upper, count(*) FILTER (NOT g AND b < 2) AS bad_lower, count(*) AS n FROM b""")
def agg_band_accuracy(s, d):
    return A.band_accuracy(table(s, d, "events", "event_type", "value"), F.col("event_type") == "click", F.col("value"))


@query("""SELECT user_id, count(*) FILTER (action_type = 'READ_ARTICLE') AS reads, count(*) FILTER (action_type = 'SCROLL_PAST') AS scrolls, count(*) AS n FROM user_action GROUP BY 1""")
def agg_pivot(s, d):
    a = table(s, d, "user_action", "user_id", "action_type")
    return a.groupBy("user_id").agg(F.count_if(F.col("action_type") == "READ_ARTICLE").alias("reads"), F.count_if(F.col("action_type") == "SCROLL_PAST").alias("scrolls"), F.count("*").alias("n"))


@query("""SELECT url_id, CAST(list_sum(list_transform(paragraph, lambda p: len(regexp_extract_all(p, '[\\s\x0b]+')) + 1)) AS BIGINT) AS words FROM article""".replace("\\\\", "\\").replace("\x0b", "\\x0b"))
def agg_word_count(s, d):
    from loomstream.functions.text import word_count

    return table(s, d, "article", "url_id", "paragraph").select("url_id", word_count(F.col("paragraph")).alias("words"))


@query("""WITH m AS (SELECT url_id, list_max(list_transform(list_filter(feature, lambda f: f.feature_id >= 10020), lambda f: f.similarity)) * 0.75 AS v FROM article) SELECT url_id, max(v) AS value FROM m WHERE v IS NOT NULL GROUP BY 1""")
def agg_map_reduce(s, d):
    best = F.array_max(F.transform(F.filter("feature", lambda f: f["feature_id"] >= 10020), lambda f: f["similarity"])) * 0.75
    return table(s, d, "article", "url_id", "feature").select("url_id", best.alias("v")).filter("v is not null").groupBy("url_id").agg(F.max("v").alias("value"))


@query("""WITH k AS (SELECT lower(k.keyword) AS keyword, pos - 1 AS pos FROM (SELECT keyword[pos] AS k, pos FROM (SELECT keyword, unnest(range(1, len(keyword) + 1)) AS pos FROM article)))
    SELECT keyword, CAST(sum(greatest(1, 10 - pos)) AS BIGINT) AS weight FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def agg_rank_weights(s, d):
    k = table(s, d, "article", "keyword").select(F.posexplode("keyword").alias("pos", "k"))
    return k.groupBy(F.lower("k.keyword").alias("keyword")).agg(F.sum(F.greatest(F.lit(1), 10 - F.col("pos"))).cast("bigint").alias("weight")).orderBy(F.desc("weight"), "keyword").limit(50)


@query("SELECT origin, count(*) AS crawls, CAST(sum(last_crawl_finish_time - last_crawl_start_time) AS BIGINT) AS millis FROM url JOIN (SELECT DISTINCT url_id, origin FROM article) ON id = url_id GROUP BY 1 ORDER BY 3 DESC NULLS LAST, 1 LIMIT 10")
def agg_crawl_statistics(s, d):
    u = table(s, d, "url").join(table(s, d, "article", "url_id", "origin").distinct(), F.col("id") == F.col("url_id"))
    out = u.groupBy("origin").agg(F.count("*").alias("crawls"), F.sum(F.col("last_crawl_finish_time") - F.col("last_crawl_start_time")).alias("millis"))
    return out.orderBy(F.desc_nulls_last("millis"), F.asc_nulls_last("origin")).limit(10)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 1) AS sum_qty, round(sum(l_extendedprice), 1) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 1) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def agg_pricing_summary(s, d):
    x = table(s, d, "lineitem").filter("l_shipdate <= date '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    disc = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return x.agg(F.round(F.sum("l_quantity"), 1).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 1).alias("sum_base"), F.round(disc, 1).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def agg_local_supplier_volume(s, d):
    c, o, li = table(s, d, "customer", "c_custkey", "c_nationkey"), table(s, d, "orders", "o_orderkey", "o_custkey"), table(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(table(s, d, "supplier", "s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    x = x.join(table(s, d, "nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"))


# ---------------------------------------------------------------- windows (W)


@query("""WITH e AS (SELECT DISTINCT url_id, e.site AS site, e.create_time AS t, e.share_count AS c FROM (SELECT url_id, unnest(social_engagement) AS e FROM article))
    SELECT url_id, site, t AS create_time, c AS share_count FROM (SELECT *, row_number() OVER (PARTITION BY url_id, site ORDER BY t DESC NULLS LAST, c) AS n FROM e) WHERE n = 1""")
def win_latest_per_key(s, d):
    e = table(s, d, "article", "url_id", "social_engagement").select("url_id", F.inline("social_engagement")).select("url_id", "site", "create_time", "share_count").distinct()
    return J.first_wins(e, ["url_id", "site"], [F.desc_nulls_last("create_time"), F.asc_nulls_last("share_count")])


@query("""SELECT user_id, event_id, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 AS followed FROM events""")
def win_followed_by(s, d):
    e = table(s, d, "events", "user_id", "event_id", "event_type", "ts")
    return A.followed_by(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "click", "followed").select("user_id", "event_id", "followed")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def win_top_n_per_group(s, d):
    return A.top_per_group(table(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("""SELECT url_id, word, min(pos) AS first_paragraph FROM (SELECT url_id, pos - 1 AS pos, unnest(string_split_regex(lower(paragraph[pos]), '[^\\p{L}\\p{N}]+')) AS word FROM (
    SELECT url_id, paragraph, unnest(range(1, len(paragraph) + 1)) AS pos FROM article)) WHERE word <> '' GROUP BY 1, 2""")
def win_first_paragraph_of_word(s, d):
    a = table(s, d, "article", "url_id", "paragraph").select("url_id", F.posexplode("paragraph").alias("pos", "p"))
    w = a.select("url_id", F.col("pos").cast("bigint").alias("pos"), F.explode(F.split(F.lower("p"), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")
    return w.groupBy("url_id", "word").agg(F.min("pos").alias("first_paragraph"))


@query("""WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT user_id, event_id, sum(CASE WHEN n = 1 OR event_type <> b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS island FROM x)
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS length FROM i GROUP BY 1, 2""")
def win_islands(s, d):
    e = table(s, d, "events", "user_id", "event_id", "event_type", "ts")
    i = A.islands(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type"))
    return i.groupBy("user_id", F.col("island").cast("bigint").alias("island")).agg(F.count("*").alias("length"))


@query("""WITH x AS (SELECT user_id, create_time AS t, lag(create_time) OVER (PARTITION BY user_id ORDER BY create_time) AS b FROM user_action WHERE create_time IS NOT NULL),
    k AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS n FROM x WHERE b IS NULL OR t - b > 3600000)
    SELECT user_id, count(*) AS uses, max(t) AS newest, min(t) AS oldest FROM k WHERE n <= 5 GROUP BY 1""")
def win_last_five_uses(s, d):
    t = A.last_times(table(s, d, "user_action", "user_id", "create_time"), "user_id", "create_time")
    return t.select("user_id", F.size("times").cast("bigint").alias("uses"), F.array_max("times").alias("newest"), F.array_min("times").alias("oldest"))


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 4 = 0 AS holdback FROM orders")
def win_every_fourth(s, d):
    o = table(s, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return A.every_nth(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 4).drop("o_orderdate")


@query("""SELECT url_id, CAST(rank AS INTEGER) AS rank FROM (SELECT url_id, row_number() OVER (PARTITION BY origin ORDER BY published_time DESC NULLS LAST, url_id) AS rank FROM (SELECT DISTINCT url_id, origin, published_time FROM article))
    WHERE rank IN (1, 2, 3, 5, 7, 11, 13, 17, 19)""")
def win_rank_positions(s, d):
    a = table(s, d, "article", "url_id", "origin", "published_time").distinct()
    return A.top_per_group(a, ["origin"], [F.desc_nulls_last("published_time"), F.asc("url_id")], 19).filter(F.col("rank").isin(1, 2, 3, 5, 7, 11, 13, 17, 19)).select("url_id", "rank")


@query(r"""WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM url) SELECT regexp_replace(lower(h), '^www\.', '') AS domain, count(*) AS n FROM h GROUP BY 1""")
def agg_urls_per_domain(s, d):
    return table(s, d, "url", "url").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
