"""Sites, keywords and entities, readers, scores and residual jobs over the news and sales tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomstream.functions import html, text, urls
from loomstream.operators import accounts, engagement, keywords, sites
from loomstream.operators import aggregates as A
from loomstream.operators import joins as J
from loomstream.operators import ranking as R
from loomstream.operators import vectors as V
from loomstream.plans.suite_relational import query
from loomstream.plans.suite_text import clean_sql, deduped_sql, stream_sql
from loomstream.session import shared_dir, table, written, written_together
from loomstream.sources import readers, schemas, store
from loomstream.streaming import gates


def _quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---------------------------------------------------------------- URLs and pages by their sites' rules

_HOSTS = ("www.abcnews.go.com", "www.archaeology.org", "detail-online.com", "www.businessinsider.com", "edition.cnn.com", "slate.com", "www.theverge.com", "washingtonpost.com", "notcnn.com")
_PATHS = ("/a/b/index.html", "/pb/story.html", "/x/in/1234567", "/one.single.html", "/", "/deep/er/path")


@query(f"""WITH u AS (SELECT p_partkey, [{_quoted(_HOSTS)}][1 + p_partkey % {len(_HOSTS)}] AS h, [{_quoted(_PATHS)}][1 + p_partkey % {len(_PATHS)}] AS p FROM part)
    SELECT p_partkey, 'http://' || CASE h WHEN 'www.abcnews.go.com' THEN 'abcnews.go.com' WHEN 'www.archaeology.org' THEN 'archaeology.org' WHEN 'detail-online.com' THEN 'www.detail-online.com' ELSE h END ||
      CASE WHEN q = '/' THEN '' ELSE q END AS url FROM (SELECT *, CASE WHEN h = 'www.businessinsider.com' AND instr(p[2:], '/') > 0 THEN '/' || string_split(p, '/')[2] WHEN h = 'edition.cnn.com' AND ends_with(p, '/index.html') THEN left(p, length(p) - 10)
      WHEN h = 'slate.com' AND ends_with(p, '.html') AND NOT ends_with(p, '.single.html') THEN left(p, length(p) - 5) || '.single.html' WHEN h = 'www.theverge.com' AND regexp_matches(p, '/in/[0-9]{{6,9}}$') THEN left(p, length(p) - length(regexp_extract(p, '/in/[0-9]+$')))
      WHEN h = 'washingtonpost.com' AND starts_with(p, '/pb/') THEN p[4:] ELSE p END AS q FROM u)""")
def fn_rewritten_url(s, d):
    p = table(s, d, "part", "p_partkey")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values)).cast("int"))
    return p.select("p_partkey", urls.clean_url(F.concat(F.lit("HTTP://"), pick(_HOSTS), pick(_PATHS), F.lit("?utm=1#top")), F.lit(False), F.array().cast("array<string>")).alias("url"))


_MADE_IMAGES = (*urls.SITE_IMAGES, "http://a.nyt.com/x/t_black.png", "http://cdn.fxstreet.com/img/x.png", "http://x.y/bhorowitz/sites/1/meta_images/original/logo.png?1", "http://cdn.gotraffic.net/a/FB-Sharing.1.png", "http://www.abc.net.au/news/data/abc-news.jpg", "https://d1.cloudfront.net/_/fp/img/default-preview-image.x.png", "", "http://x.y/real.png")


@query(f"""WITH i AS (SELECT DISTINCT image_url AS url FROM article UNION SELECT unnest([{_quoted(_MADE_IMAGES)}])) SELECT url, coalesce(url <> '' AND url NOT IN ({_quoted(urls.SITE_IMAGES)})
    AND NOT regexp_matches(url, '{"|".join(f"(?:{p})" for p in urls.SITE_IMAGE_PATTERNS)}'), false) AS valid FROM i""")
def fn_article_image(s, d):
    made = s.createDataFrame([(u,) for u in _MADE_IMAGES], "url string")
    i = table(s, d, "article", F.col("image_url").alias("url")).unionByName(made).distinct()
    return i.select("url", urls.article_image(F.col("url")).alias("valid"))


@query("""WITH p AS (SELECT DISTINCT url_id, pos - 1 AS pos, paragraph[pos] AS t FROM (SELECT url_id, paragraph, unnest(range(1, len(paragraph) + 1)) AS pos FROM article))
    SELECT url_id, pos, coalesce(trim(t) <> '' AND NOT (pos = 0 AND starts_with(lower(t), 'by ') AND length(t) < 100) AND NOT ((contains(lower(t), 'facebook') OR contains(lower(t), 'twitter')) AND contains(lower(t), 'follow '))
      AND NOT regexp_matches(t, '^Photo gallery') AND NOT regexp_matches(t, 'identifiers? in your browser'), false) AS good FROM p""")
def fn_good_paragraph(s, d):
    p = table(s, d, "article", "url_id", "paragraph").select("url_id", F.posexplode("paragraph").alias("pos", "t")).distinct()
    listed = F.array(F.lit("^Photo gallery"), F.lit("identifiers? in your browser"))
    return p.select("url_id", F.col("pos").cast("bigint").alias("pos"), html.good_paragraph(F.col("t"), F.col("pos"), listed).alias("good"))


_HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"
_SITES_SQL = f"""dom AS (SELECT short_name, root_domain, aka_root_domain, unnest(list_distinct(list_concat([root_domain], coalesce(aka_root_domain, [])))) AS domain FROM site_manifest),
    u AS (SELECT id, url, {_HOST_SQL} AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM url),
    hit AS (SELECT u.*, d.short_name, d.root_domain, d.aka_root_domain, row_number() OVER (PARTITION BY u.id ORDER BY length(d.domain) DESC NULLS LAST) AS n FROM u LEFT JOIN dom d ON u.h = d.domain OR ends_with(u.h, '.' || d.domain)),
    ok AS (SELECT *, short_name IS NOT NULL AND length(url) <= 767 AND NOT (contains(h, 'video.') OR contains(h, 'videos.') OR starts_with(p, '/cgi-bin/') OR contains(p, '/video/') OR contains(p, '/videos/'))
      AND NOT regexp_matches(p, '(/atom\\.xml|/rss\\.xml|\\.gif|\\.jpeg|\\.jpg|\\.mp3|\\.mp4|\\.mpeg|\\.pdf|\\.png)$') AND h <> 'm.' || root_domain
      AND NOT (contains(p, '/tag/') OR starts_with(p, '/2014/02') OR ends_with(p, '7') OR p = '/latest' OR regexp_matches(p, 'lake.*[0-4]$')) AS allowed FROM hit WHERE n = 1)"""


def _ruled_sites(s, d):
    """The manifests with rules of their own: a closed subdomain, closed paths of every kind, and forms of article URLs."""
    m = table(s, d, "site_manifest", "short_name", "root_domain", "aka_root_domain")
    rule = lambda n, k: F.struct(F.lit(n).alias("needle"), F.lit(k).alias("location"))
    form = lambda sub, p, q: F.struct(sub.cast("string").alias("subdomain"), F.lit(p).cast("string").alias("path_regex"), F.lit(q).cast("string").alias("query_regex"))
    paths = F.array(rule("/tag/", "CONTAINS"), rule("/2014/02", "STARTS_WITH"), rule("7", "ENDS_WITH"), rule("/latest", "EQUALS"), rule("lake.*[0-4]$", "REGEX_FIND"), rule("nothing", "REGEX_MATCH"))
    forms = F.array(form(F.concat(F.lit("www."), "root_domain"), r"^/20[0-9]{2}/[0-9]{2}/[a-z]", None), form(F.lit(None), r"\.php$", "id=[0-9]+[02468]$"), form(F.lit(None), None, None))
    return m.withColumn("subdomain_blacklist", F.array(F.concat(F.lit("m."), "root_domain"))).withColumn("path_blacklist", paths).withColumn("article_url_pattern", forms)


@query(f"WITH {_SITES_SQL} SELECT id, coalesce(allowed, false) AS allowed FROM ok")
def url_allowed(s, d):
    u = sites.with_site(table(s, d, "url", "id", "url"), "url", _ruled_sites(s, d))
    return u.select("id", sites.allowed_by_site(u, "url").alias("allowed"))


@query(f"""WITH {_SITES_SQL}, f AS (SELECT *, h = root_domain OR ends_with(h, '.' || root_domain) OR len(list_filter(coalesce(aka_root_domain, []), lambda a: h = a OR ends_with(h, '.' || a))) > 0 AS own FROM ok)
    SELECT id, coalesce(allowed AND (((own OR h = 'www.' || root_domain) AND regexp_matches(p, '^/20[0-9]{{2}}/[0-9]{{2}}/[a-z]')) OR (own AND regexp_matches(p, '\\.php$') AND regexp_matches(q, 'id=[0-9]+[02468]$'))), false) AS article FROM f""")
def url_article(s, d):
    u = sites.with_site(table(s, d, "url", "id", "url"), "url", _ruled_sites(s, d))
    return u.select("id", sites.article_by_site(u, "url").alias("article"))


@query(f"""WITH dom AS (SELECT short_name, unnest(list_distinct(list_concat([root_domain], coalesce(aka_root_domain, [])))) AS domain FROM site_manifest),
    t AS (SELECT url_id, any_value(origin) AS origin, min(title) AS title FROM article GROUP BY 1), n AS (SELECT DISTINCT id, a.url, coalesce(t.origin, 'News') || ': ' || coalesce(t.title, '') AS text FROM user_action a JOIN t USING (url_id)),
    h AS (SELECT *, {_HOST_SQL} AS h FROM n), hit AS (SELECT h.id, d.short_name, row_number() OVER (PARTITION BY h.id ORDER BY length(d.domain) DESC) AS k FROM h JOIN dom d ON h.h = d.domain OR ends_with(h.h, '.' || d.domain))
    SELECT n.id, coalesce(x.short_name, CASE WHEN n.url IS NULL THEN m.short_name END) AS site_name FROM n LEFT JOIN hit x ON n.id = x.id AND x.k = 1 LEFT JOIN site_manifest m ON string_split(n.text, ': ')[1] = m.short_name""")
def jn_notification_site(s, d):
    t = table(s, d, "article", "url_id", "origin", "title").groupBy("url_id").agg(F.first("origin").alias("origin"), F.min("title").alias("title"))
    n = table(s, d, "user_action", "id", "url_id", "url").join(t, "url_id").select("id", "url", F.concat(F.coalesce("origin", F.lit("News")), F.lit(": "), F.coalesce("title", F.lit(""))).alias("text")).distinct()
    return sites.notification_sites(n, "url", "text", table(s, d, "site_manifest", "short_name", "root_domain", "aka_root_domain")).select("id", "site_name")


# ---------------------------------------------------------------- keywords and entities

_ENT = """k AS (SELECT lower(k.keyword) AS low, min(k.keyword) AS keyword, min(k.type) AS type, count(*) AS n FROM (SELECT unnest(keyword) AS k FROM article) GROUP BY 1),
    ent AS (SELECT md5(low) AS id, keyword, type, n, low FROM k WHERE n % 5 <> 0), lnk AS (SELECT low, md5(low) AS entity_id, n FROM k WHERE n >= 2), known AS (SELECT lnk.low, ent.id, ent.keyword, ent.type FROM lnk JOIN ent ON lnk.entity_id = ent.id)"""


def _entities(s, d):
    """(links, entities): made of the articles' keywords; some keywords have no link and some links no entity."""
    k = table(s, d, "article", "keyword").select(F.explode("keyword").alias("k")).groupBy(F.lower("k.keyword").alias("low"))
    k = k.agg(F.min("k.keyword").alias("keyword"), F.min("k.type").alias("type"), F.count("*").alias("n"))
    links = k.filter("n >= 2").select(F.col("low").alias("keyword"), F.md5("low").alias("entity_id"), "n")
    return links, k.filter("n % 5 <> 0").select(F.md5("low").alias("id"), "keyword", F.lit(None).cast("string").alias("short_name"), "type", "n")


def _depths(s):
    return s.createDataFrame([("t", 1), ("p", 3), ("o", 3), ("l", 2)], "type string, depth int")


@query(f"WITH {_ENT}, w AS (SELECT DISTINCT url_id, k.keyword AS keyword FROM (SELECT url_id, unnest(keyword) AS k FROM article)) SELECT w.url_id, w.keyword, known.id AS entity_id, known.type AS entity_type FROM w LEFT JOIN known ON lower(w.keyword) = known.low")
def jn_known_entities(s, d):
    links, entities = _entities(s, d)
    w = table(s, d, "article", "url_id", "keyword").select("url_id", F.explode("keyword.keyword").alias("keyword")).distinct()
    return keywords.known_entities(w, "keyword", links, entities).select("url_id", "keyword", "entity_id", "entity_type")


@query(rf"""WITH RECURSIVE {_ENT}, t AS (SELECT DISTINCT url_id, title FROM article WHERE title IS NOT NULL), ws AS (SELECT url_id, title, list_filter(string_split_regex(title, '[\s\x{{A0}}]'), lambda w: w <> '') AS w FROM t),
    src AS (SELECT DISTINCT unnest(w) AS word FROM ws), {{clean}},
    m AS (SELECT url_id, title, pos, w[pos] AS word FROM (SELECT url_id, title, w, unnest(range(1, len(w) + 1)) AS pos FROM ws)),
    s AS (SELECT m.url_id, m.title, m.pos, CASE WHEN regexp_matches(m.word, '^\p{{Lu}}') THEN c.z END AS z FROM m JOIN kc c ON c.k = m.word),
    r AS (SELECT *, sum(CASE WHEN z IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY url_id, title ORDER BY pos) AS run FROM s),
    b AS (SELECT DISTINCT url_id, trim(string_agg(z, ' ' ORDER BY pos)) AS block FROM r WHERE z IS NOT NULL GROUP BY url_id, title, run),
    x AS (SELECT url_id, block FROM b WHERE block <> '' UNION SELECT url_id, part FROM (SELECT x.url_id, unnest([array_to_string(string_split(x.block, ' ')[:-2], ' '), array_to_string(string_split(x.block, ' ')[2:], ' ')]) AS part
      FROM x LEFT JOIN known ON lower(x.block) = known.low WHERE known.id IS NULL AND contains(x.block, ' ')))
    SELECT DISTINCT url_id, known.id AS entity_id, known.keyword AS keyword, known.type AS type, 150 AS strength FROM x JOIN known ON lower(x.block) = known.low""".replace("{clean}", clean_sql("word")))  # fmt: skip
def kw_block_entities(s, d):
    links, entities = _entities(s, d)
    t = table(s, d, "article", "url_id", "title").distinct().filter("title is not null")
    return keywords.block_entities(t, "url_id", "title", links, entities).select("url_id", "entity_id", "keyword", "type", "strength")


@query(r"""WITH p AS (SELECT DISTINCT url_id, paragraph FROM article WHERE paragraph IS NOT NULL), s AS (SELECT url_id, unnest(string_split(regexp_replace(t, '([.!?][”"’)]?)\s+([\p{Lu}“"¿¡])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM (SELECT url_id, unnest(paragraph) AS t FROM p))
    SELECT url_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS characters FROM s WHERE trim(s) <> '' GROUP BY 1""")
def kw_sentences(s, d):
    p = table(s, d, "article", "url_id", "paragraph").distinct().select("url_id", F.explode("paragraph").alias("t")).select("url_id", F.explode(keywords.sentences(F.col("t"))).alias("s"))
    return p.groupBy("url_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("characters"))


@query(r"""WITH g AS (SELECT lower(k.keyword) AS low, min(k.type) AS type FROM (SELECT unnest(keyword) AS k FROM article) GROUP BY 1),
    a AS (SELECT DISTINCT url_id, paragraph[1:CAST(ceil(len(paragraph) * 2 / 3) AS INTEGER)] AS p FROM article WHERE paragraph IS NOT NULL), e AS (SELECT url_id, pos AS n, p[pos] AS t FROM (SELECT url_id, p, unnest(range(1, len(p) + 1)) AS pos FROM a)),
    s AS (SELECT url_id, n, unnest(string_split(regexp_replace(t, '([.!?][”"’)]?)\s+([\p{Lu}“"¿¡])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM e),
    r AS (SELECT url_id, n, unnest(regexp_extract_all(s, '\p{Lu}[\p{L}\p{M}’''-]*(?: (?:& )?\p{Lu}[\p{L}\p{M}’''-]*)*')) AS k FROM s WHERE trim(s) <> ''), src AS (SELECT DISTINCT k AS word FROM r), @@,
    c2 AS (SELECT r.url_id, r.n, f.clean AS keyword, count(*) AS c FROM r JOIN kf f ON r.k = f.k WHERE f.clean <> '' GROUP BY 1, 2, 3), h AS (SELECT c2.*, g.type, CASE g.type WHEN 'l' THEN 3 ELSE 5 END AS st, CASE g.type WHEN 'l' THEN 15 ELSE 20 END AS mx FROM c2 JOIN g ON lower(c2.keyword) = g.low WHERE g.type IN ('p', 'o', 'l'))
    SELECT url_id, CAST(n AS INTEGER) AS paragraph_number, keyword, type, CAST(CASE WHEN c = 1 THEN greatest(1, st - n) ELSE least(mx, greatest(1, st - n) + st * (c - 1)) END AS INTEGER) AS strength FROM h WHERE length(keyword) BETWEEN 2 AND 50""".replace("@@", clean_sql("word")))
def kw_names(s, d):
    a = table(s, d, "article", "url_id", "paragraph", "keyword")
    known = a.select(F.explode("keyword").alias("k")).select("k.keyword", "k.type")
    return keywords.found_names(a.select("url_id", "paragraph").distinct(), "url_id", "paragraph", known)


@query(r"""WITH a AS (SELECT DISTINCT url_id, list_transform(keyword, lambda k: k.keyword) AS ks, coalesce(title, '') AS body FROM article WHERE keyword IS NOT NULL), m AS (SELECT url_id, body, CASE WHEN length(url_id) % 2 = 0 THEN ',' ELSE ';' END AS sep, ks FROM a),
    w AS (SELECT url_id, body, unnest(ks) AS k FROM m) SELECT DISTINCT url_id, k AS keyword FROM w WHERE k <> '' AND len(list_intersect(string_split_regex(lower(k), '[^\p{L}\p{N}]+'), string_split_regex(lower(body), '[^\p{L}\p{N}]+'))) > 0""")
def kw_meta(s, d):
    a = table(s, d, "article", "url_id", "keyword", "title").filter("keyword is not null").distinct()
    raw = F.array_join("keyword.keyword", ", ")
    return a.select("url_id", F.explode(html.meta_keywords(raw, F.coalesce("title", F.lit("")))).alias("keyword")).distinct()


@query()
def kw_canonical(s, d):
    """Keywords of each article in one form: the merges depend on their order, so brute force in the tests stands in for SQL."""
    links, entities = _entities(s, d)
    k = table(s, d, "article", "url_id", "keyword").dropDuplicates(["url_id"]).select("url_id", F.posexplode("keyword").alias("ord", "k"))
    return keywords.canonical_keywords(k.select("url_id", "ord", "k.keyword", "k.type", "k.strength", "k.paragraph_number"), "url_id", links, entities, _depths(s))


@query("""WITH e AS (SELECT p_name AS keyword, p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS importance, p_partkey % 3 AS topics, ['t', 'p', 'o', 'l'][1 + p_partkey % 4] AS type, [1, 3, 3, 2][1 + p_partkey % 4] AS depth FROM part)
    SELECT keyword, id FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY importance DESC NULLS LAST, topics DESC, depth DESC, id) AS n FROM e) WHERE n = 1""")
def win_best_entity(s, d):
    k = F.col("p_partkey")
    e = table(s, d, "part", "p_partkey", "p_name", "p_size").select(F.col("p_name").alias("keyword"), k.alias("id"), F.when(k % 4 != 0, F.col("p_size")).alias("importance"), (k % 3).alias("topics"),
                                                                    F.get(F.array(*[F.lit(x) for x in "tpol"]), (k % 4).cast("int")).alias("type"))
    return keywords.best_entities(e, _depths(s)).select("keyword", "id")


@query("""WITH t AS (SELECT s_suppkey, s_name AS topic, CASE WHEN s_suppkey % 3 = 0 THEN 'short' END AS subtopic, n_name AS type, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey, type FROM t WHERE subtopic IS NULL AND r IN ('EUROPE', 'ASIA') AND length(topic) <= 255""")
def ent_valuable(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    up = J.closure(n.select(F.col("n_name").alias("c"), F.col("r_name").alias("p")), "c", "p")
    t = table(s, d, "supplier", "s_suppkey", "s_name", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    t = t.select("s_suppkey", F.col("s_name").alias("topic"), F.when(F.col("s_suppkey") % 3 == 0, "short").alias("subtopic"), F.col("n_name").alias("type"))
    return keywords.valuable_entities(t, up, ["EUROPE", "ASIA"]).select("s_suppkey", "type")


# ---------------------------------------------------------------- joins, aggregates and windows

@query("""WITH f AS (SELECT user_id, url_id, min(create_time) AS t FROM user_action WHERE action_type = 'FAVORITE' AND url_id IS NOT NULL GROUP BY 1, 2), k AS (SELECT * FROM f WHERE url_id IN (SELECT url_id FROM article WHERE retain IS DISTINCT FROM true))
    SELECT user_id, url_id, t AS create_time, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t DESC, url_id) AS INTEGER) AS rank FROM k""")
def jn_favourites(s, d):
    f = table(s, d, "user_action", "user_id", "url_id", "create_time", "action_type").filter("action_type = 'FAVORITE' and url_id is not null")
    u = f.groupBy("user_id").agg(F.collect_list(F.struct("url_id", "create_time")).alias("url_favorite"))
    return accounts.favourites(u, "user_id", "url_favorite", table(s, d, "article", "url_id", "retain").filter("not coalesce(retain, false)"))


@query("""WITH x AS (SELECT user_id, id, create_time, 0 AS source FROM (SELECT DISTINCT user_id, id, create_time FROM user_action WHERE action_type = 'TAP_FROM_STREAM') UNION ALL SELECT user_id, id, create_time, 1 FROM (SELECT DISTINCT user_id, id, create_time FROM user_action WHERE action_type = 'SHARE'))
    SELECT user_id, id, source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY create_time DESC NULLS LAST, source, id) AS INTEGER) AS rank FROM x""")
def jn_interleaved(s, d):
    a = table(s, d, "user_action", "user_id", "id", "create_time", "action_type").distinct()
    parts = [a.filter(F.col("action_type") == t).drop("action_type") for t in ("TAP_FROM_STREAM", "SHARE")]
    return J.interleaved(parts, "user_id", "create_time", "id").select("user_id", "id", "source", "rank")


@query("""SELECT o_orderkey, b AS band FROM orders JOIN (SELECT r AS b, r * 20000 AS lo, r * 20000 + 15000 AS hi FROM range(0, 30) t(r)) ON o_totalprice >= lo AND o_totalprice <= hi""")
def jn_range_lookup(s, d):
    bands = s.range(30).select(F.col("id").alias("band"), (F.col("id") * 20_000).alias("lo"), (F.col("id") * 20_000 + 15_000).alias("hi"))
    return J.range_lookup(table(s, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", bands, "lo", "hi", 10_000).select("o_orderkey", "band")


@query(f"WITH {_ENT}, c AS (SELECT entity_id, sum(n) AS n FROM lnk GROUP BY 1) SELECT ent.id, CAST(1 + c.n // 2 + 25 AS BIGINT) AS importance FROM ent JOIN c ON ent.id = c.entity_id")
def agg_entity_importance(s, d):
    links, entities = _entities(s, d)
    c = links.groupBy("entity_id").agg(F.sum("n").alias("c"))
    return entities.join(c, entities.id == c.entity_id).select("id", (1 + F.floor(F.col("c") / 2) + 25).alias("importance"))


@query("""WITH f AS (SELECT s_name AS name, s_suppkey + 1 AS rank FROM supplier WHERE s_suppkey < 50), l AS (SELECT s_name AS name FROM supplier WHERE s_suppkey % 3 = 0), b AS (SELECT s_name AS name, s_suppkey // 7 + 1 AS brand FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey < 700),
    a AS (SELECT name FROM f UNION SELECT name FROM l UNION SELECT name FROM b) SELECT a.name, CAST(CASE WHEN brand IS NULL THEN coalesce(551 - rank, 20) ELSE greatest(100, coalesce(551 - rank, 20)) + 120 - brand END AS BIGINT) AS score FROM a LEFT JOIN f USING (name) LEFT JOIN b USING (name)""")
def agg_company_scores(s, d):
    x = table(s, d, "supplier", F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    f, listed, b = x.filter("k < 50").select("name", (F.col("k") + 1).alias("rank")), x.filter("k % 3 = 0").select("name"), x.filter("k % 7 = 0 and k < 700").select("name", F.floor(F.col("k") / 7 + 1).alias("brand"))
    base = F.coalesce(551 - F.col("rank"), F.lit(20))
    out = listed.join(f, "name", "full").join(b, "name", "full")
    return out.select("name", F.when(F.col("brand").isNull(), base).otherwise(F.greatest(F.lit(100), base) + 120 - F.col("brand")).cast("bigint").alias("score"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (action_type = 'READ_ARTICLE') AS reads, count(DISTINCT create_time // 3600000) AS uses FROM user_action GROUP BY 1) SELECT user_id, reads FROM u WHERE uses >= 5 ORDER BY reads DESC, user_id LIMIT 50""")
def agg_reads_of_active(s, d):
    a = table(s, d, "user_action", "user_id", "action_type", "create_time")
    u = a.groupBy("user_id").agg(F.count_if(F.col("action_type") == "READ_ARTICLE").alias("reads"), F.count_distinct(F.floor(F.col("create_time") / 3_600_000)).alias("uses"))
    return u.filter("uses >= 5").select("user_id", "reads").orderBy(F.desc("reads"), "user_id").limit(50)


@query("""WITH art AS (SELECT url_id, any_value(keyword) AS keyword, any_value(feature) AS feature FROM article GROUP BY 1), t AS (SELECT DISTINCT user_id, url_id FROM user_action WHERE action_type = 'TAP_FROM_STREAM'), fav AS (SELECT DISTINCT user_id, url_id FROM user_action WHERE action_type = 'FAVORITE'),
    fk AS (SELECT DISTINCT user_id, lower(k.keyword) AS low FROM (SELECT user_id, unnest(keyword) AS k FROM fav JOIN art USING (url_id))), ff AS (SELECT DISTINCT user_id, f.feature_id AS id FROM (SELECT user_id, unnest(feature) AS f FROM fav JOIN art USING (url_id))),
    k AS (SELECT user_id, lower(k.keyword) AS topic, count(*) AS n FROM (SELECT user_id, unnest(keyword) AS k FROM t JOIN art USING (url_id)) WHERE k.type IN ('p', 'o') GROUP BY 1, 2), f AS (SELECT user_id, f.feature_id AS id, count(*) AS n FROM (SELECT user_id, unnest(feature) AS f FROM t JOIN art USING (url_id)) GROUP BY 1, 2),
    b AS (SELECT user_id, 0 AS kind, topic, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, topic) AS r FROM k ANTI JOIN fk ON k.user_id = fk.user_id AND k.topic = fk.low
      UNION ALL SELECT user_id, 1, CAST(id AS VARCHAR), n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, CAST(id AS VARCHAR)) FROM f ANTI JOIN ff ON f.user_id = ff.user_id AND f.id = ff.id),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind, r) AS rank FROM b WHERE r <= CASE kind WHEN 0 THEN 5 ELSE 3 END) SELECT user_id, kind, topic, n, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 5""")
def agg_explore_topics(s, d):
    """Topics that a reader's articles name most and that the reader doesn't follow: five persons and organisations, then three features, five in all."""
    art = table(s, d, "article", "url_id", "keyword", "feature").dropDuplicates(["url_id"])
    acts = table(s, d, "user_action", "user_id", "url_id", "action_type").distinct()
    mine = acts.filter("action_type = 'TAP_FROM_STREAM'").join(art, "url_id")
    liked = acts.filter("action_type = 'FAVORITE'").join(art, "url_id")
    k = mine.select("user_id", F.explode("keyword").alias("k")).filter(F.col("k.type").isin("p", "o")).select("user_id", F.lit(0).alias("kind"), F.lower("k.keyword").alias("topic"))
    f = mine.select("user_id", F.explode("feature").alias("f")).select("user_id", F.lit(1).alias("kind"), F.col("f.feature_id").cast("string").alias("topic"))
    known = liked.select("user_id", F.lit(0).alias("kind"), F.explode(F.transform("keyword", lambda x: F.lower(x["keyword"]))).alias("topic"))
    known = known.unionByName(liked.select("user_id", F.lit(1).alias("kind"), F.explode(F.transform("feature", lambda x: x["feature_id"].cast("string"))).alias("topic"))).distinct()
    n = k.unionByName(f).groupBy("user_id", "kind", "topic").agg(F.count("*").alias("n")).join(known, ["user_id", "kind", "topic"], "left_anti")
    best = A.top_per_group(n, ["user_id", "kind"], [F.desc("n"), F.asc("topic")], 5, "r").filter("kind = 0 or r <= 3")
    return A.top_per_group(best, ["user_id"], [F.asc("kind"), F.asc("r")], 5).drop("r")


@query("""WITH a AS (SELECT origin, url_id, max(image_url) AS image, max(published_time) AS t FROM article WHERE origin IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY t DESC NULLS LAST, url_id) AS r FROM a),
    f AS (SELECT origin, min(r) AS first FROM r WHERE image IS NOT NULL GROUP BY 1) SELECT r.origin, url_id, CAST(CASE WHEN r.r = f.first THEN 1 WHEN r.r < f.first THEN r.r + 1 ELSE r.r END AS INTEGER) AS rank FROM r LEFT JOIN f USING (origin)""")
def srt_first_image_first(s, d):
    a = table(s, d, "article", "origin", "url_id", "image_url", "published_time").filter("origin is not null").groupBy("origin", "url_id").agg(F.max("image_url").alias("image"), F.max("published_time").alias("t"))
    return R.image_first(a, "origin", [F.desc_nulls_last("t"), F.asc("url_id")], F.col("image").isNotNull()).select("origin", "url_id", "rank")


@query("""WITH x AS (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(CASE WHEN n = 1 OR event_type <> b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS island FROM x),
    r AS (SELECT *, count(*) OVER (PARTITION BY user_id, island) AS length, row_number() OVER (PARTITION BY user_id, island ORDER BY value DESC NULLS LAST, event_id) AS k FROM i) SELECT user_id, CAST(island AS BIGINT) AS island, event_id, length FROM r WHERE k = 1""")
def win_best_of_islands(s, d):
    e = table(s, d, "events", "user_id", "event_id", "event_type", "ts", "value")
    return A.best_of_islands(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type"), F.col("value"), "event_id").select("user_id", F.col("island").cast("bigint").alias("island"), "event_id", "length")


@query("""WITH a AS (SELECT DISTINCT user_id, id, create_time AS t, CASE WHEN action_type = 'TAP_FROM_STREAM' THEN create_time + 60000 END AS click FROM user_action WHERE create_time IS NOT NULL),
    w AS (SELECT *, count(click) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0 AS later, last_value(click IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM a)
    SELECT user_id, id FROM w WHERE later OR (abs(t - last) < 172800000 AND 1450000000000 - t < 28800000)""")
def win_applicable(s, d):
    a = table(s, d, "user_action", "user_id", "id", "create_time", "action_type").filter("create_time is not null").distinct()
    a = a.withColumn("click_time", F.when(F.col("action_type") == "TAP_FROM_STREAM", F.col("create_time") + 60_000))
    return A.applicable(a, ["user_id"], "create_time", "id", "click_time", 1_450_000_000_000).select("user_id", "id")


# ---------------------------------------------------------------- functions and scores

@query("SELECT DISTINCT id, rtrim(replace(replace(base64(encode(create_time || '/' || user_id || '/' || sha1('salt' || create_time || '/' || user_id))), '+', '-'), '/', '_'), '=') AS key, user_id AS verified, CAST(NULL AS VARCHAR) AS forged FROM user_action WHERE create_time IS NOT NULL")
def fn_session_key(s, d):
    a = table(s, d, "user_action", "id", "user_id", "create_time").filter("create_time is not null").distinct()
    a = a.withColumn("key", accounts.session_key(F.col("create_time"), F.col("user_id"), "salt"))
    return a.select("id", "key", accounts.session_user(F.col("key"), "salt").alias("verified"), accounts.session_user(F.col("key"), "other").alias("forged"))


@query("SELECT DISTINCT url_id, f.feature_id AS feature_id, round(greatest(0, 3 * f.similarity - 2), 6) AS similarity FROM (SELECT url_id, unnest(feature) AS f FROM article)")
def fn_rescaled(s, d):
    f = table(s, d, "article", "url_id", "feature").select("url_id", F.inline("feature")).distinct()
    return f.select("url_id", "feature_id", F.round(V.rescaled(F.col("similarity")), 6).alias("similarity"))


@query(f"""WITH r AS (SELECT origin, count(*) AS instances, count(*) FILTER (action_type = 'TAP_FROM_STREAM') AS clicks FROM user_action JOIN (SELECT DISTINCT url_id, origin FROM article WHERE origin IS NOT NULL) USING (url_id) GROUP BY 1), x AS (SELECT *, clicks / instances AS rate FROM r),
    q AS (SELECT quantile_cont(rate, [{', '.join(str(p) for p in A.PERCENTILES)}]) AS v FROM x), z AS (SELECT CAST([{', '.join(str(p) for p in A.PERCENTILES)}][i] AS DOUBLE) AS p, v[i] AS v FROM (SELECT v, unnest(range(1, {len(A.PERCENTILES) + 1})) AS i FROM q)),
    w AS (SELECT origin, instances, clicks, rate, max(CASE WHEN z.v <= rate THEN p END) AS lp, max(CASE WHEN z.v <= rate THEN z.v END) AS lv, min(CASE WHEN z.v >= rate THEN p END) AS hp, min(CASE WHEN z.v >= rate THEN z.v END) AS hv FROM x, z GROUP BY ALL)
    SELECT origin, instances, clicks, round(CASE WHEN instances < 50 OR clicks < 5 THEN 0.4 WHEN hp IS NULL THEN 1.0 WHEN lp IS NULL THEN 0.0 WHEN hv = lv THEN lp ELSE lp + (rate - lv) / (hv - lv) * (hp - lp) END, 6) AS rating FROM w""")
def agg_rated_sites(s, d):
    """Click rates of sites as quantiles among all sites; what rests on too little has the default."""
    a = table(s, d, "user_action", "url_id", "action_type").join(table(s, d, "article", "url_id", "origin").filter("origin is not null").distinct(), "url_id")
    rated = A.rated(written(A.click_through(a, ["origin"], F.col("action_type") == "TAP_FROM_STREAM"), "rates"))
    out = J.default_rating(rated.drop("rating"), rated, "origin", "rating", 0.4, lambda: (F.col("instances") >= 50) & (F.col("clicks") >= 5))
    return out.select("origin", "instances", "clicks", F.round("rating", 6).alias("rating"))


@query("SELECT round(avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END), 6) AS ratio, count(value) AS n FROM events")
def vec_ratio_above(s, d):
    return V.ratio_above(table(s, d, "events", "value"), F.col("value"), 100.0).select(F.round("ratio", 6).alias("ratio"), "n")


_LATEST = """a AS (SELECT url_id, any_value(origin) AS origin, any_value(published_time) AS p, any_value(social_engagement) AS se FROM article GROUP BY 1), e AS (SELECT url_id, origin, p, e FROM (SELECT url_id, origin, p, unnest(se) AS e FROM a) WHERE e.site = 'FACEBOOK'),
    l AS (SELECT url_id, any_value(origin) AS origin, any_value(p) AS p, max_by(e.share_count, e.create_time) AS c, max(e.create_time) AS t FROM e GROUP BY 1), r AS (SELECT url_id, origin, c, t - p AS age FROM l),"""


def _latest_shares(s, d):
    a = table(s, d, "article", "url_id", "origin", "published_time", "social_engagement").dropDuplicates(["url_id"]).select("url_id", "origin", "published_time", F.inline("social_engagement")).filter("site = 'FACEBOOK'")
    last = a.groupBy("url_id").agg(F.first("origin").alias("origin"), F.first("published_time").alias("p"), F.max_by("share_count", "create_time").alias("c"), F.max("create_time").alias("t"))
    return last.select("url_id", "origin", "c", (F.col("t") - F.col("p")).alias("age"))


_ENDS = ", ".join(map(str, engagement.AGE_ENDS))
_POINTS = ", ".join(str(p) for p in A.PERCENTILES)
_SHARES = f"""{_LATEST} k AS (SELECT origin, count(*) AS a, sum(c) AS s FROM r WHERE origin IS NOT NULL AND c IS NOT NULL GROUP BY 1), g AS (SELECT sum(a) AS a, sum(s) AS s FROM k),
    n AS (SELECT r.url_id, r.origin, r.c, r.age, CASE WHEN r.origin IS NOT NULL AND r.c IS NOT NULL THEN CAST(floor(CASE WHEN k.s > 0 THEN least(r.c, r.c * ((g.s / g.a) / (k.s / k.a))) ELSE r.c END) AS BIGINT) END AS normal, list_min(list_filter([{_ENDS}], lambda e: e > greatest(r.age, 0))) AS stop FROM r LEFT JOIN k USING (origin), g),
    q AS (SELECT stop, quantile_cont(CAST(normal AS DOUBLE), [{_POINTS}]) AS v FROM (SELECT b.stop, n.normal FROM n JOIN (SELECT unnest([{_ENDS}]) AS stop) b ON greatest(n.age, 0) < b.stop WHERE n.normal IS NOT NULL) GROUP BY 1),
    z AS (SELECT stop, CAST([{_POINTS}][i] AS DOUBLE) AS p, v[i] AS v FROM (SELECT stop, v, unnest(range(1, {len(A.PERCENTILES) + 1})) AS i FROM q)),
    w AS (SELECT n.url_id, any_value(n.normal) AS normal, max(CASE WHEN z.v <= n.normal THEN z.p END) AS lp, max(CASE WHEN z.v <= n.normal THEN z.v END) AS lv, min(CASE WHEN z.v >= n.normal THEN z.p END) AS hp, min(CASE WHEN z.v >= n.normal THEN z.v END) AS hv FROM n LEFT JOIN z ON n.stop = z.stop GROUP BY 1),
    sc AS (SELECT url_id, normal, CASE WHEN normal IS NULL THEN NULL WHEN hp IS NULL THEN 1.0 WHEN lp IS NULL THEN 0.0 WHEN hv = lv THEN lp ELSE lp + (normal - lv) / (hv - lv) * (hp - lp) END AS score FROM w)"""


@query(f"WITH {_SHARES} SELECT url_id, normal, round(score, 6) AS share_score FROM sc")
def vec_share_score(s, d):
    return engagement.share_scores(_latest_shares(s, d), "origin", "c", "age").select("url_id", "normal", F.round("share_score", 6).alias("share_score"))


@query(f"WITH {_SHARES}, o AS (SELECT url_id, unnest(list_transform(list_filter(any_value(social_engagement), lambda x: x.site = 'FACEBOOK'), lambda x: struct_pack(t := x.create_time, old := x.share_score))) AS x FROM article GROUP BY 1) SELECT o.url_id, x.t AS create_time, round(coalesce(sc.score, x.old), 6) AS share_score FROM o LEFT JOIN sc USING (url_id)")
def agg_renormalised(s, d):
    """Engagements of one site with scores made anew from all of them, within the articles' arrays."""
    scores = engagement.share_scores(_latest_shares(s, d), "origin", "c", "age").select("url_id", F.col("share_score").alias("new"))
    a = table(s, d, "article", "url_id", "social_engagement").dropDuplicates(["url_id"]).join(scores, "url_id", "left")
    fresh = F.transform("social_engagement", lambda e: e.withField("share_score", F.when(e["site"] == "FACEBOOK", F.coalesce("new", e["share_score"])).otherwise(e["share_score"])))
    out = a.select("url_id", F.inline(fresh)).filter("site = 'FACEBOOK'")
    return out.select("url_id", "create_time", F.round("share_score", 6).alias("share_score"))


_BOOSTS = "(1, NULL, 'm', NULL, NULL, 2), (2, 10004, NULL, '/2014/', NULL, 4), (3, NULL, NULL, NULL, 'id=[0-9]*7$', 1), (4, 10010, 'www', '-[0-9]*5$', NULL, -3)"
_BOOST_SQL = f"""pat AS (SELECT * FROM (VALUES {_BOOSTS}) t(ord, feature_id, sub, path_regex, query_regex, boost)), dom AS (SELECT short_name, root_domain, unnest(list_distinct(list_concat([root_domain], coalesce(aka_root_domain, [])))) AS domain FROM site_manifest),
    a AS (SELECT url_id, any_value(url) AS url FROM article GROUP BY 1), u AS (SELECT url_id, {_HOST_SQL} AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM a),
    hit AS (SELECT u.*, d.root_domain, row_number() OVER (PARTITION BY url_id ORDER BY length(d.domain) DESC NULLS LAST) AS n FROM u LEFT JOIN dom d ON u.h = d.domain OR ends_with(u.h, '.' || d.domain)),
    f AS (SELECT url_id, h, p, q, root_domain, fid FROM hit, (SELECT unnest([10004, 10010]) AS fid) WHERE n = 1),
    b AS (SELECT f.url_id, f.fid AS feature_id, coalesce(max_by(pat.boost, pat.ord), 0) AS boost FROM f LEFT JOIN pat ON f.root_domain IS NOT NULL AND (pat.feature_id IS NULL OR pat.feature_id = f.fid) AND (pat.sub IS NULL OR f.h = pat.sub || '.' || f.root_domain OR ends_with(f.h, '.' || pat.sub || '.' || f.root_domain))
      AND (pat.path_regex IS NULL OR regexp_matches(f.p, pat.path_regex)) AND (pat.query_regex IS NULL OR regexp_matches(f.q, pat.query_regex)) GROUP BY 1, 2)"""


def _boosted(s, d):
    m = table(s, d, "site_manifest", "short_name", "root_domain", "aka_root_domain")
    rows = s.sql(f"SELECT * FROM (VALUES {_BOOSTS}) t(ord, feature_id, sub, path_regex, query_regex, boost)")
    pats = m.select("short_name", "root_domain").join(F.broadcast(rows)).select("short_name", "ord", "feature_id", F.when(F.col("sub").isNotNull(), F.concat_ws(".", "sub", "root_domain")).alias("subdomain"), "path_regex", "query_regex", "boost")  # four fixed rules a site
    a = table(s, d, "article", "url_id", "url").dropDuplicates(["url_id"]).withColumn("feature_id", F.explode(F.array(F.lit(10004), F.lit(10010))))
    return sites.feature_boosts(a, "url", "feature_id", pats, m)


@query(f"WITH {_BOOST_SQL} SELECT url_id, feature_id, boost FROM b")
def vec_feature_boost(s, d):
    return _boosted(s, d).select("url_id", "feature_id", "boost")


@query(f"""WITH {_BOOST_SQL}, v AS (SELECT url_id, max(list_max(list_transform(feature, lambda x: x.similarity))) AS v FROM article GROUP BY 1), q AS (SELECT quantile_cont(v, [{_POINTS}]) AS v FROM v WHERE v IS NOT NULL),
    z AS (SELECT CAST([{_POINTS}][i] AS DOUBLE) AS p, v[i] AS v FROM (SELECT v, unnest(range(1, {len(A.PERCENTILES) + 1})) AS i FROM q)),
    w AS (SELECT v.url_id, v.v AS x, max(CASE WHEN z.v <= v.v THEN p END) AS lp, max(CASE WHEN z.v <= v.v THEN z.v END) AS lv, min(CASE WHEN z.v >= v.v THEN p END) AS hp, min(CASE WHEN z.v >= v.v THEN z.v END) AS hv FROM v, z GROUP BY 1, 2),
    g AS (SELECT url_id, x, CASE WHEN x IS NULL THEN NULL WHEN hp IS NULL THEN 1.0 WHEN lp IS NULL THEN 0.0 WHEN hv = lv THEN lp ELSE lp + (x - lv) / (hv - lv) * (hp - lp) END AS q FROM w),
    h AS (SELECT b.url_id, b.feature_id, greatest(0, least(1, g.q + b.boost / 100.0)) AS q, g.x FROM b JOIN g USING (url_id))
    SELECT url_id, feature_id, round(CASE WHEN x IS NULL THEN 0.0 WHEN q < 0.4 THEN q / 0.4 * 0.78 WHEN q < 0.7 THEN 0.78 + (q - 0.4) / 0.3 * 0.145 ELSE 0.925 + (q - 0.7) / 0.3 * 0.075 END, 6) AS score FROM h""")
def vec_feature_score(s, d):
    v = table(s, d, "article", "url_id", "feature").groupBy("url_id").agg(F.max(F.array_max(F.transform("feature", lambda x: x["similarity"]))).alias("v"))
    v = written(v, "similarities")
    dist = A.distributions(v, [], F.col("v")).select("distribution").scalar()
    both = _boosted(s, d).join(v, "url_id").withColumn("d", dist)
    return both.select("url_id", "feature_id", F.round(V.feature_score(F.col("v"), F.col("d"), F.col("boost"), F.lit(0.4), F.lit(0.7)), 6).alias("score"))


@query("""WITH l AS (SELECT DISTINCT url_id, published_time, feature FROM article ORDER BY published_time DESC NULLS LAST, url_id LIMIT 500), f AS (SELECT url_id, list_filter(feature, lambda f: f.feature_id = 10022)[1].similarity AS s FROM l)
    SELECT url_id, s AS similarity FROM f WHERE s IS NOT NULL ORDER BY s DESC, url_id LIMIT 100""")
def vec_top_for_feature(s, d):
    """The 100 articles that fit a feature best among the newest 500: both bounds are the report's."""
    few = table(s, d, "article", "url_id", "published_time", "feature").distinct().orderBy(F.desc_nulls_last("published_time"), "url_id").limit(500)
    f = few.select("url_id", F.get(F.filter("feature", lambda x: x["feature_id"] == 10022), F.lit(0))["similarity"].alias("similarity"))
    return f.filter("similarity is not null").orderBy(F.desc("similarity"), "url_id").limit(100)


@query("""SELECT url_id, published_time, CASE WHEN (coalesce(retain, false) OR (published_time >= 1400000000000 AND published_time < 1420000000000)) AND word_count > 200 THEN 10099 ELSE feature[1].feature_id END AS feature_id FROM article""")
def vec_reclassified(s, d):
    a = table(s, d, "article", "url_id", "published_time", "feature", "retain", "word_count")
    new = a.filter("word_count > 200").select("url_id", F.array(F.struct(F.lit(10099).alias("feature_id"), F.lit(1.0).alias("similarity"))).alias("feature")).dropDuplicates(["url_id"])
    out = V.reclassified(a.drop("word_count"), new, "url_id", 1_400_000_000_000, 1_420_000_000_000)
    return out.select("url_id", "published_time", F.get("feature", F.lit(0))["feature_id"].alias("feature_id"))


@query("""WITH a AS (SELECT DISTINCT user_id, id, url_id, create_time AS t, read_start_time AS r, action_type FROM user_action WHERE create_time IS NOT NULL), b AS (SELECT url_id, max(list_max(list_transform(feature, lambda f: f.similarity))) AS best, any_value(published_time) AS p FROM article GROUP BY 1)
    SELECT id, round(coalesce(b.best, 0), 6) AS best, round(least(greatest(floor(coalesce(a.t - b.p, 14677151) / 1800000), 0), 48) / 48.0, 6) AS age, CAST(CASE WHEN r IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS opened, action_type = 'TAP_FROM_STREAM' AS label FROM a LEFT JOIN b USING (url_id)""")
def vec_training_set(s, d):
    """Inputs and label of every notification; an unknown age is put in as the mean of the unclicked ones."""
    a = table(s, d, "user_action", "user_id", "id", "url_id", "create_time", "read_start_time", "action_type").filter("create_time is not null").distinct()
    b = table(s, d, "article", "url_id", "published_time", "feature").groupBy("url_id").agg(F.max(F.array_max(F.transform("feature", lambda f: f["similarity"]))).alias("best"), F.first("published_time").alias("p"))
    age = F.coalesce(F.col("create_time") - F.col("p"), F.lit(13_777_151 + 900_000))
    steps = F.least(F.greatest(F.floor(age / 1_800_000), F.lit(0)), F.lit(48)) / 48
    return a.join(b, "url_id", "left").select("id", F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"), F.round(steps, 6).alias("age"), F.when(F.col("read_start_time").isNull(), 0.0).otherwise(1.0).alias("opened"), (F.col("action_type") == "TAP_FROM_STREAM").alias("label"))


@query("""WITH x AS (SELECT user_id, create_time, count(*) FILTER (action_type = 'TAP_FROM_STREAM') AS taps FROM user_action GROUP BY 1, 2), l AS (SELECT user_id, max(create_time) AS last FROM user_action GROUP BY 1)
    SELECT DISTINCT url_id, round(1 / (1 + greatest(0, (1480000000000 - coalesce(published_time, 0)) / 3600000.0 - least(CASE WHEN length(url_id) % 2 = 0 THEN 42.0 ELSE 18.0 END, coalesce(word_count, 0) / 10.0)) / 24), 9) AS decay FROM article""")
def rank_main_decay(s, d):
    a = table(s, d, "article", "url_id", "published_time", "word_count").distinct()
    age = (F.lit(1_480_000_000_000) - F.coalesce(F.col("published_time"), F.lit(0))) / R.HOUR
    away = F.coalesce("word_count", F.lit(0)) / 10
    return a.select("url_id", F.round(R.main_decay(age, away, F.length("url_id") % 2 == 0), 9).alias("decay")).distinct()


# ---------------------------------------------------------------- streams of entities and contacts

def _by_names(s, d, names, score):
    """Articles that name a stream's keywords, ready to be ranked: names are (stream, keyword)."""
    a = J.first_wins(table(s, d, "article", "url_id", "url", "title", "keyword", "feature", "published_time", "crawl_time", "social_engagement"), ["url_id"], [F.asc("crawl_time")])
    fb, tw = R.latest_engagement(F.col("social_engagement"), "FACEBOOK"), R.latest_engagement(F.col("social_engagement"), "TWITTER")
    ready = a.select("url_id", F.coalesce("published_time", F.lit(0)).alias("time"), text.deduping_stems(F.col("title")).alias("stems"), fb["share_score"].alias("share_score"), tw["share_score"].alias("second_score"), "feature",
                     F.array_distinct(F.transform(F.filter("keyword", lambda k: k["strength"] > 30), lambda k: F.lower(k["keyword"]))).alias("keywords"), F.transform(V.kept_features(F.col("feature"), 0.0, 3), lambda f: f["feature_id"]).alias("features"),
                     urls.domain(F.col("url")).alias("domain"), F.array_distinct(F.transform("keyword", lambda k: F.lower(k["keyword"]))).alias("named"))
    met = ready.withColumn("keyword", F.explode("named")).join(names, "keyword")
    return met.withColumn("score", F.round(score, 9)).withColumn("rank_score", F.round(F.col("score") * R.decay((F.lit(1_480_000_000_000) - F.col("time")) / R.HOUR, 168.0, 24.0), 12)).drop("keyword", "named", "feature").distinct()


def _top_entities(s, d):
    """Entities named by five articles or more, each with its three most frequent features."""
    f = table(s, d, "article", "url_id", "keyword", "feature").dropDuplicates(["url_id"]).select(F.explode(F.array_distinct(F.transform("keyword", lambda k: F.lower(k["keyword"])))).alias("keyword"), "url_id", "feature")
    often = f.groupBy("keyword").agg(F.count("*").alias("n")).filter("n >= 5").select("keyword")
    top = A.top_per_group(f.join(often, "keyword").select("keyword", F.inline("feature")).groupBy("keyword", "feature_id").agg(F.count("*").alias("c")), ["keyword"], [F.desc("c"), F.asc("feature_id")], 3)
    tops = top.groupBy("keyword").agg(F.array_sort(F.collect_list("feature_id")).alias("top"))
    return often.join(tops, "keyword", "left").select("keyword", F.col("keyword").alias("stream"), F.coalesce("top", F.array().cast("array<int>")).alias("top"))


_TOP_SQL = """a AS (SELECT url_id, arg_min(keyword, crawl_time) AS keyword, arg_min(feature, crawl_time) AS feature FROM article GROUP BY 1), k AS (SELECT DISTINCT url_id, lower(k.keyword) AS keyword FROM (SELECT url_id, unnest(keyword) AS k FROM a)), o AS (SELECT keyword FROM k GROUP BY 1 HAVING count(*) >= 5),
    f AS (SELECT keyword, f.feature_id AS id, count(*) AS c FROM (SELECT k.keyword, unnest(a.feature) AS f FROM k JOIN a ON k.url_id = a.url_id JOIN o ON k.keyword = o.keyword) GROUP BY 1, 2), t AS (SELECT keyword, list(id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY c DESC, id) AS r FROM f) WHERE r <= 3 GROUP BY 1)"""


@query(f"""WITH {_TOP_SQL} SELECT o.keyword AS stream, a.url_id, round(0.5 + 0.5 * coalesce(list_max(list_transform(list_filter(a.feature, lambda x: list_contains(coalesce(t.top, []), x.feature_id)), lambda x: x.similarity)), 0), 6) AS score
    FROM o JOIN k ON o.keyword = k.keyword JOIN a ON k.url_id = a.url_id LEFT JOIN t ON o.keyword = t.keyword""")
def rank_entity_candidates(s, d):
    best = F.coalesce(F.array_max(F.transform(F.filter("feature", lambda x: F.array_contains("top", x["feature_id"])), lambda x: x["similarity"])), F.lit(0.0))
    return _by_names(s, d, _top_entities(s, d), 0.5 + 0.5 * best).select("stream", "url_id", F.round("score", 6).alias("score"))


_ENTITY_SCORED = f"""{_TOP_SQL}, scored AS (SELECT DISTINCT o.keyword AS stream, ready.url_id, ready.time, ready.stems, ready.share_score, round(0.5 + 0.5 * coalesce(list_max(list_transform(list_filter(a.feature, lambda x: list_contains(coalesce(t.top, []), x.feature_id)), lambda x: x.similarity)), 0), 9) AS score
    FROM o JOIN k ON o.keyword = k.keyword JOIN a ON k.url_id = a.url_id JOIN ready ON ready.url_id = a.url_id LEFT JOIN t ON o.keyword = t.keyword)"""


@query(f"""WITH RECURSIVE {deduped_sql(stream_sql(153, _ENTITY_SCORED, "true", 168.0, 24.0))}
    SELECT stream, k.u AS url_id, k.s AS score, k.t AS time, k.w AS share_score, CAST(CASE WHEN k.hot > 0 THEN k.hot + 1 ELSE 0 END AS INTEGER) AS hot_count, k.old AS oldest, CAST(row_number() OVER (PARTITION BY stream ORDER BY k.s DESC, k.u) AS INTEGER) AS rank FROM kept QUALIFY rank <= 51""")
def rank_entity_streams(s, d):
    """The stream of every entity: its own top features stand for interests; duplicates out, no diversification."""
    best = F.coalesce(F.array_max(F.transform(F.filter("feature", lambda x: F.array_contains("top", x["feature_id"])), lambda x: x["similarity"])), F.lit(0.0))
    top = A.top_per_group(_by_names(s, d, _top_entities(s, d), 0.5 + 0.5 * best), ["stream"], [F.desc("rank_score"), F.asc("url_id")], 153).drop("rank")
    return A.top_per_group(R.dedupe_streams(top), ["stream"], [F.desc("score"), F.asc("url_id")], 51)


_CONTACTS_SQL = """p AS (SELECT DISTINCT lower(k.keyword) AS keyword FROM (SELECT unnest(keyword) AS k FROM article) WHERE k.type = 'p'), u AS (SELECT DISTINCT user_id FROM user_action WHERE action_type = 'SHARE'),
    n AS (SELECT user_id AS stream, keyword FROM u JOIN p ON ascii(keyword[1]) % 16 = ascii(user_id[-1]) % 16),"""


@query(f"""WITH {_CONTACTS_SQL} a AS (SELECT url_id, arg_min(keyword, crawl_time) AS keyword, arg_min(feature, crawl_time) AS feature FROM article GROUP BY 1), k AS (SELECT DISTINCT url_id, lower(k.keyword) AS keyword FROM (SELECT url_id, unnest(keyword) AS k FROM a))
    SELECT DISTINCT stream, url_id FROM n JOIN k USING (keyword) JOIN a USING (url_id) WHERE len(list_filter(a.feature, lambda f: f.feature_id BETWEEN 10000 AND 10020)) > 0""")
def rank_contacts(s, d):
    """Articles that name a reader's contacts and have a feature the reader follows."""
    p = table(s, d, "article", "keyword").select(F.explode("keyword").alias("k")).filter("k.type = 'p'").select(F.lower("k.keyword").alias("keyword")).distinct()
    u = table(s, d, "user_action", "user_id", "action_type").filter("action_type = 'SHARE'").select(F.col("user_id").alias("stream")).distinct()
    names = u.withColumn("__b", F.ascii(F.substring("stream", -1, 1)) % 16).join(p.withColumn("__b", F.ascii("keyword") % 16), "__b").drop("__b")
    c = _by_names(s, d, names, F.coalesce(F.array_max(F.transform("feature", lambda f: f["similarity"])), F.lit(0.0)) + F.when(F.exists("feature", lambda f: f["feature_id"].between(10000, 10020)), 1.0).otherwise(-100.0))
    return c.filter("score > 0").select("stream", "url_id").distinct()


# ---------------------------------------------------------------- changes, sources and streams

@query("""WITH c AS (SELECT user_id AS g, url_id AS k, action_type AS a, max(create_time) AS t FROM user_action WHERE action_type IN ('FAVORITE', 'X_OUT') AND url_id IS NOT NULL AND create_time IS NOT NULL GROUP BY 1, 2, 3),
    n AS (SELECT g, k, t, CASE a WHEN 'X_OUT' THEN 'TOMBSTONE' ELSE 'USER' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY t DESC, CASE a WHEN 'X_OUT' THEN 'thing' ELSE 'org' END) AS r FROM c) WHERE r = 1),
    i AS (SELECT DISTINCT user_id AS g, url_id AS k FROM user_action WHERE action_type = 'VOTE_UP' AND url_id IS NOT NULL)
    SELECT g, k, 'OLD' AS source FROM i ANTI JOIN n ON i.g = n.g AND i.k = n.k UNION ALL SELECT g, k, source FROM n""")
def dml_follow(s, d):
    """Interests (of kind company) after follows and unfollows of related kinds (organisation, thing)."""
    a = table(s, d, "user_action", "user_id", "url_id", "action_type", "create_time").filter("url_id is not null")
    have = a.filter("action_type = 'VOTE_UP'").select(F.col("user_id").alias("g"), F.col("url_id").alias("k"), F.lit("company").alias("kind"), F.lit("OLD").alias("source"), F.lit(0).cast("bigint").alias("create_time")).distinct()
    out = F.col("action_type") == "X_OUT"
    change = a.filter("action_type in ('FAVORITE', 'X_OUT') and create_time is not null").groupBy(F.col("user_id").alias("g"), F.col("url_id").alias("k"), F.when(out, "thing").otherwise("org").alias("kind"), F.when(out, "TOMBSTONE").otherwise("USER").alias("source")).agg(F.max("create_time").alias("create_time"))
    up = J.closure(s.createDataFrame([("company", "org"), ("org", "thing")], "c string, p string"), "c", "p")
    return accounts.follow(have, change, "g", "k", "kind", up).select("g", "k", "source")


@query("""WITH live AS (SELECT DISTINCT user_id, url_id, CASE WHEN action_type = 'SHARE' THEN 'person' ELSE 'company' END AS kind FROM user_action WHERE url_id IS NOT NULL AND action_type IN ('SHARE', 'TAP_FROM_STREAM')), dead AS (SELECT DISTINCT user_id, url_id FROM user_action WHERE action_type = 'X_OUT')
    SELECT user_id, url_id, kind FROM live WHERE kind = 'person' OR NOT EXISTS (SELECT 1 FROM dead WHERE dead.user_id = live.user_id AND dead.url_id = live.url_id)""")
def jn_conflict_kinds(s, d):
    """Interests without tombstones' conflicts: a tombstone of an organisation rules out companies, not persons."""
    a = table(s, d, "user_action", "user_id", "url_id", "action_type").filter("url_id is not null and action_type in ('SHARE', 'TAP_FROM_STREAM', 'X_OUT')").distinct()
    kind = F.when(F.col("action_type") == "SHARE", "person").when(F.col("action_type") == "X_OUT", "org").otherwise("company")
    i = a.select("user_id", "url_id", kind.alias("kind"), F.when(F.col("action_type") == "X_OUT", "TOMBSTONE").otherwise("USER").alias("source"))
    up = J.closure(s.createDataFrame([("company", "org"), ("org", "thing"), ("person", "thing")], "c string, p string"), "c", "p")
    return accounts.live_interests(i, "user_id", "url_id", "kind", up).select("user_id", "url_id", "kind")


@query("""WITH w AS (SELECT row_number() OVER (ORDER BY url_id, crawl_time NULLS FIRST) AS ord, CASE WHEN word_count > 300 THEN url ELSE 'http://new.example/' || url_id END AS url FROM article), h AS (SELECT url, min(id) AS id FROM url GROUP BY 1)
    SELECT w.ord, w.url, coalesce(h.id, left(sha256(w.url), 24)) AS id, h.id IS NULL AS is_new FROM w LEFT JOIN h USING (url)""")
def dml_put_urls(s, d):
    a = table(s, d, "article", "url_id", "url", "word_count", "crawl_time")
    order = A.Window.orderBy("url_id", F.asc_nulls_first("crawl_time"))
    w = a.select(F.row_number().over(order).cast("bigint").alias("ord"), F.when(F.col("word_count") > 300, F.col("url")).otherwise(F.concat(F.lit("http://new.example/"), "url_id")).alias("url"))
    return store.put_urls(table(s, d, "url", "id", "url"), w)


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'Renamed' ELSE c_name END AS c_name FROM customer")
def dml_set_field(s, d):
    return store.set_field(table(s, d, "customer", "c_custkey", "c_name"), "c_custkey", 7, "c_name", F.lit("Renamed"))


@query(f"WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2)) AS word FROM documents) SELECT word, count(*) AS frequency, count(DISTINCT doc_id) AS document_occurences, CAST(NULL AS VARCHAR) AS note FROM t WHERE word NOT IN ({_quoted(text.STOP_WORDS)}) GROUP BY 1")
def src_side_table(s, d):
    """The corpus's word vector, written as a side table and read back."""
    docs = table(s, d, "documents", "doc_id", "text")
    v = V.universe(V.word_counts(docs, "doc_id", F.col("text")), "doc_id").select("word", F.col("tf").alias("frequency"), F.col("df").alias("document_occurences"), F.lit(1).alias("left_out"))
    path = f"{shared_dir(s)}/vector-{uuid.uuid4().hex}"
    readers.write_side_table(v, path)
    return readers.read_side_table(s, path, "word string, frequency bigint, document_occurences bigint, note string")


@query("WITH a AS (SELECT DISTINCT url_id, published_time FROM article WHERE published_time IS NOT NULL AND url_id IS NOT NULL), m AS (SELECT url_id, min(epoch_ms(published_time)) AS t FROM a GROUP BY 1) SELECT url_id, 'http://api.example/' || strftime(t, '%Y/%m/%d') || '/' || url_id AS url FROM m")
def src_json_urls(s, d):
    a = table(s, d, "article", "url_id", "published_time").filter("published_time is not null and url_id is not null").groupBy("url_id").agg(F.min("published_time").alias("t"))
    answer = F.to_json(F.struct(F.array(F.struct(F.col("url_id").alias("slug"), F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd").alias("date"))).alias("items")))
    return a.select("url_id", F.explode(readers.json_urls(answer, "http://api.example")).alias("url"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, min(last_crawl_start_time) AS started, max(last_crawl_finish_time) AS finished, count(*) AS n, count(*) FILTER (last_crawl_finish_time IS NULL) AS n_open, CAST(coalesce(sum(last_crawl_finish_time - last_crawl_start_time), 0) AS BIGINT) AS millis FROM url WHERE last_crawl_start_time IS NOT NULL GROUP BY 1")
def str_heartbeat(s, d):
    path = f"{shared_dir(s)}/heartbeat-{uuid.uuid4().hex}"
    u = table(s, d, "url", urls.host(F.col("url")).alias("host"), "last_crawl_start_time", "last_crawl_finish_time").filter("last_crawl_start_time is not null")
    u.repartition(3).write.parquet(path)
    st = s.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return gates.run_to_end(gates.heartbeat(st, ["host"], "last_crawl_start_time", "last_crawl_finish_time"), f"beat_{uuid.uuid4().hex}", "complete")


@query("SELECT id, CASE WHEN crawl_priority % 2 = 0 THEN NULL ELSE url END AS url, origin_url, crawl_priority + 1 AS crawl_priority, CASE WHEN crawl_priority % 2 = 0 THEN 'url is required' END AS violation FROM url")
def src_rows_with_blob(s, d):
    """URLs kept as a blob beside columns that were pulled out of it and have changed since."""
    u = table(s, d, "url").withColumn("blob", F.to_json(F.struct("id", "url", "origin_url", "crawl_priority")))
    rows = u.select("id", F.when(F.col("crawl_priority") % 2 != 0, F.col("url")).alias("url"), (F.col("crawl_priority") + 1).alias("crawl_priority"), "blob")
    return schemas.from_rows(rows, schemas.URL, "blob", ["id", "url", "crawl_priority"]).select("id", "url", "origin_url", "crawl_priority", "violation")


@query("SELECT 'article' AS t, count(*) AS n FROM article UNION ALL SELECT 'url', count(*) FROM url UNION ALL SELECT 'user_action', count(*) FROM user_action")
def src_together(s, d):
    """Several scans at once."""
    counts = {t: table(s, d, t).agg(F.count("*").alias("n")) for t in ("article", "url", "user_action")}
    out = None
    for t, df in written_together(counts).items():
        df = df.select(F.lit(t).alias("t"), "n")
        out = df if out is None else out.unionByName(df)
    return out


# ---------------------------------------------------------------- residual jobs

@query("WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' ELSE c_name || '@x.example' END AS email, c_custkey % 3 = 0 AS opt_out, CASE WHEN c_custkey % 4 = 0 THEN 1 END AS sent FROM customer) SELECT c_custkey, email FROM c WHERE email IS NOT NULL AND email <> '' AND NOT opt_out AND sent IS NULL")
def job_welcome_audience(s, d):
    from loomstream.plans.query import Query

    k = F.col("c_custkey")
    c = table(s, d, "customer", "c_custkey", "c_name").select("c_custkey", F.when(k % 5 == 1, "").when(k % 5 > 1, F.concat("c_name", F.lit("@x.example"))).alias("email"), F.when(k % 3 == 0, True).alias("opt_out"), F.when(k % 4 == 0, 1).alias("sent"))
    return Query().where_not_null("email").where_not_equals("email", "").where_not_true("opt_out").where_null("sent").run(c).select("c_custkey", "email")


@query("WITH a AS (SELECT DISTINCT url_id FROM article) SELECT id, CASE WHEN a.url_id IS NULL THEN NULL ELSE last_crawl_start_time END AS last_crawl_start_time, CASE WHEN a.url_id IS NULL THEN CASE WHEN regexp_matches(url, '/20[0-9]{2}/') THEN 100 ELSE 10 END ELSE crawl_priority END AS crawl_priority FROM url LEFT JOIN a ON id = a.url_id")
def job_reset_crawl(s, d):
    """URLs without an article as if never crawled, with their priority made anew."""
    u = table(s, d, "url", "id", "url", "last_crawl_start_time", "crawl_priority")
    orphan = u.join(table(s, d, "article", F.col("url_id").alias("id")).distinct(), "id", "left_anti")
    new = urls.crawl_priority(F.col("url"), F.col("url").rlike("/20[0-9]{2}/"), F.lit(None).cast("bigint"), 0)
    return store.update(u, orphan.select("id", F.lit(None).cast("bigint").alias("last_crawl_start_time"), new.alias("crawl_priority")), "id").drop("url")


@query("WITH v AS (SELECT low, k, count(*) AS n FROM (SELECT lower(k.keyword) AS low, k.keyword AS k FROM (SELECT unnest(keyword) AS k FROM article) UNION ALL SELECT lower(k.keyword), upper(k.keyword) FROM (SELECT unnest(keyword) AS k FROM article) WHERE k.type = 'o') GROUP BY 1, 2) SELECT low AS keyword, max(n) AS most_of_a_case, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY 1")
def job_keyword_count(s, d):
    """How often each keyword occurs whatever its case, and the most of any one spelling."""
    k = table(s, d, "article", "keyword").select(F.explode("keyword").alias("k"))
    k = k.select("k.keyword").unionByName(k.filter("k.type = 'o'").select(F.upper("k.keyword").alias("keyword")))
    v = k.groupBy(F.lower("keyword").alias("low"), "keyword").agg(F.count("*").alias("n"))
    return v.groupBy(F.col("low").alias("keyword")).agg(F.max("n").alias("most_of_a_case"), F.sum("n").alias("n"))


@query(f"""WITH {_ENT}, c AS (SELECT DISTINCT k.keyword || CASE WHEN k.strength % 3 = 0 THEN ', Somewhere' ELSE '' END AS line FROM (SELECT unnest(keyword) AS k FROM article) WHERE k.type = 'l' OR k.strength % 4 = 0),
    m AS (SELECT line, coalesce(a.type, b.type) AS type FROM c LEFT JOIN ent a ON lower(c.line) = a.low LEFT JOIN ent b ON lower(trim(string_split(c.line, ',')[1])) = b.low) SELECT line, CASE WHEN type IS NULL THEN 'missing' WHEN type <> 'l' THEN 'no place' END AS finding FROM m WHERE type IS DISTINCT FROM 'l'""")
def job_city_audit(s, d):
    """Names of a list of cities that have no entity, or one that is no place: by the whole line, then by what stands before its comma."""
    _, ent = _entities(s, d)
    k = table(s, d, "article", "keyword").select(F.explode("keyword").alias("k")).filter("k.type = 'l' or k.strength % 4 = 0")
    c = k.select(F.concat("k.keyword", F.when(F.col("k.strength") % 3 == 0, ", Somewhere").otherwise("")).alias("line")).distinct()
    types = ent.select(F.lower("keyword").alias("low"), "type")
    whole = c.withColumn("low", F.lower("line")).join(types.withColumnRenamed("type", "a"), "low", "left").drop("low")
    part = whole.withColumn("low", F.lower(F.trim(F.substring_index("line", ",", 1)))).join(types.withColumnRenamed("type", "b"), "low", "left").withColumn("type", F.coalesce("a", "b"))
    place = s.createDataFrame([("l",)], "type string")
    return part.join(place, "type", "left_anti").select("line", F.when(F.col("type").isNull(), "missing").otherwise("no place").alias("finding"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'city' ELSE p_type END AS p_type, CASE WHEN p_partkey % 9 = 0 THEN greatest(1, p_size - 20) ELSE p_size END AS p_size FROM part")
def job_set_cities(s, d):
    p = table(s, d, "part", "p_partkey", "p_type", "p_size")
    ids = p.filter("p_partkey % 9 = 0")
    return store.update(p, ids.select("p_partkey", F.lit("city").alias("p_type"), F.greatest(F.lit(1), F.col("p_size") - 20).alias("p_size")), "p_partkey")


@query("SELECT id || '.html' AS file FROM url WHERE id NOT IN (SELECT url_id FROM article)")
def job_orphan_files(s, d):
    """Files kept for articles that are no longer there: what may be deleted."""
    files = table(s, d, "url", "id").select(F.concat("id", F.lit(".html")).alias("file"), "id")
    return files.join(table(s, d, "article", F.col("url_id").alias("id")), "id", "left_anti").select("file")


@query("WITH t AS (SELECT doc_id, word, tf * ln((SELECT count(*) FROM documents) / (df + 1e-6)) AS w FROM (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 2)) AS word FROM documents) WHERE word NOT IN (" + _quoted(text.STOP_WORDS) + ") GROUP BY 1, 2) JOIN (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 2)) AS word FROM documents) GROUP BY 1) USING (word)) SELECT doc_id, word, round(w, 6) AS weight, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, word) AS r FROM t) WHERE r <= 20")
def job_top_words(s, d):
    docs = table(s, d, "documents", "doc_id", "text")
    counts = written(V.word_counts(docs, "doc_id", F.col("text")), "counts")
    w = V.tf_idf(counts, V.universe(counts, "doc_id"), docs.count())
    return V.top_words(w, "doc_id", 20).select("doc_id", "word", F.round("weight", 6).alias("weight"), "rank")


@query("WITH r AS (SELECT user_id, substr(id, 1, 9) AS device_id, max(create_time) AS create_time, CAST(max(length(coalesce(url, ''))) % 2 AS BOOLEAN) AS is_beta FROM user_action GROUP BY 1, 2) SELECT device_id, user_id, is_beta FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY create_time DESC NULLS LAST, user_id) AS n FROM r) WHERE n = 1")
def job_devices(s, d):
    a = table(s, d, "user_action", "id", "user_id", "create_time", "url").groupBy("user_id", F.substring("id", 1, 9).alias("device_id"))
    r = a.agg(F.max("create_time").alias("create_time"), (F.max(F.length(F.coalesce("url", F.lit("")))) % 2).cast("boolean").alias("is_beta"))
    return accounts.devices(r).select("device_id", "user_id", "is_beta")


@query("SELECT c_custkey, c_name || ' of ' || c_mktsegment AS contact FROM customer UNION ALL SELECT c_custkey, 'Ada ' || c_mktsegment FROM customer")
def job_contacts(s, d):
    c = table(s, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    person = lambda a, b: F.struct(a.alias("firstName"), b.alias("lastName"))
    book = F.to_json(F.array(person(F.col("c_name"), F.concat(F.lit("of "), "c_mktsegment")), person(F.lit("Ada"), F.col("c_mktsegment")), person(F.lit("Alone"), F.lit(None).cast("string")), person(F.lit("Ada"), F.col("c_mktsegment"))))
    return c.select("c_custkey", F.explode(accounts.contacts(book)).alias("contact"))


@query("""WITH n AS (SELECT id, user_id, url_id, CASE WHEN action_type = 'SHARE' THEN create_time END AS click FROM (SELECT DISTINCT id, user_id, url_id, action_type, create_time FROM user_action)), c AS (SELECT id, CASE WHEN length(coalesce(url_id, '')) + ascii(id[-1]) % 3 > 24 THEN 'stranger' ELSE user_id END AS who, 5000 AS at FROM n)
    SELECT n.id, coalesce(n.click, CASE WHEN c.who = n.user_id THEN c.at END) AS click_time, c.who = n.user_id AS logged FROM n JOIN c USING (id)""")
def job_click_through(s, d):
    """Clicks on notifications: only the owner's count, only the first sets the time, and each of the owner's is logged."""
    a = table(s, d, "user_action", "id", "user_id", "url_id", "action_type", "create_time").distinct()
    n = a.select("id", "user_id", "url_id", F.when(F.col("action_type") == "SHARE", F.col("create_time")).alias("click_time"))
    stranger = F.length(F.coalesce("url_id", F.lit(""))) + F.ascii(F.substring("id", -1, 1)) % 3 > 24
    clicks = n.select(F.col("id").alias("notification_id"), F.when(stranger, "stranger").otherwise(F.col("user_id")).alias("user_id"), F.explode(F.array(F.lit(9000).cast("bigint"), F.lit(5000).cast("bigint"))).alias("time"))
    changed, log = accounts.clicked(n, clicks)
    mine = log.select(F.col("notification_id").alias("id"), F.lit(True).alias("own")).distinct()
    return changed.join(mine, "id", "left").select("id", "click_time", F.coalesce("own", F.lit(False)).alias("logged"))


@query("""SELECT url_id, title, len(paragraph) AS paragraphs, CASE WHEN coalesce(crawl_time, 0) - 129600000 > published_time THEN published_time ELSE coalesce(crawl_time, 0) END AS published_time FROM article WHERE url_id IN (SELECT min(url_id) FROM article UNION ALL SELECT max(url_id) FROM article)""")
def job_article(s, d):
    """Single articles read by their keys, with the time that counts."""
    from loomstream.functions import dates

    keys = table(s, d, "article", "url_id").agg(F.min("url_id").alias("a"), F.max("url_id").alias("b")).select(F.explode(F.array("a", "b")).alias("url_id"))
    a = store.Store(s, d).get("article", "url_id", keys)
    return a.select("url_id", "title", F.size("paragraph").cast("bigint").alias("paragraphs"), dates.effective_time(F.col("published_time"), F.col("crawl_time")).alias("published_time"))


@query("SELECT a.url_id, CAST(count(*) FILTER (f.user_id IS NOT NULL) AS BIGINT) AS kept_by, count(f.user_id) > 0 OR bool_or(coalesce(a.retain, false)) AS retain FROM (SELECT DISTINCT url_id, retain FROM article) a LEFT JOIN (SELECT DISTINCT user_id, url_id FROM user_action WHERE action_type = 'FAVORITE') f USING (url_id) GROUP BY 1")
def job_favourite(s, d):
    """Favourites pushed once to their readers' arrays, and their articles marked to be kept."""
    f = table(s, d, "user_action", "user_id", "url_id", "action_type").filter("action_type = 'FAVORITE' and url_id is not null").select("user_id", "url_id")
    users = f.select("user_id").distinct().withColumn("url_favorite", F.array().cast("array<string>")).join(f, "user_id")
    kept = users.select("user_id", F.explode(accounts.toggled(F.col("url_favorite"), F.col("url_id"), F.lit(True))).alias("url_id")).distinct()
    n = kept.groupBy("url_id").agg(F.count("*").alias("kept_by"))
    a = table(s, d, "article", "url_id", "retain").groupBy("url_id").agg(F.bool_or(F.coalesce("retain", F.lit(False))).alias("r"))
    return a.join(n, "url_id", "left").select("url_id", F.coalesce("kept_by", F.lit(0)).alias("kept_by"), (F.col("r") | F.col("kept_by").isNotNull()).alias("retain"))
