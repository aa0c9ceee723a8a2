"""Scalar functions, vectors, ranking, stored forms, changes to tables, HTML and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomstream.functions import dates, html, text, urls
from loomstream.operators import aggregates as A
from loomstream.operators import joins as J
from loomstream.operators import ranking as R
from loomstream.operators import vectors as V
from loomstream.plans.query import Query
from loomstream.plans.suite_relational import query
from loomstream.session import salted_join, shared_dir, table, written
from loomstream.sources import readers, schemas, store
from loomstream.streaming import gates

# ---------------------------------------------------------------- scalar functions (F)


@query(r"""SELECT url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS domain FROM url""")
def fn_domain(s, d):
    return table(s, d, "url", "url").select("url", urls.domain(F.col("url")).alias("domain"))


@query(r"""WITH u AS (SELECT id, make_date(2000 + length(url) % 17, 1 + length(id) * 7 % 12, 1 + length(url) * 3 % 28) AS day FROM url),
    f AS (SELECT id, day, unnest(['slash', 'slash_short', 'dash', 'eight', 'wire', 'month', 'month_only', 'none']) AS form FROM u)
    SELECT id, form, CASE WHEN form IN ('month', 'month_only') THEN epoch_ms(date_trunc('month', day)) WHEN form <> 'none' THEN epoch_ms(day) END AS millis FROM f
    UNION ALL SELECT id, 'table', CASE WHEN regexp_matches(url, '/20[0-9]{2}/(0[0-9]|1[012])/') THEN epoch_ms(strptime(regexp_extract(url, '/(20[0-9]{2}/(0[0-9]|1[012]))/', 1) || '/01', '%Y/%m/%d')) END FROM url""")
def fn_month_from_url(s, d):
    """Days and months in URLs: those of the table, and all forms of a day in URLs made of it."""
    u = table(s, d, "url", "id", "url")
    day = F.make_date(F.lit(2000) + F.length("url") % 17, F.lit(1) + F.length("id") * 7 % 12, F.lit(1) + F.length("url") * 3 % 28).cast("timestamp_ntz")
    forms = {"slash": "'/'yyyy/MM/dd'/a-story'", "slash_short": "'/'yyyy/M/d'/x'", "dash": "'/'yyyy-MM-dd'-x'", "eight": "'/news/'yyyyMMdd'/x'", "wire": "'/a-story-'yyyyMMdd", "month": "'/'yyyy/MM'/a-story-1'", "month_only": "'/blog/'yyyy/MM'/'", "none": "'/'yyyy'/story'"}
    made = F.array(*[F.struct(F.lit(n).alias("form"), F.concat(F.lit("http://a.example"), F.date_format(day, p)).alias("at")) for n, p in forms.items()])
    rows = u.select("id", F.inline(made)).unionByName(u.select("id", F.lit("table").alias("form"), F.col("url").alias("at")))
    return rows.select("id", "form", dates.date_from_url(F.col("at"), allow_month=True).alias("millis"))


#: Forms of dates: name, pattern that writes it (a weekday and a zone included), unit of time it holds, minutes of its zone before UTC.
_DATES = (
    ("iso", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "second", -120), ("iso_z", "yyyy-MM-dd'T'HH:mm:ss'Z'", "second", 0), ("iso_minute", "yyyy-MM-dd'T'HH:mm'-08:00'", "minute", 480), ("iso_hour", "yyyy-MM-dd'T'HH:mm'-08'", "minute", 480),
    ("long_time", "MMMM dd, yyyy, hh:mm a", "minute", 0), ("long", "MMMM d, yyyy", "day", 0), ("day", "yyyy-MM-dd", "day", 0), ("digits", "yyyyMMddHHmmss", "second", 0), ("eight", "yyyyMMdd", "day", 0),
    ("slashes", "yyyy/MM/dd HH:mm:ss", "second", 0), ("slash_day", "yyyy/MM/dd", "day", 0), ("mail_minute", "EEE, dd MMM yyyy HH:mm 'EST'", "minute", 300), ("mail", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "second", 0),
    ("mail_offset", "EEE, dd MMM yyyy HH:mm:ss '+0530'", "second", -330), ("mail_bare", "EEE, dd MMM yyyy HH:mm:ss", "second", 0), ("mail_day", "EEE, d MMM yyyy", "day", 0), ("points", "MM.dd.yyyy", "day", 0), ("european", "dd MMMM yyyy", "day", 0),
    ("at_hour", "EEE dd MMM yyyy 'at' hha 'PDT'", "hour", 420), ("bar", "dd MMM yyyy '|' HH:mm 'CET'", "minute", -60), ("hour_first", "hh:mm a 'EDT'  MMMM dd, yyyy", "minute", 240), ("weekday", "EEE MMM d, yyyy   h:mm a", "minute", 0),
    ("short", "MMM d yyyy", "day", 0), ("unix", "EEE MMM dd HH:mm:ss 'UTC' yyyy", "second", 0), ("comma_time", "EEE, MMM dd yyyy, HH:mm 'GMT'", "minute", 0), ("no_date", "'on some day'", "", 0),
)


@query("WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{u}', {z})" for i, (n, _, u, z) in enumerate(_DATES)) + f") f(i, form, unit, zone)), o AS (SELECT o_orderkey, o_orderkey % {len(_DATES)} AS i, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS t FROM orders)"
       " SELECT o_orderkey, form, CASE WHEN unit <> '' THEN epoch_ms(date_trunc(unit, t)) + zone * 60000 END AS millis FROM o JOIN f USING (i)")  # fmt: skip
def fn_parse_dates(s, d):
    """The orders' dates, one after the other in each of the forms that pages use, read back."""
    o = table(s, d, "orders", "o_orderkey", "o_orderdate")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("o_orderkey") * 7919 % 86_400)
    form, written_as = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (n, p, _, _) in enumerate(_DATES):
        mine = F.col("o_orderkey") % len(_DATES) == i
        form, written_as = F.when(mine, n).otherwise(form), F.when(mine, F.date_format(at, p)).otherwise(written_as)
    return o.select("o_orderkey", form.alias("form"), written_as.alias("text")).select("o_orderkey", "form", dates.parse_date_time(F.col("text")).alias("millis"))


@query("SELECT url_id, crawl_time, CASE WHEN coalesce(crawl_time, 0) - 129600000 > published_time THEN published_time ELSE coalesce(crawl_time, 0) END AS effective FROM article")
def fn_effective_time(s, d):
    return table(s, d, "article", "url_id", "published_time", "crawl_time").select("url_id", "crawl_time", dates.effective_time(F.col("published_time"), F.col("crawl_time")).alias("effective"))


@query("""SELECT id, CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm' WHEN m < 1440 THEN CAST(m // 60 AS VARCHAR) || 'h' ELSE CAST(m // 1440 AS VARCHAR) || 'd' END AS age
    FROM (SELECT id, (read_end_time - read_start_time) // 1000 AS m FROM user_action WHERE read_end_time >= read_start_time)""")
def fn_human_age(s, d):
    a = table(s, d, "user_action", "id", "read_start_time", "read_end_time").filter("read_end_time >= read_start_time")
    return a.select("id", dates.human_age((F.col("read_end_time") - F.col("read_start_time")) * 60).alias("age"))


@query("""SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || CASE WHEN day(o_orderdate) IN (11, 12, 13) THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd'
    WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END AS day FROM orders""")
def fn_ordinal_day(s, d):
    return table(s, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates.ordinal_day(F.col("o_orderdate")).alias("day"))


@query("""WITH z AS (SELECT id, create_time, unnest(['-08:00', '+05:30']) AS zone FROM user_action), x AS (SELECT id, zone, create_time + CASE zone WHEN '-08:00' THEN -28800000 ELSE 19800000 END AS t FROM z),
    m AS (SELECT id, zone, (t // 60000) % 1440 AS m, (t // 86400000 + 4) % 7 AS dow FROM x)
    SELECT id, zone, (m < 480 OR m >= 1320) AS night, (m >= 540 AND m < 780) AS morning, (m >= 480 AND m < 1200) AS daytime, (m >= 706 AND m <= 765) AS noon, dow IN (0, 6) AS weekend FROM m""")
def fn_time_of_day(s, d):
    a = table(s, d, "user_action", "id", "create_time").withColumn("zone", F.explode(F.array(F.lit("-08:00"), F.lit("+05:30"))))
    t, z = F.col("create_time"), F.col("zone")
    return a.select("id", "zone", dates.is_night(t, z).alias("night"), dates.is_morning(t, z).alias("morning"), dates.is_daytime(t, z).alias("daytime"), dates.is_around_noon(t, z).alias("noon"), dates.is_weekend(t, z).alias("weekend"))


@query("SELECT url_id, coalesce(list_filter(feature, lambda f: f.feature_id = 10004)[1].similarity, 0) AS similarity FROM article")
def fn_array_lookup(s, d):
    return table(s, d, "article", "url_id", "feature").select("url_id", V.similarity_of(F.col("feature"), 10004).alias("similarity"))


@query("""WITH h AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: (a * 31 + x) % 4294967296) AS h,
      list_sum(list_transform(string_split(id, ''), lambda c: ascii(c))) % 5 AS bucket FROM url)
    SELECT id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash, CAST(bucket AS BIGINT) AS bucket FROM h""")
def fn_string_hashes(s, d):
    return table(s, d, "url", "id").select("id", text.java_hash(F.col("id")).alias("hash"), text.character_bucket(F.col("id"), 5).alias("bucket"))


@query("""SELECT url_id, left(coalesce(CASE WHEN trim(description) <> '' THEN description END, list_filter(paragraph, lambda p: length(p) >= 50)[1]), 2048) AS description FROM article""")
def fn_best_description(s, d):
    return table(s, d, "article", "url_id", "description", "paragraph").select("url_id", text.best_description(F.col("description"), F.col("paragraph")).alias("description"))


@query("""SELECT url_id, CASE WHEN length(t) > 110 THEN left(t, 107) || '...' ELSE t END AS text FROM (SELECT url_id, concat_ws(': ', origin, title) AS t FROM article)""")
def fn_shortened_text(s, d):
    return table(s, d, "article", "url_id", "origin", "title").select("url_id", text.shortened(F.concat_ws(": ", "origin", "title"), 110, 107).alias("text"))


_WORDS = ", ".join(f"'{w}'" for w in text.KEYWORD_BLACKLIST)


@query(rf"""WITH k AS (SELECT DISTINCT k.keyword AS keyword FROM (SELECT unnest(keyword) AS k FROM article) UNION SELECT unnest([{_WORDS}, '#one', '@two', 'Bloomberg three', 'MBA four', 'five@bloomberg', 'Best of six', 'best old hats of seven', 'eight &amp; nine', 'ten…', 'x', '11 things', 'Éa']))
    SELECT keyword, length(trim(keyword)) >= 2 AND length(trim(keyword)) <= 50 AND regexp_matches(trim(keyword), '^\p{{L}}') AND NOT regexp_matches(lower(trim(keyword)), '^best( [a-z]+)? of |&.*;|;.*&|…|^bloomberg |^mba |^[#@]|@bloomberg$| (jobs|news|profile|restaurants|trends)$')
    AND lower(trim(keyword)) NOT IN ({_WORDS}) AS valid FROM k""")
def fn_valid_keyword(s, d):
    more = [*text.KEYWORD_BLACKLIST, "#one", "@two", "Bloomberg three", "MBA four", "five@bloomberg", "Best of six", "best old hats of seven", "eight &amp; nine", "ten…", "x", "11 things", "Éa"]
    k = table(s, d, "article", "keyword").select(F.explode("keyword.keyword").alias("keyword")).unionByName(s.createDataFrame([(w,) for w in more], "keyword string")).distinct()
    return k.select("keyword", text.valid_keyword(F.col("keyword")).alias("valid"))


def clean_sql(c):
    """clean_keyword() of a column in SQL, step by step as table expressions of one column each."""
    spell = "y"
    for wrong, right in text.SPELLINGS:
        spell = f"regexp_replace({spell}, '{wrong}', '{right}', 'gi')"
    end = r'''regexp_replace(x, '[’''”",;\-!?*)/$—″\]\s]+$', '')'''
    return rf"""ka AS (SELECT {c} AS k, regexp_replace(trim({c}), '^[‘''“"()\-.?:&,!*+/—%…\[\s]+', '') AS x FROM src),
    kb AS (SELECT k, x, {end} AS e FROM ka),
    kc AS (SELECT k, CASE WHEN regexp_matches(x, '[’'']s$') THEN trim(regexp_replace(x, '[’'']s$', '')) ELSE trim(regexp_replace(CASE WHEN ends_with(e, '.') AND len(string_split(e, '.')) = 2 THEN rtrim(left(e, length(e) - 1)) ELSE e END, '-based$', '')) END AS z FROM kb),
    kd AS (SELECT k, trim(regexp_replace(z, '[’''].*$', '')) AS z FROM kc),
    ke AS (SELECT k, z, CASE WHEN regexp_matches(z, '^\p{{Lu}}') THEN z ELSE array_to_string(list_transform(string_split(lower(z), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS y FROM kd),
    kf AS (SELECT k, CASE WHEN regexp_matches(z, '^([A-Z]+\.){{2,10}}$') THEN replace(z, '.', '') ELSE {spell} END AS clean FROM ke)"""


@query(rf"""WITH src AS (SELECT DISTINCT keyword FROM (SELECT k.keyword AS keyword FROM (SELECT unnest(keyword) AS k FROM article) UNION ALL SELECT unnest(string_split(title, ' ')) FROM article)), {clean_sql("keyword")}
    SELECT k AS keyword, clean, regexp_replace(k, '^(dr|mr|ms|mrs|miss|prof|rev)\.?\s+', '', 'i') AS bare FROM kf""")
def fn_clean_keyword(s, d):
    a = table(s, d, "article", "keyword", "title")
    k = a.select(F.explode("keyword.keyword").alias("keyword")).unionByName(a.select(F.explode(F.split("title", " ")).alias("keyword"))).distinct()
    return k.select("keyword", text.clean_keyword(F.col("keyword")).alias("clean"), text.without_person_title(F.col("keyword")).alias("bare"))


def _title_sql():
    x = "regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#8217;', '’'), '&nbsp;', ' '), '&amp;', '&'), '[\u200b-\u200f\ufeff]', '', 'g'), '\u00a0', ' ', 'g')"
    x = rf"regexp_replace({x}, '\s{{2,}}', ' ', 'g')"
    for p in text.TITLE_NOISE:
        q = p.replace("'", "''")
        q = f"^(?:{q[1:]})+" if q.startswith("^") else f"(?:{q[:-1]})+$" if q.endswith("$") else q
        x = f"regexp_replace({x}, '{q}', '', 'g')"
    return x


@query(rf"""WITH t AS (SELECT url_id, {_title_sql()} AS t FROM article), u AS (SELECT url_id, CASE WHEN length(t) > 256 THEN left(t, 255) || '…' ELSE t END AS t FROM t)
    SELECT url_id, trim(CASE WHEN regexp_matches(t, '^\p{{Ll}}') THEN array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE t END) AS title FROM u""")
def fn_clean_title(s, d):
    return table(s, d, "article", "url_id", "title").select("url_id", text.clean_title(F.col("title")).alias("title"))


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(rf"""WITH src AS (SELECT DISTINCT unnest(string_split_regex(coalesce(title, ''), '[\s\x{{A0}}]+')) AS word FROM article), {clean_sql("word")},
    w AS (SELECT k, left(lower(clean), 4) AS stem FROM kf WHERE length(clean) >= 2 AND lower(clean) NOT IN ({_STOPS})),
    t AS (SELECT DISTINCT url_id, title, unnest(string_split_regex(coalesce(title, ''), '[\s\x{{A0}}]+')) AS k FROM article),
    g AS (SELECT url_id, title, list_sort(list(DISTINCT stem)) AS stems FROM t JOIN w USING (k) GROUP BY 1, 2)
    SELECT a.url_id, coalesce(array_to_string(g.stems, ' '), '') AS stems FROM article a LEFT JOIN g ON a.url_id = g.url_id AND a.title IS NOT DISTINCT FROM g.title""")
def fn_deduping_stems(s, d):
    return table(s, d, "article", "url_id", "title").select("url_id", F.concat_ws(" ", F.array_sort(text.deduping_stems(F.col("title")))).alias("stems"))


@query(r"""SELECT id, CASE WHEN coalesce(m.is_https, false) THEN 'https' ELSE 'http' END || '://' || lower(regexp_extract(u.url, '^[a-z]+://([^/:?#]+)', 1)) || CASE WHEN length(p) > 1 THEN p ELSE '' END
      || CASE WHEN regexp_matches(u.url, '[?&]id=') THEN '?' || regexp_extract(u.url, '[?&](id=[^&#]*)', 1) ELSE '' END AS url
    FROM (SELECT id, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM url) u
    LEFT JOIN (SELECT DISTINCT ON (domain) domain, is_https FROM (SELECT unnest(list_distinct(list_concat([root_domain], coalesce(aka_root_domain, [])))) AS domain, is_https FROM site_manifest)) m
      ON lower(regexp_extract(u.url, '^[a-z]+://([^/:?#]+)', 1)) = m.domain OR ends_with(lower(regexp_extract(u.url, '^[a-z]+://([^/:?#]+)', 1)), '.' || m.domain)""")
def fn_clean_url(s, d):
    m = table(s, d, "site_manifest", "root_domain", "aka_root_domain", "is_https")
    u = J.domain_suffix_join(table(s, d, "url", "id", "url"), "url", m, ["root_domain", "aka_root_domain"])
    return u.select("id", urls.clean_url(F.col("url"), F.col("is_https"), F.array(F.lit("id"))).alias("url"))


@query(r"""SELECT id, length(url) <= 767 AND NOT (contains(h, 'video.') OR contains(h, 'videos.') OR starts_with(p, '/cgi-bin/') OR contains(p, '/video/') OR contains(p, '/videos/'))
      AND NOT regexp_matches(p, '(/atom\.xml|/rss\.xml|\.gif|\.jpeg|\.jpg|\.mp3|\.mp4|\.mpeg|\.pdf|\.png)$') AS allowed
    FROM (SELECT id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM url)""")
def fn_allowed_url(s, d):
    return table(s, d, "url", "id", "url").select("id", urls.allowed_url(F.col("url")).alias("allowed"))


@query(r"""SELECT id, contains(p, '/tag/') OR starts_with(p, '/2014/01') OR regexp_matches(p, '-[0-9]{4}$') AS blacklisted FROM (SELECT id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM url)""")
def fn_path_rules(s, d):
    rules = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(k).alias("location")) for n, k in (("/tag/", "CONTAINS"), ("/2014/01", "STARTS_WITH"), ("-[0-9]{4}$", "REGEX_FIND"))])
    return table(s, d, "url", "id", "url").select("id", urls.blacklisted_path(urls.path(F.col("url")), rules).alias("blacklisted"))


@query(r"""SELECT id, CASE WHEN NOT article THEN 10 WHEN month IS NULL THEN 100 ELSE greatest(100, 2000 - (1420070400000 - month) // 3600000) END AS priority FROM (SELECT id, regexp_matches(url, '/20[0-9]{2}/') AS article,
    CASE WHEN regexp_matches(url, '/20[0-9]{2}/(0[0-9]|1[012])/') THEN epoch_ms(strptime(regexp_extract(url, '/(20[0-9]{2}/(0[0-9]|1[012]))/', 1) || '/01', '%Y/%m/%d')) END AS month FROM url)""")
def fn_crawl_priority(s, d):
    u = table(s, d, "url", "id", "url")
    return u.select("id", urls.crawl_priority(F.col("url"), F.col("url").rlike("/20[0-9]{2}/"), dates.date_from_url(F.col("url"), True), 1_420_070_400_000).alias("priority"))


@query("""WITH v AS (SELECT p_partkey, [p_size // 10, p_size % 10, 0, 0, 0, 0, 0, p_partkey % 3] AS a, [p_partkey % 5, p_partkey % 7, 0, 0, 0, 0, 0, 1] AS b FROM part),
    n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN a ELSE list_concat(a[1:2], [0, 0, 0, 0, 0, 0]) END AS a, b FROM v) SELECT p_partkey, CAST(CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS BIGINT) AS cmp FROM n""")
def fn_version_compare(s, d):
    """Versions of two and of eight parts."""
    p = table(s, d, "part", "p_partkey", "p_size")
    two, zeros = F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10), F.lit("0.0.0.0.0")
    a = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(".", two, zeros, F.col("p_partkey") % 3)).otherwise(two)
    b = F.concat_ws(".", F.col("p_partkey") % 5, F.col("p_partkey") % 7, zeros, F.lit("1"))
    return p.select("p_partkey", text.version_compare(a, b).cast("bigint").alias("cmp"))


@query("SELECT p_partkey, p_name, word FROM (SELECT p_partkey, p_name, unnest(string_split_regex(p_name, '[^A-Za-z0-9_]')) AS word FROM part) WHERE starts_with(lower(word), 'b')")
def fn_word_prefix(s, d):
    """Type-ahead: a title comes once for every word that begins with what was typed."""
    p = table(s, d, "part", "p_partkey", "p_name").filter(text.starts_any_word(F.col("p_name"), "B"))
    return p.select("p_partkey", "p_name", F.explode(text.words_starting(F.col("p_name"), "B")).alias("word"))


@query(r"""SELECT doc_id, CAST(CASE WHEN regexp_matches(t, 'clash|erneut') OR regexp_matches(b, 'clash|erneut') THEN 0.0 ELSE greatest(CASE WHEN regexp_matches(t, 'divides|questions') THEN 1.0 ELSE 0 END, CASE WHEN regexp_matches(b, '(million|billion)') THEN 0.6 ELSE 0 END,
    CASE WHEN regexp_matches(b, 'months? of negotiation') THEN 0.9 ELSE 0 END) END AS DOUBLE) AS score FROM (SELECT doc_id, lower(coalesce(title, '')) AS t, lower(coalesce(text, '')) AS b FROM documents)""")
def vec_rule_score(s, d):
    x = text.rule_score(F.col("title"), F.col("text"), {"divides|questions": 1.0}, {"(million|billion)": 0.6, "months? of negotiation": 0.9}, ("clash|erneut",))
    return table(s, d, "documents", "doc_id", "title", "text").select("doc_id", x.alias("score"))


# ---------------------------------------------------------------- vectors and statistics (R)

_TOKENS = r"""t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 2)) AS word FROM documents),
    c AS (SELECT doc_id, word, count(*) AS tf FROM t WHERE word NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ") GROUP BY 1, 2), u AS (SELECT word, count(*) AS df FROM c GROUP BY 1)"


@query(f"WITH {_TOKENS} SELECT word, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM c GROUP BY 1")
def vec_universe(s, d):
    return V.universe(V.word_counts(table(s, d, "documents", "doc_id", "text"), "doc_id", F.col("text")), "doc_id")


@query(f"WITH {_TOKENS} SELECT doc_id, word, round(tf * ln((SELECT count(*) FROM documents) / (df + 1e-6)), 6) AS weight FROM c JOIN u USING (word)")
def vec_tf_idf(s, d):
    docs = table(s, d, "documents", "doc_id", "text")
    counts = written(V.word_counts(docs, "doc_id", F.col("text")), "counts")
    w = V.tf_idf(counts, written(V.universe(counts, "doc_id"), "universe"), docs.count())
    return w.select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_TOKENS}, w AS (SELECT doc_id, word, tf * ln((SELECT count(*) FROM documents) / (df + 1e-6)) AS weight FROM c JOIN u USING (word)), s AS (SELECT word, sum(weight) AS ws FROM w WHERE doc_id % 100 = 0 GROUP BY 1),
    n AS (SELECT sqrt(sum(ws * ws)) AS ns FROM s) SELECT doc_id, round(coalesce(sum(weight * coalesce(ws, 0)) / nullif(sqrt(sum(weight * weight)) * (SELECT ns FROM n), 0), 0), 6) AS similarity FROM w LEFT JOIN s USING (word) GROUP BY 1""")
def vec_cosine_with_seed(s, d):
    docs = table(s, d, "documents", "doc_id", "text")
    counts = written(V.word_counts(docs, "doc_id", F.col("text")), "counts")
    w = written(V.tf_idf(counts, written(V.universe(counts, "doc_id"), "universe"), docs.count()), "weights")
    seed = w.filter("doc_id % 100 = 0").groupBy("word").agg(F.sum("weight").alias("weight"))
    return V.cosine_with(w, "doc_id", seed).select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH e AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM e GROUP BY 1)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 5) AS similarity FROM embeddings JOIN c USING (label)""")
def vec_dense_cosine(s, d):
    e = table(s, d, "embeddings")
    c = V.centroids(e, "label", "embedding")
    return e.join(F.broadcast(c), "label").select("vec_id", F.round(V.dense_cosine(F.col("embedding"), F.col("centroid")), 5).alias("similarity"))  # one row a label


_POINTS = ", ".join(str(p) for p in A.PERCENTILES)


@query(f"WITH q AS (SELECT quantile_cont(value, [{_POINTS}]) AS v FROM events) SELECT CAST([{_POINTS}][i] AS DOUBLE) AS percentile, round(v[i], 6) AS value FROM (SELECT v, unnest(range(1, {len(A.PERCENTILES) + 1})) AS i FROM q)")
def vec_distribution(s, d):
    q = A.distributions(table(s, d, "events", "value"), [], F.col("value")).select(F.inline("distribution"))
    return q.select("percentile", F.round("value", 6).alias("value"))


@query(f"""WITH q AS (SELECT quantile_cont(value, [{_POINTS}]) AS v FROM events), z AS (SELECT CAST([{_POINTS}][i] AS DOUBLE) AS p, v[i] AS v FROM (SELECT v, unnest(range(1, {len(A.PERCENTILES) + 1})) AS i FROM q)),
    b AS (SELECT event_id, value AS x, max(CASE WHEN v <= value THEN p END) AS lp, max(CASE WHEN v <= value THEN v END) AS lv, min(CASE WHEN v >= value THEN p END) AS hp, min(CASE WHEN v >= value THEN v END) AS hv FROM events, z GROUP BY 1, 2)
    SELECT event_id, round(CASE WHEN hp IS NULL THEN 1.0 WHEN lp IS NULL THEN 0.0 WHEN hv = lv THEN lp ELSE lp + (x - lv) / (hv - lv) * (hp - lp) END, 6) AS quantile FROM b""")
def vec_project_quantile(s, d):
    e = table(s, d, "events", "event_id", "value")
    dist = A.distributions(e, [], F.col("value")).select("distribution").scalar()
    return e.withColumn("d", dist).select("event_id", F.round(A.project_quantile(F.col("d"), F.col("value")), 6).alias("quantile"))


@query("WITH x AS (SELECT DISTINCT value FROM events), r AS (SELECT value, row_number() OVER (ORDER BY value DESC) - 1 AS r, count(*) OVER () AS n FROM x) SELECT value AS threshold FROM r WHERE r = least(floor(n * 0.1), n - 1)")
def vec_seed_threshold(s, d):
    return V.seed_threshold(table(s, d, "events", "value"), "value", 0.9)


@query("""WITH q AS (SELECT event_id, greatest(0, least(1, value / 500 + (event_id % 7) / 100.0)) AS q FROM events)
    SELECT event_id, round(CASE WHEN q < 0.4 THEN q / 0.4 * 0.78 WHEN q < 0.7 THEN 0.78 + (q - 0.4) / 0.3 * 0.145 ELSE 0.925 + (q - 0.7) / 0.3 * 0.075 END, 6) AS score FROM q""")
def vec_piecewise(s, d):
    x = V.piecewise(F.col("value") / 500, F.col("event_id") % 7, F.lit(0.4), F.lit(0.7))
    return table(s, d, "events", "event_id", "value").select("event_id", F.round(x, 6).alias("score"))


@query("""SELECT url_id, feature_id, similarity FROM (SELECT url_id, f.feature_id AS feature_id, f.similarity AS similarity, row_number() OVER (PARTITION BY url_id ORDER BY f.similarity DESC, f.feature_id) AS n
    FROM (SELECT url_id, unnest(feature) AS f FROM (SELECT DISTINCT url_id, feature FROM article)) WHERE f.similarity >= 0.75) WHERE n <= 5""")
def vec_kept_features(s, d):
    a = table(s, d, "article", "url_id", "feature").distinct()
    return a.select("url_id", F.inline(V.kept_features(F.col("feature"), 0.75, 5)))


@query("""SELECT event_id, round(1 / (1 + exp(-(2.0 * h1 - 1.0 * h2 + 0.25))), 6) AS output FROM (SELECT event_id, 1 / (1 + exp(-(0.5 * x - 0.2 * y + 0.1))) AS h1, 1 / (1 + exp(-(-1.0 * x + 0.3 * y))) AS h2
    FROM (SELECT event_id, value / 500 AS x, user_id / 100.0 AS y FROM events))""")
def vec_network_output(s, d):
    z = V.network_output([F.col("value") / 500, F.col("user_id") / 100.0], [[0.5, -0.2, 0.1], [-1.0, 0.3, 0.0]], [2.0, -1.0, 0.25])
    return table(s, d, "events", "event_id", "value", "user_id").select("event_id", F.round(z, 6).alias("output"))


@query()
def vec_train_networks(s, d):
    a = table(s, d, "user_action", "user_id", "action_type", "create_time", "read_start_time").filter("action_type in ('TAP_FROM_STREAM', 'SCROLL_PAST')")
    rows = a.orderBy(F.xxhash64("user_id", "create_time")).limit(20_000).select(  # a bounded training set
        F.array(F.col("create_time") % 86_400_000 / 8.64e7, F.when(F.col("read_start_time").isNull(), 0.0).otherwise(1.0)).alias("x"), (F.col("action_type") == "TAP_FROM_STREAM").alias("y"),
        (text.java_hash(F.col("user_id")) % 5 == 0).alias("held"),
    )
    return V.train_networks(rows, "x", "y", "held", [0, 2, 4], 2, 300).select("hidden", "try", F.round("train_error", 4).alias("train_error"), F.round("holdback_error", 4).alias("holdback_error"))


# ---------------------------------------------------------------- ranking


#: Taps of a site from which on more don't count.
_FULL = 10


def _candidates(s, d, top):
    """The best `top` articles by rank_score of each user, of all sites that they tapped, with what the operators need.

    An article's rank_score depends on its site's count of taps alone (ten and more count alike), so the best of each
    site are listed once per count; no user's best can be outside these lists.
    """
    a = J.first_wins(table(s, d, "article"), ["url_id"], [F.asc("crawl_time")]).filter("origin is not null")
    fb, tw = R.latest_engagement(F.col("social_engagement"), "FACEBOOK"), R.latest_engagement(F.col("social_engagement"), "TWITTER")
    ready = written(a.select(  # what depends on the article alone is made once, before it meets its readers
        "origin", "url_id", F.coalesce("published_time", F.lit(0)).alias("time"), text.deduping_stems(F.col("title")).alias("stems"), fb["share_score"].alias("share_score"),
        tw["share_score"].alias("second_score"), F.coalesce(F.array_max(F.transform("feature", lambda f: f["similarity"])), F.lit(0.0)).alias("best"),
        F.array_distinct(F.transform(F.filter("keyword", lambda k: k["strength"] > 30), lambda k: F.lower(k["keyword"]))).alias("keywords"),
        F.transform(V.kept_features(F.col("feature"), 0.0, 3), lambda f: f["feature_id"]).alias("features"), urls.domain(F.col("url")).alias("domain"),
    ), "ready")
    read = table(s, d, "user_action", "user_id", "url_id", "action_type").filter("action_type = 'TAP_FROM_STREAM' and url_id is not null").join(ready.select("url_id", "origin"), "url_id")
    follows = read.groupBy(F.col("user_id").alias("stream"), "origin").agg(F.least(F.count("*"), F.lit(_FULL)).alias("n"))
    score = F.col("best") * 0.7 + F.least(F.col("n") / _FULL, F.lit(1.0)) * 0.3
    age = (F.lit(1_480_000_000_000) - F.col("time")) / R.HOUR
    scored = ready.select("origin", "url_id", "time", "best", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(_FULL).cast("bigint"))).alias("n"))
    scored = scored.withColumn("score", F.round(score, 9)).withColumn("rank_score", F.round(score * R.decay(age, 18.0, 24.0 * 365), 12))
    order = [F.desc("rank_score"), F.asc("url_id")]
    lists = A.top_per_group(scored, ["origin", "n"], order, top).groupBy("origin", "n").agg(F.collect_list(F.struct("url_id", "score", "rank_score")).alias("best"))
    mine = salted_join(follows, lists, ["origin", "n"]).select("stream", F.inline("best"))
    return A.top_per_group(mine, ["stream"], order, top).drop("rank").join(ready.drop("origin", "best"), "url_id")


_FOLLOWED = """follows AS (SELECT user_id AS stream, origin, least(count(*), 10) AS n FROM user_action JOIN ready USING (url_id) WHERE action_type = 'TAP_FROM_STREAM' GROUP BY 1, 2),
    scored AS (SELECT stream, url_id, time, stems, share_score, round(best * 0.7 + least(n / 10, 1.0) * 0.3, 9) AS score FROM follows JOIN ready USING (origin))"""


def stream_sql(top, scored=_FOLLOWED, named="origin IS NOT NULL", free=18.0, half=8760.0):
    """The candidates of every stream in SQL, numbered by score: table expressions up to `cand`, from those that make `scored`."""
    latest = "list_filter(fb, lambda x: x.create_time = list_max(list_transform(fb, lambda y: y.create_time)))[1].share_score"
    return rf"""first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY crawl_time NULLS FIRST) AS nth FROM article) WHERE nth = 1 AND {named}),
    src AS (SELECT DISTINCT unnest(string_split_regex(coalesce(title, ''), '[\s\x{{A0}}]+')) AS word FROM first), {clean_sql("word")},
    stem AS (SELECT k, left(lower(clean), 4) AS stem FROM kf WHERE length(clean) >= 2 AND lower(clean) NOT IN ({_STOPS})),
    words AS (SELECT DISTINCT url_id, unnest(string_split_regex(coalesce(title, ''), '[\s\x{{A0}}]+')) AS k FROM first), st AS (SELECT url_id, list(DISTINCT stem) AS stems FROM words JOIN stem USING (k) GROUP BY 1),
    ready AS (SELECT f.url_id, f.origin, coalesce(published_time, 0) AS time, coalesce(st.stems, []) AS stems, {latest} AS share_score, coalesce(list_max(list_transform(feature, lambda x: x.similarity)), 0) AS best
      FROM (SELECT *, list_filter(social_engagement, lambda x: x.site = 'FACEBOOK') AS fb FROM first) f LEFT JOIN st USING (url_id)),
    {scored},
    ranked AS (SELECT *, round(score * (1 / (1 + greatest(0.0, (1480000000000 - time) / 3600000.0 - {free}) / {half})), 12) AS rank_score FROM scored),
    cand AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY score DESC, url_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY rank_score DESC, url_id) AS r FROM ranked) WHERE r <= {top})"""


def deduped_sql(cand):
    """dedupe_streams() as a walk over each stream's candidates: table expressions up to `kept` (stream, k)."""
    return f"""{cand}, pass AS (SELECT stream, 0 AS n, CAST([] AS STRUCT(u VARCHAR, s DOUBLE, t BIGINT, w DOUBLE, st VARCHAR[], hot INTEGER, old BIGINT)[]) AS kept FROM (SELECT DISTINCT stream FROM cand)
    UNION ALL SELECT stream, n + 1, CASE WHEN hit = 0 THEN list_append(kept, own) ELSE list_transform(kept, lambda x, i: CASE WHEN i <> hit THEN x
        WHEN x.w IS NULL OR own.w > x.w THEN struct_pack(u := own.u, s := own.s, t := own.t, w := own.w, st := own.st, hot := 1, old := least(own.t, x.t)) ELSE struct_pack(u := x.u, s := x.s, t := x.t, w := x.w, st := x.st, hot := x.hot + 1, old := least(x.old, own.t)) END) END
      FROM (SELECT p.stream, p.n, p.kept, struct_pack(u := c.url_id, s := c.score, t := c.time, w := c.share_score, st := c.stems, hot := 0, old := c.time) AS own,
        coalesce(list_position(list_transform(p.kept, lambda x: abs(x.t - c.time) <= 108000000 AND len(list_intersect(x.st, c.stems)) >= 2), true), 0) AS hit FROM pass p JOIN cand c ON c.stream = p.stream AND c.n = p.n + 1)),
    kept AS (SELECT stream, unnest(arg_max(kept, n)) AS k FROM pass GROUP BY 1)"""


def _ranked_sql(top, k):
    """ranked_streams(): duplicates out, the best by score and second score, and at each place the one of the next eight that differs most from the last three."""
    latest = "list_filter(tw, lambda x: x.create_time = list_max(list_transform(tw, lambda y: y.create_time)))[1].share_score"
    worth = " + ".join(f"CASE WHEN len(chosen) >= {n} THEN trunc(m[i][chosen[len(chosen) - {n - 1}]] / {n}.0) ELSE {120 // n} END" for n in (1, 2, 3))
    return f"""WITH RECURSIVE {deduped_sql(stream_sql(top))}, more AS (SELECT url_id, {latest} AS second, regexp_replace({"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"}, '^www\\.', '') AS domain,
      list_distinct(list_transform(list_filter(coalesce(keyword, []), lambda x: x.strength > 30), lambda x: lower(x.keyword))) AS kw, list_transform(list_sort(list_transform(coalesce(feature, []), lambda x: struct_pack(o := -x.similarity, id := x.feature_id)))[1:3], lambda x: x.id) AS ft
      FROM (SELECT *, list_filter(social_engagement, lambda x: x.site = 'TWITTER') AS tw FROM first)),
    few AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY score DESC, url_id) AS i FROM (SELECT stream, k.u AS url_id, k.s AS score, CASE WHEN k.hot > 0 THEN k.hot + 1 ELSE 0 END AS hot_count, k.st AS st, second, domain, kw, ft,
      row_number() OVER (PARTITION BY stream ORDER BY k.s * (1 + coalesce(second, 0.5)) DESC, k.u) AS r FROM kept JOIN more ON k.u = more.url_id) WHERE r <= {k + 5}),
    d AS (SELECT a.stream, a.i, b.i AS j, 100 - (15 * len(list_intersect(a.kw, b.kw)) + len(list_intersect(a.st, b.st)) + CASE WHEN a.domain = b.domain THEN 5 ELSE 0 END) + (len(a.ft) + len(b.ft) - 2 * len(list_intersect(a.ft, b.ft))) * (len(a.ft) + len(b.ft) - 2 * len(list_intersect(a.ft, b.ft))) // 2 AS d
      FROM few a JOIN few b USING (stream)), rows_ AS (SELECT stream, i, list(d ORDER BY j) AS l FROM d GROUP BY 1, 2), mat AS (SELECT stream, list(l ORDER BY i) AS m FROM rows_ GROUP BY 1),
    walk AS (SELECT stream, CAST([] AS BIGINT[]) AS chosen, range(1, len(m) + 1) AS left_ FROM mat UNION ALL SELECT stream, list_append(chosen, pick), list_filter(left_, lambda x: x <> pick) FROM (SELECT w.stream, w.chosen, w.left_,
        w.left_[list_position(ws, list_max(ws))] AS pick FROM (SELECT walk.*, list_transform(left_[1:8], lambda i: {worth}) AS ws FROM walk JOIN mat USING (stream) WHERE len(left_) > 0 AND len(chosen) < {k}) w)),
    done AS (SELECT stream, arg_max(chosen, len(chosen)) AS chosen FROM walk GROUP BY 1), place AS (SELECT stream, unnest(chosen) AS i, unnest(range(0, len(chosen))) AS position FROM done),
    final AS (SELECT stream, url_id, score, CAST(hot_count AS INTEGER) AS hot_count, CAST(position AS INTEGER) AS position FROM place JOIN few USING (stream, i))"""


@query(f"WITH RECURSIVE {deduped_sql(stream_sql(153))} SELECT stream, k.u AS url_id, k.s AS score, k.t AS time, k.w AS share_score, CAST(CASE WHEN k.hot > 0 THEN k.hot + 1 ELSE 0 END AS INTEGER) AS hot_count, k.old AS oldest FROM kept")
def rank_deduped(s, d):
    return R.dedupe_streams(_candidates(s, d, 153))


@query(f"{_ranked_sql(153, 51)} SELECT * FROM final")
def rank_streams(s, d):
    """The flagship: the ranked, unduplicated and diversified stream of every user at once."""
    return R.ranked_streams(_candidates(s, d, 153), 51)


@query(f"{_ranked_sql(63, 21)} SELECT stream, url_id, score, hot_count, position, count(*) OVER (PARTITION BY stream) > 20 AS next_page FROM final QUALIFY position < 20")
def rank_next_page(s, d):
    return R.with_next_page(R.ranked_streams(_candidates(s, d, 63), 21), 20)


@query("SELECT url_id, published_time, 1 / (1 + greatest(0, (1480000000000 - coalesce(published_time, 0)) / 3600000.0 - 18) / 36) AS decay FROM article")
def rank_time_decay(s, d):
    age = (F.lit(1_480_000_000_000) - F.coalesce(F.col("published_time"), F.lit(0))) / R.HOUR
    return table(s, d, "article", "url_id", "published_time").select("url_id", "published_time", R.decay(age, 18.0, 36.0).alias("decay"))


@query("""WITH k AS (SELECT url_id, lower(k.keyword) AS keyword, k.strength AS strength FROM (SELECT url_id, unnest(keyword) AS k FROM (SELECT DISTINCT url_id, keyword FROM article))),
    r AS (SELECT *, row_number() OVER (PARTITION BY url_id, strength >= 100 ORDER BY strength DESC NULLS LAST, keyword) AS n FROM (SELECT url_id, keyword, max(strength) AS strength FROM k WHERE length(keyword) < 25 GROUP BY 1, 2))
    SELECT url_id, keyword, strength FROM r WHERE (strength >= 100 AND n <= 2) OR (strength < 100 AND n <= 1)""")
def rank_best_keywords(s, d):
    k = table(s, d, "article", "url_id", "keyword").distinct().select("url_id", F.explode("keyword").alias("k")).filter(F.length("k.keyword") < 25)
    k = k.groupBy("url_id", F.lower("k.keyword").alias("keyword")).agg(F.max("k.strength").alias("strength")).withColumn("strong", F.col("strength") >= 100)
    top = A.top_per_group(k, ["url_id", "strong"], [F.desc_nulls_last("strength"), F.asc("keyword")], 2)
    return top.filter((F.col("strong")) | (F.col("rank") <= 1)).filter("strength is not null").select("url_id", "keyword", "strength")


# ---------------------------------------------------------------- stored forms, sources and changes (S, D)


@query("SELECT url_id, title IS NOT NULL AND length(title) > 256 AS too_long FROM article WHERE title IS NOT NULL AND length(title) > 256 OR url IS NULL OR length(url) > 767")
def src_violations(s, d):
    bad = schemas.violations(table(s, d, "article", "url_id", "url", "title"), schemas.ARTICLE).filter("violation is not null")
    return bad.select("url_id", (F.col("violation") == "title is too long").alias("too_long"))


@query("SELECT id, id AS json_id, url, CAST(discovery_time AS VARCHAR) AS discovery_time FROM url")
def src_json(s, d):
    j = table(s, d, "url").select("id", schemas.to_json(schemas.URL).alias("j"))
    return j.select("id", F.get_json_object("j", "$.id").alias("json_id"), F.get_json_object("j", "$.url").alias("url"), F.get_json_object("j", "$.discovery_time").alias("discovery_time"))


@query("SELECT url_id, title, word_count, CAST(coalesce(len(keyword), 0) AS BIGINT) AS keywords FROM article")
def src_document_round_trip(s, d):
    a = schemas.from_document(schemas.to_document(table(s, d, "article"), schemas.ARTICLE), schemas.ARTICLE)
    return a.select("url_id", "title", "word_count", F.coalesce(F.when(F.col("keyword").isNotNull(), F.size("keyword")), F.lit(0)).cast("bigint").alias("keywords"))


@query("SELECT p_partkey, p_name, p_type FROM part")
def src_csv_round_trip(s, d):
    path = f"{shared_dir(s)}/csv-{uuid.uuid4().hex}"
    table(s, d, "part", "p_partkey", "p_name", "p_type").write.option("quoteAll", True).option("escape", '"').csv(path)
    return readers.read_csv(s, path, "p_partkey bigint, p_name string, p_type string")


@query("SELECT short_name, root_domain, true AS found FROM site_manifest")
def src_manifest_text(s, d):
    m = table(s, d, "site_manifest", "short_name", "root_domain").collect()  # a fixed configuration table
    texts = [f'short_name: "{r[0]}"\nroot_domain: "{r[1]}" # the site\npath_blacklist {{\n  needle: "/tag/"\n}}\n' for r in m]
    return readers.manifests(s, texts).select("short_name", "root_domain", (F.get("path_blacklist", F.lit(0))["location"] == "STARTS_WITH").alias("found"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(s, d):
    c = table(s, d, "customer", "c_custkey", "c_mktsegment")
    return store.update(c, c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment")), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 10 = 0")
def dml_upsert(s, d):
    c = table(s, d, "customer", "c_custkey", "c_name")
    rows = c.filter("c_custkey % 10 = 0").select(F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1_000_000)).alias("c_custkey"), F.lit("new").alias("c_name"))
    return store.upsert(c, rows, "c_custkey")


@query("SELECT id, url FROM url UNION ALL SELECT DISTINCT 'n' || url_id, url FROM article WHERE word_count > 450")
def dml_insert_new(s, d):
    u, a = table(s, d, "url", "id", "url"), table(s, d, "article", "url_id", "url", "word_count").filter("word_count > 450")
    rows = a.select(F.concat(F.lit("n"), "url_id").alias("id"), "url").unionByName(u)
    return store.insert_new(u, rows, "id")


@query("SELECT url_id, CAST(len(coalesce(deduping_stems, [])) + CASE WHEN type = 'news' THEN 1 ELSE 0 END AS BIGINT) AS n FROM article")
def dml_push(s, d):
    a = table(s, d, "article", "url_id", "deduping_stems", "type")
    out = store.push(a, F.coalesce(F.col("type") == "news", F.lit(False)), "deduping_stems", F.array(F.lit("extra")))
    return out.select("url_id", F.coalesce(F.when(F.col("deduping_stems").isNotNull(), F.size("deduping_stems")), F.lit(0)).cast("bigint").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)")
def dml_delete(s, d):
    q = Query().where_equals("o_orderstatus", "F").where_greater("o_totalprice", 100_000)
    return store.delete(table(s, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), q, "o_orderkey").select("o_orderkey")


@query("""WITH r AS (SELECT count(*) AS n FROM article WHERE coalesce(retain, false)), o AS (SELECT published_time, row_number() OVER (ORDER BY published_time DESC) AS k FROM article WHERE NOT coalesce(retain, false) AND published_time IS NOT NULL)
    SELECT url_id, published_time FROM article WHERE coalesce(retain, false) OR published_time >= (SELECT min(published_time) FROM o, r WHERE k <= 80 - n)""")
def dml_prune(s, d):
    return store.prune(table(s, d, "article", "url_id", "published_time", "retain"), 80, "published_time", "url_id", "retain").drop("retain")


@query("""WITH bad AS (SELECT id FROM url WHERE url LIKE '%/tag/%') SELECT 'url' AS t, count(*) AS n FROM url WHERE id NOT IN (SELECT id FROM bad) UNION ALL SELECT 'article', count(*) FROM article WHERE url_id NOT IN (SELECT id FROM bad)
    UNION ALL SELECT 'link', count(*) FROM url_link WHERE origin_url_id NOT IN (SELECT id FROM bad) AND destination_url_id NOT IN (SELECT id FROM bad)""")
def dml_cascade(s, d):
    u = table(s, d, "url", "id", "url")
    parts = store.cascade(u, table(s, d, "article", "url_id"), table(s, d, "url_link"), u.filter(F.col("url").like("%/tag/%")))
    out = [p.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t, p in zip(("url", "article", "link"), parts, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- pages (X)


def _pages(s, d):
    """Pages made of the articles: the tables hold no markup of their own."""
    a = J.first_wins(table(s, d, "article", "url_id", "url", "title", "paragraph"), ["url_id"], [F.asc("url")])
    body = F.array_join(F.transform("paragraph", lambda x: F.concat(F.lit("<p>"), F.regexp_replace(F.regexp_replace(x, "&", "&amp;"), "<", "&lt;"), F.lit("</p>"))), "")
    head = F.concat(F.lit('<html><head><meta property="og:title" content="'), F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), "&", "&amp;"), '"', "&quot;"), F.lit('"></head>'))
    return a.select("url_id", "url", F.concat(head, F.lit('<body><a href="/home">x</a><div class="body">'), body, F.lit("</div></body></html>")).alias("html"))


@query("SELECT DISTINCT url_id, trim(title) AS title FROM article WHERE coalesce(trim(title), '') <> ''")
def html_titles(s, d):
    return html.page_facts(_pages(s, d), ["url_id"]).filter("title is not null").select("url_id", "title")


@query(r"""WITH a AS (SELECT url_id, paragraph, url FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY url) AS n FROM article) WHERE n = 1), l AS (SELECT url_id, unnest(paragraph) AS p FROM a WHERE paragraph IS NOT NULL),
    s AS (SELECT url_id, trim(regexp_replace(unnest(string_split(p, chr(10))), '[\s\x0b\x{A0}]+', ' ', 'g')) AS line FROM l), c AS (SELECT url_id, count(*) AS n FROM s WHERE line <> '' AND NOT contains(line, 'Photo gallery') GROUP BY 1)
    SELECT a.url_id, CAST(coalesce(c.n, 0) AS BIGINT) AS paragraphs, regexp_extract(a.url, '^[a-z]+://[^/?#]+') || '/home' AS link FROM a LEFT JOIN c USING (url_id)""")
def html_paragraphs(s, d):
    pages = _pages(s, d).withColumn("text_blacklist", F.array(F.lit("Photo gallery")))
    return html.page_facts(pages, ["url_id"]).select("url_id", F.size("paragraph").cast("bigint").alias("paragraphs"), F.element_at("links", 1).alias("link"))


# ---------------------------------------------------------------- streams (M)


def _stream(s, d, *cols):
    path = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    table(s, d, "user_action", *cols).repartition(3).write.parquet(path)
    schema = s.read.parquet(path).schema
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT action_type, count(*) AS n FROM user_action GROUP BY 1")
def str_running_count(s, d):
    return gates.run_to_end(gates.running_count(_stream(s, d, "id", "action_type"), ["action_type"]), f"running_{uuid.uuid4().hex}", "complete")


@query("""SELECT start, action_type, count(*) AS n FROM (SELECT make_timestamp((create_time // 86400000) * 86400000000) AS start, action_type FROM user_action WHERE create_time IS NOT NULL) GROUP BY 1, 2""")
def str_windowed_count(s, d):
    st = _stream(s, d, "create_time", "action_type").withColumn("ts", F.timestamp_millis("create_time"))
    out = gates.windowed_count(st, "ts", ["action_type"], "1 day", None, "36500 days")
    return gates.run_to_end(out, f"windowed_{uuid.uuid4().hex}", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH RECURSIVE a AS (SELECT url_id, create_time AS t, row_number() OVER (PARTITION BY url_id ORDER BY create_time) AS n FROM user_action WHERE url_id IS NOT NULL AND create_time IS NOT NULL),
    w AS (SELECT url_id, t, n, t AS last, true AS kept FROM a WHERE n = 1 UNION ALL SELECT a.url_id, a.t, a.n, CASE WHEN a.t - w.last >= 86400000 THEN a.t ELSE w.last END, a.t - w.last >= 86400000 FROM w JOIN a ON a.url_id = w.url_id AND a.n = w.n + 1)
    SELECT url_id, t AS create_time FROM w WHERE kept""")
def str_recency_gate(s, d):
    return gates.recency_gate_batch(table(s, d, "user_action", "url_id", "create_time"), "url_id", "create_time", 86_400_000)


_GATE_SQL = """WITH RECURSIVE a AS (SELECT url_id, create_time AS t, row_number() OVER (PARTITION BY url_id ORDER BY create_time) AS n FROM user_action WHERE url_id IS NOT NULL AND create_time IS NOT NULL),
    w AS (SELECT url_id, t, n, t AS last, true AS kept FROM a WHERE n = 1 UNION ALL SELECT a.url_id, a.t, a.n, CASE WHEN a.t - w.last >= 86400000 THEN a.t ELSE w.last END, a.t - w.last >= 86400000 FROM w JOIN a ON a.url_id = w.url_id AND a.n = w.n + 1)
    SELECT url_id, t AS create_time FROM w WHERE kept"""


def _in_time(s, d, *cols):
    """Actions as a stream whose files come in order of time."""
    path = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    a = table(s, d, "user_action", *cols).filter("create_time is not null")
    cuts = [-1, *[r[0] for r in A.distributions(a, [], F.col("create_time")).select(F.inline("distribution")).filter("percentile in (0.3, 0.6)").select(F.floor("value")).collect()], 1 << 62]
    for low, high in zip(cuts, cuts[1:], strict=False):
        a.filter((F.col("create_time") > low) & (F.col("create_time") <= high)).coalesce(1).write.mode("append").parquet(path)
    return s.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(_GATE_SQL)
def str_recency_gate_stream(s, d):
    st = _in_time(s, d, "url_id", "create_time").filter("url_id is not null")
    return gates.run_to_end(gates.recency_gate(st, "url_id", "create_time", 86_400_000), f"gate_{uuid.uuid4().hex}", "append")


@query("""WITH x AS (SELECT user_id, create_time AS t, lag(create_time) OVER (PARTITION BY user_id ORDER BY create_time) AS b FROM user_action WHERE create_time IS NOT NULL),
    k AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS n FROM x WHERE b IS NULL OR t - b > 3600000)
    SELECT user_id, count(*) AS n, max(t) AS newest, min(t) AS oldest FROM k WHERE n <= 5 GROUP BY 1""")
def str_last_uses(s, d):
    out = gates.run_to_end(gates.last_uses(_in_time(s, d, "user_id", "create_time"), "user_id", "create_time"), f"uses_{uuid.uuid4().hex}", "update")
    last = out.groupBy("user_id").agg(F.max("times").alias("times"))  # of a key's updates the newest
    return last.select("user_id", F.size("times").cast("bigint").alias("n"), F.array_max("times").alias("newest"), F.array_min("times").alias("oldest"))


FLAGSHIP = rank_streams
