import pytest
from pyspark.sql import functions as F

from loomstream import session
from loomstream.functions import html, urls
from loomstream.operators import accounts, engagement, keywords, sites
from loomstream.operators import aggregates as A
from loomstream.operators import joins as J
from loomstream.operators import ranking as R
from loomstream.operators import vectors as V
from loomstream.sources import readers, schemas, store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SITES = "short_name string, root_domain string, aka_root_domain array<string>, subdomain_blacklist array<string>, path_blacklist array<struct<needle:string,location:string>>, article_url_pattern array<struct<subdomain:string,path_regex:string,query_regex:string>>"


@pytest.fixture(scope="module")
def manifests(spark):
    data = [
        ("Quern", "quern.example", ["old.example"], ["shop.quern.example"], [("/tag/", "CONTAINS"), ("/x", "EQUALS")], [(None, r"^/20\d\d/", None), ("blog.quern.example", None, "id=")]),
        ("Bare", "bare.example", None, None, None, None),
    ]
    return spark.createDataFrame(data, SITES)


def test_allowed_and_article_urls(spark, manifests):
    cases = {
        "http://www.quern.example/2014/a": (True, True), "http://old.example/2014/a": (True, True), "http://shop.quern.example/2014/a": (False, False), "http://quern.example/tag/x": (False, False),
        "http://blog.quern.example/p?id=3": (True, True), "http://blog.quern.example/p": (True, False), "http://bare.example/2014/a": (True, False), "http://other.example/2014/a": (False, False),
        "http://quern.example/x": (False, False), "http://quern.example/a.pdf": (False, False), "http://video.quern.example/2014/": (False, False), "no url": (False, False), None: (False, False), "http://quern.example/" + "a" * 800: (False, False),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("short_name", F.lit("clash"))
    u = sites.with_site(df, "url", manifests)
    got = {r[0]: (r[1], r[2]) for r in u.select("url", sites.allowed_by_site(u, "url"), sites.article_by_site(u, "url")).collect()}
    assert got == cases
    assert sites.with_site(df.limit(0), "url", manifests).count() == 0


def test_notifications_and_boosts(spark, manifests):
    n = spark.createDataFrame([(1, "http://quern.example/1", "x"), (2, None, "Bare: a title"), (3, None, "Nobody: a title"), (4, None, "no colon"), (5, None, None), (6, "http://z.example/", "Bare: t")], "id int, url string, text string")
    assert rows(sites.notification_sites(n, "url", "text", manifests).select("id", "site_name")) == [(1, "Quern"), (2, "Bare"), (3, None), (4, None), (5, None), (6, None)]
    pats = spark.createDataFrame([("Quern", 1, None, None, None, None, 2), ("Quern", 2, 7, "blog.quern.example", None, None, 4), ("Quern", 3, 7, None, "^/tech", "q=1", 1)], "short_name string, ord int, feature_id int, subdomain string, path_regex string, query_regex string, boost int")
    a = spark.createDataFrame([(u, f) for u in ("http://quern.example/", "http://a.blog.quern.example/", "http://quern.example/tech?q=1", "http://bare.example/", None) for f in (7, 8)], "url string, f int")
    got = {(r["url"], r["f"]): r["boost"] for r in sites.feature_boosts(a, "url", "f", pats, manifests).collect()}
    assert [got["http://quern.example/", 7], got["http://a.blog.quern.example/", 7], got["http://a.blog.quern.example/", 8], got["http://quern.example/tech?q=1", 7], got["http://bare.example/", 7], got[None, 7]] == [2, 4, 2, 1, 0, 0]


def test_pages(spark):
    t = spark.createDataFrame([("By Ann", 0), ("By Ann", 1), ("Follow us on Twitter", 3), ("I follow facebook news", 3), ("", 0), (None, 0), ("Sign up now", 2), ("A fair line", 2)], "t string, o int")
    got = [r[0] for r in t.select(html.good_paragraph(F.col("t"), F.col("o"), F.array(F.lit("^Sign")))).collect()]
    assert got == [False, True, False, False, False, False, False, True]
    page = '<div class="b"><p>By Ann Bell</p><p>Text one</p><p>Follow us on Facebook</p><p>Read more: x</p></div>'
    df = spark.createDataFrame([("u", page, [".b p"], ["^Read more"]), ("u", page, None, None)], "url string, html string, selectors array<string>, text_blacklist array<string>")
    assert sorted(r["paragraph"] for r in html.page_facts(df, ["url"]).collect()) == [["By Ann Bell", "Text one", "Follow us on Facebook", "Read more: x"], ["Text one"]]
    assert spark.range(1).select(urls.article_image(F.lit(urls.SITE_IMAGES[0])), urls.article_image(F.lit("http://a/b.png")), urls.article_image(F.lit(None).cast("string"))).first() == (False, True, False)


# ---------------------------------------------------------------- keywords

ENT = "id string, keyword string, short_name string, type string"


def test_known_and_block_entities(spark):
    links = spark.createDataFrame([("barbara boxer", "e1"), ("senator barbara", "e2"), ("google", "e3"), ("ghost", "e9"), ("new york times", "e4"), ("york", "e5"), (None, "e1"), ("void", None)], "keyword string, entity_id string")
    ents = spark.createDataFrame([("e1", "Barbara Boxer", None, "p"), ("e2", "Senator Barbara", "Sen. B", "p"), ("e3", "Google Inc", "Google", "o"), ("e4", "New York Times", None, "o"), ("e5", "York", None, "l")], ENT)
    t = spark.createDataFrame([(1, "Senator Barbara Boxer goes to Google, and Google stays"), (2, "The New York Times in York"), (3, None), (4, ""), (5, "lower case only"), (6, "Ghost Void")], "id int, t string").withColumn("entity_id", F.lit("clash"))
    got = rows(keywords.block_entities(t, "id", "t", links, ents).select("id", "entity_id", "keyword", "strength"))
    assert got == [(1, "e1", "Barbara Boxer", 150), (1, "e2", "Sen. B", 150), (1, "e3", "Google", 150), (2, "e4", "New York Times", 150), (2, "e5", "York", 150)]
    assert keywords.block_entities(t.limit(0), "id", "t", links, ents).count() == 0


def test_canonical_keywords(spark):
    links = spark.createDataFrame([("acme", "e1"), ("acme inc", "e1")], "keyword string, entity_id string")
    ents = spark.createDataFrame([("e1", "Acme", None, "o")], ENT)
    depths = spark.createDataFrame([("t", 1), ("p", 3), ("o", 3)], "type string, depth int")
    k = [(1, 0, "ada bell", "t", 13, 4), (1, 1, "Ada Bell", "p", 8, 2), (1, 2, "Bell", "t", 2, None), (1, 3, "the", "t", 5, 0), (1, 4, "Zen Garden", "t", 1, 1), (2, 0, "Acme", "o", 4, 3), (2, 1, "Mr Bell", "p", 1, 2), (2, 2, "Dr Ada Bell", "p", 1, 1), (3, 0, None, None, None, None)]
    df = spark.createDataFrame(k, "id int, ord int, keyword string, type string, strength int, paragraph_number int").withColumn("depth", F.lit(9))
    got = rows(keywords.canonical_keywords(df, "id", links, ents, depths))
    # equal ones: 13 + 5, the more special type, the earlier paragraph's; the contained one adds 5 again
    assert got == [(1, "Ada Bell", "p", 23, 2, None), (1, "Zen Garden", "t", 1, 1, None), (2, "Acme", "o", 4, 3, "e1"), (2, "Dr Ada Bell", "p", 6, 1, None)]
    assert keywords.canonical_keywords(df.limit(0), "id", links, ents, depths).count() == 0
    assert keywords.better_spelling("AOL", "Aol") == "Aol" and keywords.better_spelling("longer", "Long") == "longer"


def test_names_in_paragraphs(spark):
    g = spark.createDataFrame([("Ada Bell", "p"), ("York", "l"), ("Acme", "x")], "keyword string, type string")
    d = spark.createDataFrame([(1, ["Ada Bell met Ada Bell. And then Ada Bell left.", "It was in York that Acme won.", "Ada Bell again."]), (2, None), (3, []), (4, [None, ""])], "id int, p array<string>")
    assert rows(keywords.found_names(d, "id", "p", g)) == [(1, 1, "Ada Bell", "p", 14), (1, 2, "York", "l", 1)]
    s = spark.createDataFrame([("One. Two! “Three?” Four 3.5 five",), (None,), ("",)], "t string").select(keywords.sentences(F.col("t"))).collect()
    assert [r[0] for r in s] == [["One.", "Two!", "“Three?”", "Four 3.5 five"], None, []]


# ---------------------------------------------------------------- accounts and scores


def test_accounts(spark):
    up = J.closure(spark.createDataFrame([("company", "org")], "c string, p string"), "c", "p")
    have = spark.createDataFrame([("u", "acme", "company", "USER", 1), ("u", "acme", "person", "USER", 1), ("v", "acme", "company", "USER", 1)], "g string, k string, kind string, source string, create_time bigint")
    change = spark.createDataFrame([("u", "acme", "org", "TOMBSTONE", 5), ("u", "acme", "org", "USER", 4), ("w", "new", "org", "USER", 1)], have.schema)
    after = accounts.follow(have, change, "g", "k", "kind", up)
    assert rows(after.select("g", "k", "kind", "source")) == [("u", "acme", "org", "TOMBSTONE"), ("u", "acme", "person", "USER"), ("v", "acme", "company", "USER"), ("w", "new", "org", "USER")]
    assert rows(accounts.live_interests(after, "g", "k", "kind", up).select("g", "kind")) == [("u", "person"), ("v", "company"), ("w", "org")]
    key = spark.range(1).select(accounts.session_key(F.lit(123), F.lit("user/1?"), "s").alias("k"))
    assert key.select(accounts.session_user(F.col("k"), "t")).first()[0] is None
    good = spark.range(1).select(accounts.session_key(F.lit(123), F.lit("abc"), "s").alias("k"))
    assert good.select(accounts.session_user(F.col("k"), "s")).first()[0] == "abc" and spark.range(1).select(accounts.session_user(F.lit("junk"), "s")).first()[0] is None
    books = ['[{"firstName":"A","lastName":"B"},{"firstName":"C"},{"lastName":" "}]', "[]", "no json", None]
    assert [r[0] for r in spark.createDataFrame([(b,) for b in books], "b string").select(accounts.contacts(F.col("b"))).collect()] == [["A B"], [], None, None]
    fav = spark.createDataFrame([("u", [("a", 5), ("b", 9), ("a", 7), ("gone", 8)]), ("v", None), ("w", [])], "user string, f array<struct<url_id:string,create_time:bigint>>")
    arts = spark.createDataFrame([("a",), ("b",), ("b",)], "url_id string")
    assert rows(accounts.favourites(fav, "user", "f", arts)) == [("u", "a", 5, 2), ("u", "b", 9, 1)]
    on = lambda h, x, o: spark.createDataFrame([(h,)], "h array<string>").select(accounts.toggled(F.col("h"), F.lit(x), F.lit(o))).first()[0]
    assert (on(None, "a", True), on(["a"], "a", True), on(["a", "b"], "a", False), on(None, "a", False)) == (["a"], ["a"], ["b"], [])


def test_share_scores(spark):
    data = [("u1", "A", 100, 3_600_000), ("u2", "A", 300, 3_600_000), ("u3", "B", 10, -5), ("u4", "B", None, 7_200_000), ("u5", None, 7, 1), ("u6", "Z", 0, 10**12)]
    df = spark.createDataFrame(data, "url_id string, site string, c bigint, age bigint").withColumn("articles", F.lit(1)).withColumn("end", F.lit(1))
    got = {r["url_id"]: (r["normal"], r["share_score"]) for r in engagement.share_scores(df, "site", "c", "age").collect()}
    mean = (100 + 300 + 10 + 0) / 4
    assert got["u1"][0] == int(100 * mean / 200) and got["u2"][0] == int(300 * mean / 200) and got["u3"][0] == 10 and got["u6"][0] == 0  # never scaled up
    assert got["u3"][1] == 0.0 and got["u2"][1] == 1.0 and got["u4"] == (None, None) and got["u5"] == (None, None)
    assert engagement.share_scores(df.limit(0), "site", "c", "age").count() == 0


def test_small_operators(spark):
    e = spark.createDataFrame([("u", 1, None), ("u", 2, 9), ("u", 3, None), ("u", 100, None), ("v", 1, None)], "u string, t bigint, click bigint")
    assert rows(A.applicable(e, ["u"], "t", "t", "click", 100, after=50, fresh=99).select("u", "t")) == [("u", 1), ("u", 2), ("u", 3)]
    i = spark.createDataFrame([("k", 1, "a", 5, "x"), ("k", 2, "a", 9, "y"), ("k", 3, "b", None, "z"), ("k", 4, "a", 1, "w")], "k string, t int, v string, d int, id string")
    assert [tuple(r) for r in A.best_of_islands(i, ["k"], [F.col("t")], F.col("v"), F.col("d"), "id").orderBy("t").select("id", "length").collect()] == [("y", 2), ("z", 1), ("w", 1)]
    r = spark.createDataFrame([(5,), (17,), (99,), (None,)], "v int")
    bands = spark.createDataFrame([("a", 0, 16), ("b", 10, 40)], "n string, lo int, hi int")
    assert rows(J.range_lookup(r, "v", bands, "lo", "hi", 8).select("v", "n")) == [(17, "b"), (5, "a")]
    s = spark.createDataFrame([("g", "p", None, 3), ("g", "q", "img", 2), ("g", "r", "img", 1), ("h", "s", None, 1)], "g string, id string, image string, t int")
    got = R.image_first(s, "g", [F.desc("t")], F.col("image").isNotNull())
    assert rows(got.select("g", "rank", "id")) == [("g", 1, "q"), ("g", 2, "p"), ("g", 3, "r"), ("h", 1, "s")]
    both = J.interleaved([s.select("g", "id", "t"), s.limit(0).select("g", "id", "t")], "g", "t", "id")
    assert rows(both.filter("g = 'g'").select("rank", "id")) == [(1, "p"), (2, "q"), (3, "r")]
    assert rows(A.pair_quality(spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"), spark.createDataFrame([(1, 2), (5, 6)], "a int, b int"))) == [(1, 1, 1, 6)]
    rates = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.4)], "k string, rate double")
    assert {r["k"]: round(r["rating"], 6) for r in A.rated(rates).collect()} == {"a": 0.0, "b": 0.5, "c": 1.0}
    assert V.ratio_above(rates, F.col("rate"), 0.2).first() == (2 / 3, 3)
    skewed = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2)], "k string, i int")
    weights = session.written(skewed.groupBy("k").agg(F.count("*").alias("w")))
    assert session.skew_join(skewed, weights, ["k"], "w").count() == 301 and session.skew_join(skewed, weights.filter("k = 'hot'"), ["k"], "w", "left").filter("w is null").count() == 2


def test_tables_and_sinks(spark, tmp_path):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert rows(store.set_field(c, "id", 2, "name", F.lit("z"))) == [(1, "a"), (2, "z")]
    with pytest.raises(KeyError):
        store.set_field(c, "id", 3, "name", F.lit("z"))
    u = spark.createDataFrame([("i1", "http://a")], "id string, url string")
    put = store.put_urls(u, spark.createDataFrame([(1, "http://b"), (2, "http://a"), (3, "http://b")], "ord int, url string")).orderBy("ord").collect()
    assert [r["is_new"] for r in put] == [True, False, True] and put[0]["id"] == put[2]["id"] and put[1]["id"] == "i1"
    readers.write_table(c, str(tmp_path / "t"), partition_by=["name"])
    readers.write_table(c, str(tmp_path / "t"), partition_by=["name"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    readers.write_side_table(c, str(tmp_path / "s"))
    assert rows(readers.read_side_table(spark, str(tmp_path / "s"), "name string, extra int")) == [("a", None), ("b", None)]
    store.create_table(spark, "made_urls", schemas.URL, str(tmp_path / "made"), buckets=4)
    assert spark.table("made_urls").count() == 0 and "Bucket" in spark.sql("DESCRIBE EXTENDED made_urls").filter("col_name like '%ucket%'").toPandas().to_string()
    spark.sql("DROP TABLE made_urls")
    c.write.parquet(str(tmp_path / "in"))
    seen = []
    q = readers.each_batch(spark.readStream.schema(c.schema).parquet(str(tmp_path / "in")), lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(seen) == 2
    answer = spark.range(1).select(readers.json_urls(F.lit('{"items":[{"slug":"x","date":"2014-02-03T1"},{"date":"2014-02-03"}]}'), "http://a")).first()[0]
    assert answer == ["http://a/2014/02/03/x"]
    session.remove_written(spark)
