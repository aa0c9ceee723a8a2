import pytest
from pyspark.sql import functions as F

from loomstream.functions import dates, html, text, urls


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("I.B.M.", "IBM"), ("ios", "iOS"), ("“Smith’s", "Smith"), ("(hello world)", "Hello World"), ("Boston-based", "Boston"), ("", ""), ("end.", "End"), ("iphone", "iPhone")])
def test_clean_keyword(spark, raw, clean):
    assert one(spark, raw, text.clean_keyword) == clean


@pytest.mark.parametrize(("raw", "ok"), [("Google", True), ("the", False), ("x", False), ("9 lives", False), ("Best of Times", False), ("some news", False), ("a" * 51, False), (None, False), ("R&amp;D", False)])
def test_valid_keyword(spark, raw, ok):
    assert one(spark, raw, text.valid_keyword) is ok


def test_titles_and_stems(spark):
    assert one(spark, "Big  news story - The Daily", text.clean_title) == "Big news story"
    assert one(spark, "lower case", text.clean_title) == "Lower Case"
    assert one(spark, "A" + " | Site" * 12, text.clean_title) == "A"
    assert one(spark, "An <<b>b>old</b> story &amp; more&nbsp;&eacute;&#8217;&#x41;&bogus; &apos;", text.clean_title) == "An old story & more é’A&bogus; ’"
    assert one(spark, None, text.clean_title) is None
    assert len(one(spark, "x" * 300, text.clean_title)) == 256
    assert sorted(one(spark, "The Mega phantom and the mega network", text.deduping_stems)) == ["mega", "netw", "phan"]
    assert one(spark, None, text.deduping_stems) == []


def test_hashes_and_versions(spark):
    def java(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    for s in ("", "http://x/y", "zzzzzzzzzz"):
        assert one(spark, s, text.java_hash) == java(s)
    for a, b, want in (("1.10", "1.9", 1), ("1", "1.0", 0), ("0.9.9", "1", -1), ("2.x", "2.0", 0), ("1.0.0.0.0.0.1", "1", 1), ("1.0.0.0.0.0.0", "1", 0)):
        assert spark.createDataFrame([(a, b)], "a string, b string").select(text.version_compare(F.col("a"), F.col("b"))).first()[0] == want
    assert one(spark, "goto(feed)!aid(123)", lambda c: text.blob_field(c, "aid")) == "123"


def test_rule_score(spark):
    rules = {"buys": 50.0, "merger": 200.0}
    f = lambda c: text.rule_score(c, F.lit("the body"), rules, {}, ("never",))
    assert [one(spark, s, f) for s in ("A buys B", "merger: A buys B", "nothing", "never a merger", None)] == [50.0, 200.0, 0.0, 0.0, 0.0]


def test_urls(spark):
    assert one(spark, "http://www.a.b.com/x", urls.domain) == "a.b.com"
    assert one(spark, "no url", urls.domain) == ""
    assert one(spark, "a.b.co.uk", urls.suffixes) == ["a.b.co.uk", "b.co.uk", "co.uk"]
    assert one(spark, "localhost", urls.suffixes) == ["localhost"]
    clean = lambda c: urls.clean_url(c, F.lit(True), F.array(F.lit("id")))
    assert one(spark, "http://WWW.A.com:80/x?utm=1&id=3#f", clean) == "https://www.a.com/x?id=3"
    assert one(spark, "http://a.com:8080/", clean) == "https://a.com:8080"
    assert [one(spark, u, urls.allowed_url) for u in ("http://a/x", "http://video.a.com/x", "http://a/b.pdf", None)] == [True, False, False, False]
    assert one(spark, "https://youtu.be/abcdefg1", urls.youtube_id) == "abcdefg1"


def test_dates(spark):
    ms = 1_423_699_200_000  # 2015-02-12
    for s in ("2015-02-12", "February 12, 2015", "20150212", "2015/02/12", "Thu, 12 Feb 2015", "02.12.2015", "12 February 2015", "Feb 12 2015", "2015-02-12T00:00:00+00:00", "20150212000000", "Thu, 12 Feb 2015 00:00:00 GMT"):
        assert one(spark, s, dates.parse_date_time) == ms, s
    assert one(spark, "yesterday", dates.parse_date_time) is None
    h = 3_600_000
    for s, want in (("Thu, 12 Feb 2015 10:00 EST", ms + 15 * h), ("Thu, 12 Feb 2015 10:00 GMT", ms + 10 * h), ("Thu, 12 Feb 2015 10:00:00 +0100", ms + 9 * h), ("12 Feb 2015 | 10:00 PST", ms + 18 * h), ("09:30 AM EDT  February 12, 2015", ms + 13 * h + h // 2),
                    ("Thu 12 Feb 2015 at 09AM UTC", ms + 9 * h), ("Thu Feb 12, 2015   9:05 PM", ms + 21 * h + h // 12), ("Thu Feb 12 01:02:03 CET 2015", ms + 123_000 - h + h), ("Thu, Feb 12 2015, 08:00 BST", ms + 7 * h), ("2015-02-12T08:00-08:00", ms + 16 * h)):
        want = ms + h + 123_000 - h if "CET" in s else want
        assert one(spark, s, dates.parse_date_time) == want, s
    for u in ("http://a/2015/02/12/x", "http://a/2015-02-12-x", "http://a/20150212/x", "http://a/x-20150212", "http://a/2015/2/12/x"):
        assert one(spark, u, dates.date_from_url) == ms, u
    assert one(spark, "http://a/2015/02/x", dates.date_from_url) is None
    assert one(spark, "http://a/2015/02/x", lambda c: dates.date_from_url(c, True)) == 1_422_748_800_000
    h = 3_600_000
    row = spark.createDataFrame([(10 * h, None), (10 * h, 60 * h), (10 * h, 20 * h)], "p bigint, c bigint")
    assert [r[0] for r in row.select(dates.effective_time(F.col("p"), F.col("c"))).collect()] == [0, 10 * h, 20 * h]
    assert [spark.range(1).select(dates.human_age(F.lit(m * 60_000))).first()[0] for m in (5, 65, 3000)] == ["5m", "1h", "2d"]
    assert spark.range(1).select(dates.is_night(F.lit(7 * h), F.lit("+00:00")), dates.is_night(F.lit(7 * h), F.lit("+03:00"))).first() == (True, False)


def test_html(spark):
    page = '<html><head><base href="http://b.com/d/"><meta property="og:title" content="T &amp; U"><title>x</title></head><body><div class="story big"><p>One<p>Two<br>2b</p></div><p id=x>z</p><a href="p">l</a><a href="mailto:x">m</a>'
    rows = [(1, "http://a.com/q", page, [".story > p"], "kept"), (2, "http://a.com/q", None, None, None), (3, None, "<p>a" + "b" * 20_000, [], "")]
    df = spark.createDataFrame(rows, "id int, url string, html string, selectors array<string>, title string")
    got = {r["id"]: r for r in html.page_facts(df, ["id"]).collect()}
    assert got[1]["title"] == "T & U"
    assert got[1]["paragraph"] == ["One", "Two", "2b"]
    assert got[1]["links"] == ["http://b.com/d/p"]
    assert got[2]["paragraph"] == [] and got[2]["title"] is None
    assert len(got[3]["paragraph"][0]) == 10_240
    root = html.parse('<ul><li a="1">x<li>y</ul>')
    assert [n.text() for n in html.select(root, 'li[a="1"]')] == ["x"]
    with pytest.raises(ValueError):
        html.select(root, "li:first")
