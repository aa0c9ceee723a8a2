import json

import pytest
from pyspark.sql import functions as F

from loomstream.plans.query import Query
from loomstream.sources import readers, schemas, store


def test_schemas():
    s = schemas.ARTICLE
    assert schemas.primary_key(s) == "url_id"
    assert {"keyword.keyword", "feature.feature_id", "published_time"} <= set(schemas.indexed_paths(s))
    good = [("title", "x"), ("paragraph", ["a"]), ("keyword", [{"keyword": "k", "strength": 3}]), ("published_time", 5), ("feature.similarity", 0.5)]
    bad = [("title", 3), ("paragraph", "a"), ("keyword", [{"nope": 1}]), ("published_time", "5"), ("retain", 1)]
    assert all(schemas.accepts(s, p, v) for p, v in good) and not any(schemas.accepts(s, p, v) for p, v in bad)
    with pytest.raises(ValueError):
        schemas.field_type(s, "keyword.nope")


def test_validation_json_documents(spark, small):
    a = spark.read.parquet(f"{small}/article.parquet")
    assert schemas.violations(a, schemas.ARTICLE).filter("violation is not null").count() == 0
    broken = a.limit(1).withColumn("title", F.lit("x" * 300)).unionByName(a.limit(1).withColumn("url", F.lit(None).cast("string")))
    assert {r[0] for r in schemas.violations(broken, schemas.ARTICLE).select("violation").collect()} == {"title is too long", "url is required"}
    nested = a.limit(1).withColumn("keyword", F.array(F.struct(F.lit(None).cast("string").alias("keyword"), F.lit(1).alias("strength"), F.lit("t").alias("type"), F.lit("s").alias("source"), F.lit(0).alias("paragraph_number"))))
    assert schemas.violations(nested, schemas.ARTICLE).first()["violation"] == "keyword.keyword is required"
    full = a.withColumn("score", F.lit(1.0)).withColumn("hot_count", F.lit(1))
    j = json.loads(full.filter("published_time is not null and crawl_time is not null").select(schemas.to_json(schemas.ARTICLE)).first()[0])
    assert isinstance(j["published_time"], str) and isinstance(j["crawl_time"], int) and "paragraph" not in j and "score" not in j
    back = schemas.from_document(schemas.to_document(full, schemas.ARTICLE), schemas.ARTICLE)
    assert back.select("url_id", "title", "paragraph").exceptAll(a.select("url_id", "title", "paragraph")).count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,"b, ""q""\nx",\n\n"",2,3\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c.csv"), "a string, b string, c string").collect()][0] == ("a", 'b, "q"\nx', None)
    (tmp_path / "l.txt").write_text("one\n// no\n\n two\n")
    assert [r[0] for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", " two"]
    (tmp_path / "f.xml").write_text('<feed><item><link>http://a/1</link></item><item><guid>http://a/2</guid></item><entry><link href="http://a/3"/></entry></feed>')
    assert sorted(r[0] for r in readers.read_feed(spark, str(tmp_path / "f.xml")).collect()) == ["http://a/1", "http://a/2", "http://a/3"]
    (tmp_path / "p.xml").write_text("<p><position><title>t</title><company><name>Old</name></company><start-date><year>2001</year></start-date><end-date><year>2003</year></end-date></position>"
                                    "<position><title>t</title><company><name>Now</name></company><start-date><year>2004</year></start-date></position></p>")  # fmt: skip
    assert [r[0] for r in readers.read_positions(spark, str(tmp_path / "p.xml")).collect()] == ["Now", "Old"]


def test_line_formats(spark):
    lines = spark.createDataFrame([("<http://d/resource/Mercury_(planet)> <http://type> <http://d/ontology/Planet> .",), ("<http://d/resource/New_York> <http://t> <http://w/owl#City> .",), ("junk",)], "value string")
    assert sorted(map(tuple, readers.instance_types(lines).collect())) == [("Mercury", "planet", "Planet"), ("New York", None, "City")]
    quads = spark.createDataFrame([('<http://d/resource/A> <http://abstract> "Text one."@en <http://src> .',), ('<http://d/resource/A> <http://abstract> "Text two."@en <http://src> .',), ("",)], "value string")
    assert [tuple(r) for r in readers.long_abstracts(quads).collect()] == [("A", "Text one.")]
    ner = spark.createDataFrame([("<START:person> Al <END> of <START:organization> Org <END>",), ("<START:person> a <START:person> b <END>",)], "value string")
    assert [tuple(r) for r in readers.ner_lines(ner, "person").collect()] == [("<START:person> Al <END> of Org", True), ("<START:person> a <START:person> b <END>", False)]
    m = readers.parse_text_proto('a: "x\\n" # c\nb { c: 3 d: true }\nb: { c: -1.5 }')
    assert m == {"a": ["x\n"], "b": [{"c": [3], "d": [True]}, {"c": [-1.5]}]}
    for bad in ("a {", "}", "a: ?"):
        with pytest.raises(ValueError):
            readers.parse_text_proto(bad)


def test_changes(spark):
    df = spark.createDataFrame([("a", 1, ["x"]), ("b", None, None), ("c", 3, [])], "id string, n int, l array<string>")
    out = store.update(df, spark.createDataFrame([("a", 9), ("q", 8)], "id string, n int"), "id")
    assert {r["id"]: r["n"] for r in out.collect()} == {"a": 9, "b": None, "c": 3}
    up = store.upsert(df, spark.createDataFrame([("a", 9, ["z"]), ("q", 8, None)], df.schema), "id")
    assert {r["id"]: r["n"] for r in up.collect()} == {"a": 9, "b": None, "c": 3, "q": 8}
    new = store.insert_new(df, spark.createDataFrame([("a", 9, None), ("q", 8, None), ("q", 8, None)], df.schema), "id")
    assert {r["id"]: r["n"] for r in new.collect()} == {"a": 1, "b": None, "c": 3, "q": 8}
    pushed = store.push_once(df, F.lit(True), "l", F.lit("x"))
    assert {r["id"]: r["l"] for r in pushed.collect()} == {"a": ["x"], "b": ["x"], "c": ["x"]}
    assert {r["id"] for r in store.delete(df, Query().where_at_least("n", 2), "id").collect()} == {"a", "b"}
    assert {r["id"] for r in store.delete(df, Query(key="id").descending("n").limit(1), "id").collect()} == {"a", "b"}
    assert store.set_field(df, "id", "b", "n", F.lit(7)).filter("id = 'b'").first()["n"] == 7
    pr = spark.createDataFrame([("a", 1, True), ("b", 5, None), ("c", 4, False), ("d", 4, False), ("e", 1, False), ("f", None, None)], "id string, t bigint, r boolean")
    assert {r["id"] for r in store.prune(pr, 3, "t", "id", "r").collect()} == {"a", "b", "c", "d"}
    assert {r["id"] for r in readers.new_rows(pr, pr.filter("id < 'c'"), "id").collect()} == {"c", "d", "e", "f"}


def test_csv_lines_and_personas(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,"b ""c"", d",e\r\n\n"two\nlines",,\n')
    got = sorted((r["line"], r["fields"]) for r in readers.read_csv_lines(spark, str(tmp_path / "x.csv")).collect())
    assert got == [(0, ["a", 'b "c", d', "e"]), (1, [""]), (2, ["two\nlines", "", ""])]
    text = 'name: "Ada" email: "a@x.example"\ngood_url: "http://a" good_url: "http://b"\ninterest { type: INDUSTRY industry_code: 7 } interest { type: ENTITY entity { keyword: "Quern" } }'
    p = readers.personas(spark, [text]).first()
    assert (p["name"], p["good_url"], p["bad_url"]) == ("Ada", ["http://a", "http://b"], []) and [tuple(i) for i in p["interest"]] == [("INDUSTRY", 7, None), ("ENTITY", None, "Quern")]
    with pytest.raises(ValueError):
        readers.personas(spark, ['name: "x"'])
