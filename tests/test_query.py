import pytest
from pyspark.sql import functions as F

from loomstream.plans.query import Query

ROWS = [
    ("a", "x", 1, True, [("k1", 5), ("k2", 50)]), ("b", "X", 2, False, [("k2", 1)]), ("c", None, 3, None, []), ("d", "y", None, True, None), ("e", "y", 2, None, [("k1", None)]),
]
DDL = "id string, t string, n int, f boolean, kw array<struct<keyword string, strength int>>"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, DDL)


def ids(d):
    return [r[0] for r in d.select("id").collect()]


def test_equality_and_nulls(df):
    assert sorted(ids(Query().where_equals("t", ["x", "y"]).run(df))) == ["a", "d", "e"]
    assert ids(Query().where_equals("t", []).run(df)) == []
    assert sorted(ids(Query().where_not_equals("t", "y").run(df))) == ["a", "b"]
    assert sorted(ids(Query(dialect="document").where_not_equals("t", "y").run(df))) == ["a", "b", "c"]
    assert sorted(ids(Query().where_not_equals("t", []).run(df))) == ["a", "b", "c", "d", "e"]
    assert sorted(ids(Query().where_equals_ignore_case("t", "x").run(df))) == ["a", "b"]
    assert ids(Query().where_null("t").run(df)) == ["c"]
    assert sorted(ids(Query(dialect="document").where_null("kw").run(df))) == ["c", "d"]
    assert ids(Query().where_null("kw").run(df)) == ["d"]


def test_booleans(df):
    assert sorted(ids(Query().where_true("f").run(df))) == ["a", "d"]
    assert sorted(ids(Query().where_not_true("f").run(df))) == ["b", "c", "e"]
    assert ids(Query().where_false("f").run(df)) == ["b"]
    assert sorted(ids(Query().where_not_false("f").run(df))) == ["a", "c", "d", "e"]


def test_nested(df):
    assert sorted(ids(Query().where_equals("kw.keyword", "k1").run(df))) == ["a", "e"]
    assert sorted(ids(Query().where_not_equals("kw.keyword", "k1").run(df))) == ["b", "c", "d"]
    assert ids(Query().where_greater("kw.strength", 10).run(df)) == ["a"]
    with pytest.raises(ValueError, match="no such field"):
        Query().where_equals("kw.other", 1).run(df)


def test_order_limit(df):
    q = Query(key="id").descending("n")
    assert ids(q.run(df)) == ["c", "b", "e", "a", "d"]
    assert ids(Query(key="id").ascending("n").run(df)) == ["d", "a", "b", "e", "c"]
    assert ids(q.limit(2, 1).run(df)) == ["b", "e"]
    assert ids(q.limit(100, 1).first(df)) == ["b"]
    for bad in (lambda: q.limit(0), lambda: q.limit(1).limit(2), lambda: q.limit(1).where(Query().limit(3))):
        with pytest.raises(ValueError):
            bad()
    assert ids(q.where(None).where(Query().where_at_least("n", 2)).run(df)) == ["c", "b", "e"]
    assert Query().where_like("t", "x%").size(df).first()[0] == 1
    assert Query().with_constant("reason", "r").run(df).select("reason").distinct().collect()[0][0] == "r"


def test_empty_table_and_pushdown(spark, df, small):
    assert Query().where_like("t", "%").descending("n").limit(3).run(df.limit(0)).count() == 0
    plan = Query().where_equals("action_type", "SHARE").run(spark.read.parquet(f"{small}/user_action.parquet")).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(action_type), EqualTo(action_type,SHARE)]" in text
    assert "ReadSchema: struct<id:string,action_type:string>" in text
    nothing = Query().where_equals("id", []).run(spark.read.parquet(f"{small}/user_action.parquet"))
    assert "LocalTableScan" in nothing._jdf.queryExecution().executedPlan().toString()
    assert F is not None
