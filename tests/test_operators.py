import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstream.operators import aggregates as A
from loomstream.operators import joins as J
from loomstream.operators import ranking as R
from loomstream.operators import vectors as V
from loomstream.operators.skewed import heavy_keys, key_profile
from loomstream.plans import suite_text
from loomstream.streaming import gates


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_key_profile_against_plain_loops(spark):
    rnd = random.Random(1)
    data = []
    for i in range(900):
        k = rnd.choice(["hot"] * 6 + ["a", "b", None])
        data.append((k, rnd.choice([None, *range(50)]), f"r{i}", rnd.choice([None, 3, 4])))
    data += data[:40]  # delivered twice
    df = spark.createDataFrame(data, "k string, t bigint, id string, m bigint").withColumn("part", F.lit("x")).withColumn("v", F.lit(1))
    got = {r["k"]: r for r in key_profile(df, "k", "t", "id", "m", partitions=7).collect()}
    for k in ("hot", "a", "b", None):
        mine = sorted({d for d in data if d[0] == k}, key=lambda d: (d[1] is not None, d[1], d[2]))
        times = [d[1] for d in mine if d[1] is not None]
        gaps = [b - a for a, b in itertools.pairwise(times)]
        r = got[k]
        assert (r["n_rows"], r["n_records"], r["first_time"], r["last_time"]) == (sum(d[0] == k for d in data), len(mine), times[0], times[-1])
        assert r["max_gap"] == max(gaps) and abs(r["mean_gap"] - sum(gaps) / len(gaps)) < 1e-9
        assert r["sum_m"] == sum(d[3] or 0 for d in mine)
    assert [r[0] for r in heavy_keys(df, "k", "t", "id", "m", 0.4, 7).collect()] == ["hot"]
    assert key_profile(df.limit(0), "k", "t", "id", "m").count() == 0


def test_suffix_join(spark):
    sites = spark.createDataFrame([("A", "a.com", ["old-a.com"], "u"), ("N", "news.a.com", None, "u"), ("Z", "z.org", [], "u")], "name string, root string, aka array<string>, url string")
    urls_ = spark.createDataFrame([(1, "http://x.news.a.com/1"), (2, "http://www.a.com/"), (3, "http://old-a.com/q"), (4, "http://b.com/"), (5, None), (6, "junk")], "id int, url string")
    got = {r["id"]: r["name"] for r in J.domain_suffix_join(urls_, "url", sites, ["root", "aka"]).collect()}
    assert got == {1: "N", 2: "A", 3: "A", 4: None, 5: None, 6: None}
    assert J.domain_suffix_join(urls_, "url", sites, ["root", "aka"], "inner").count() == 3
    plan = J.domain_suffix_join(urls_, "url", sites, ["root", "aka"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("window", [0, 30])
def test_shared_item_pairs(spark, window):
    rnd = random.Random(2)
    data = [(f"k{i}", ["hot", *rnd.sample("abcdefgh", rnd.randint(0, 4))], rnd.randrange(100)) for i in range(40)] + [("n", None, 1), (None, ["a", "b"], 1), ("e", [], 1), ("nt", ["a", "b", "c"], None), ("dup", ["a", "a", None], 5)]
    df = spark.createDataFrame(data, "key string, items array<string>, t bigint").withColumn("n", F.lit(0)).withColumn("own", F.lit(0))
    got = {(r[0], r[1]): r[2] for r in J.shared_item_pairs(df, "key", "items", 2, "t", window).collect()}
    want = {}
    for (a, x, s), (b, y, t) in itertools.combinations([d for d in data if d[0] and d[1] and d[2] is not None], 2):
        n = len({i for i in x if i} & {i for i in y if i})
        if n >= 2 and (not window or abs(s - t) <= window):
            want[min(a, b), max(a, b)] = n
    assert got == want


def test_conflicts_prefixes_closure(spark):
    closure = J.closure(spark.createDataFrame([("company", "org"), ("org", "thing")], "c string, p string"), "c", "p")
    assert rows(closure.filter("value = 'company'").select("ancestor", "distance")) == [("company", 0), ("org", 1), ("thing", 2)]
    live = spark.createDataFrame([("u", "acme", "company"), ("u", "acme", "person"), ("v", "acme", "company")], "u string, k string, t string")
    dead = spark.createDataFrame([("u", "acme", "org")], "u string, k string, t string")
    assert rows(J.conflict_anti_join(live, dead, "u", F.col("k"), F.col("t"), closure)) == [("u", "acme", "person"), ("v", "acme", "company")]
    names = spark.createDataFrame([("Ab",), ("Abc",), ("X",)], "name string")
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(31)] + [("x", None), (None, "y"), ("n000", "n005")], "c string, p string")
    far = J.closure(chain, "c", "p")
    assert {r["ancestor"]: r["distance"] for r in far.filter("value = 'n000'").collect()} == {f"n{i:03}": i if i < 5 else i - 4 for i in range(32)}
    assert rows(far.filter("value = 'x'").select("ancestor", "distance")) == [("x", 0)] and J.descendants(far, "n031").count() == 32
    with pytest.raises(ValueError):
        J.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "c string, p string"), "c", "p")
    long = spark.createDataFrame([("q" * n,) for n in range(1, 40, 2)] + [(None,), ("",)], "name string").withColumn("__h", F.lit(1))
    kept = J.prefix_anti_join(long, "name", spark.createDataFrame([("q" * 20 + "z",), (None,)], "other string"), "other")
    assert sorted(len(r["name"] or "") for r in kept.collect()) == [0, 0, *range(21, 40, 2)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(J.prefix_anti_join(names, "name", spark.createDataFrame([("Abba",)], "other string"), "other")) == [("Abc",), ("X",)]


def test_distribution_and_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 5, 50, 51)], "v double")
    d = df.agg(A.distribution(F.col("v")).alias("d"))
    at = {p: v for p, v in d.select(F.inline("d")).collect()}
    assert [at[p] for p in (0.0, 0.25, 0.5, 0.75, 1.0)] == [-1, 0, 5, 50, 51]
    q = lambda x: d.select(A.project_quantile(F.col("d"), F.lit(x))).first()[0]
    assert (q(-2.0), q(-1.0), q(5.0), q(52.0), q(None)) == (0.0, 0.0, 0.5, 1.0, None)
    assert df.limit(0).agg(A.distribution(F.col("v")).alias("d")).first()[0] is None
    rnd = random.Random(5)
    data = [(rnd.choice(["hot"] * 8 + ["a", None]), rnd.choice([None, 1.5, *range(30)])) for _ in range(600)] + [("one", 4.0), ("none", None)]
    many = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double").withColumn("n", F.lit(1))
    got = {r["k"]: (r["n"], {x["percentile"]: x["value"] for x in r["distribution"]}) for r in A.distributions(many, ["k"], F.col("v"), 5).collect()}
    for k in ("hot", "a", None, "one"):
        vs = [float(v) for key, v in data if key == k and v is not None]
        assert got[k][0] == len(vs) and np.allclose([got[k][1][p] for p in A.PERCENTILES], np.quantile(vs, A.PERCENTILES))
    assert "none" not in got and A.distributions(many.limit(0), ["k"], F.col("v")).count() == 0
    order = [A.order_statistic(df, "v", r, True, 3).collect() for r in (0, 1, 4, 9)]
    assert [o[0][0] if o else None for o in order] == [51, 50, -1, None]


def test_top_list_ties(spark):
    data = [("z", -1), ("a", 10), ("b", 1), ("c", 100), ("d", 2), ("e", 10000), ("f", 3), ("g", 100000), ("h", 4)]
    df = spark.createDataFrame(data, "key string, value int")
    assert [r[0] for r in A.top_list(df, "key", "value", 5).collect()] == ["g", "e", "c", "a", "h"]
    tied = spark.createDataFrame([("b", 1), ("a", 1), ("a", 1), ("c", 0)], "key string, value int")
    assert [r[0] for r in A.top_list(tied, "key", "value", 2).collect()] == ["a", "b"]


def test_windows(spark):
    df = spark.createDataFrame([("u", 1, "x"), ("u", 2, "x"), ("u", 3, None), ("u", 4, None), ("u", 5, "x"), ("v", 1, "click")], "u string, t bigint, e string")
    assert [r[0] for r in A.islands(df, ["u"], [F.col("t")], F.col("e")).filter("u = 'u'").orderBy("t").select("island").collect()] == [1, 1, 2, 2, 3]
    got = A.followed_by(df, ["u"], [F.col("t")], F.col("e") == "click", "f")
    assert rows(got.groupBy("u", "f").count()) == [("u", False, 5), ("v", True, 1)]
    times = spark.createDataFrame([("u", t) for t in (0, 10, 5000, 5001, 9999, None)] + [("w", None)], "u string, t bigint")
    assert rows(A.last_times(times, "u", "t", 2, 1000)) == [("u", [9999, 5000])]
    assert A.histogram(spark.createDataFrame([(1.0,), (0.0,), (0.55,), (7.0,), (None,)], "v double"), F.col("v"), 10).filter("n > 0").count() == 4


def test_windows_over_ranges_equal_windows_over_groups(spark):
    """A hot key over many ranges, null keys and values, against plain loops."""
    rnd = random.Random(8)
    data = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), t, rnd.choice(["x", "x", "y", None])) for t in rnd.sample(range(2000), 400)]
    df = spark.createDataFrame(data, "k string, t bigint, v string")
    by = {}
    for k, t, v in sorted(data, key=lambda r: r[1]):
        by.setdefault(k, []).append((t, v))
    order, want = [F.col("t")], {"i": set(), "f": set(), "n": set(), "l": {}}
    for k, seq in by.items():
        island = 0
        for j, (t, v) in enumerate(seq):
            island += j == 0 or v != seq[j - 1][1]
            want["i"].add((k, t, island))
            want["f"].add((k, t, any(x == "y" for _, x in seq[j:])))
            want["n"].add((k, t, j % 4 == 0))
        kept = [t for j, (t, _) in enumerate(seq) if j == 0 or t - seq[j - 1][0] > 5]
        want["l"][k] = sorted(kept, reverse=True)[:3]
    three = lambda d, c: {tuple(r) for r in d.select("k", "t", c).collect()}
    for parts in (1, 9):
        assert three(A.islands(df, ["k"], order, F.col("v"), partitions=parts), "island") == want["i"]
        assert three(A.followed_by(df, ["k"], order, F.col("v") == "y", "f", partitions=parts), "f") == want["f"]
        assert three(A.every_nth(df, ["k"], order, 4, partitions=parts), "holdback") == want["n"]
        assert {r["k"]: r["times"] for r in A.last_times(df, "k", "t", 3, 5, partitions=parts).collect()} == want["l"]
    assert A.islands(df.limit(0), ["k"], order, F.col("v")).count() == 0 and A.every_nth(df.limit(0), ["k"], order, 4).count() == 0


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "Thisx Isx Axe Axe Sample"), (2, "Thisx Isx Anotherx Anotherx Examplex Examplex Examplex"), (3, None), (4, "")], "id int, t string")
    counts = V.word_counts(docs, "id", F.col("t"))
    w = {(r["id"], r["word"]): r["weight"] for r in V.tf_idf(counts, V.universe(counts, "id"), 2).collect()}
    assert abs(w[2, "examplex"] - 2.0794385) < 1e-4 and abs(w[1, "thisx"]) < 1e-5
    seed = V.tf_idf(counts, V.universe(counts, "id"), 2).filter("id = 1").select("word", "weight")
    sim = dict(V.cosine_with(V.tf_idf(counts, V.universe(counts, "id"), 2), "id", seed).collect())
    assert abs(sim[1] - 1) < 1e-9 and abs(sim[2]) < 1e-6
    x = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] if r[0] is None else round(r[0], 9) for r in x.select(V.dense_cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None]


def test_network_training(spark):
    rnd = random.Random(3)
    data = [([a, b], int((a > 0.5) != (b > 0.5)), i % 5 == 0) for i in range(200) for a, b in [(rnd.random(), rnd.random())]]
    df = spark.createDataFrame(data, "x array<double>, y int, h boolean")
    got = V.train_networks(df, "x", "y", "h", [0, 4], 2, 3000).orderBy("train_error").first()
    assert got["hidden"] == 4 and got["train_error"] < 0.2
    weights = got["weights"]
    out = df.select("y", V.network_output([F.col("x")[0], F.col("x")[1]], weights[:-1], weights[-1]).alias("o"))
    assert out.agg(F.avg(((F.col("o") > 0.5).cast("int") == F.col("y")).cast("int"))).first()[0] > 0.75


def test_dedupe_and_diversify(spark):
    s = {"A": ["mega", "phan", "mich", "netw", "laun", "yout", "life"], "B": ["phan", "mich", "star", "yout", "outg", "offi"], "C": ["detr", "coup", "boy"], "D": ["grow", "mark"]}
    data = [("u", k, 1.0 - i / 10, 0, v, 0.9 if k == "B" else 0.5) for i, (k, v) in enumerate(s.items())] + [("w", "A", 1.0, 0, None, None), ("w", "B", 0.5, 10**12, None, None)]
    df = spark.createDataFrame(data, "stream string, url_id string, score double, time bigint, stems array<string>, share_score double")
    got = rows(R.dedupe_streams(df).select("stream", "url_id", "hot_count"))
    assert got == [("u", "B", 2), ("u", "C", 0), ("u", "D", 0), ("w", "A", 0), ("w", "B", 0)]
    items = [{"k": {"a"}, "s": set(), "d": "x", "f": set()}, {"k": {"a"}, "s": set(), "d": "x", "f": set()}, {"k": {"b"}, "s": set(), "d": "y", "f": {1}}]
    assert R.diversified(items) == [0, 2, 1] and R.diversified([]) == []
    assert R.difference(items[0], items[1]) == 80


def test_streams_take_all_sites_of_a_user(spark, small, tmp_path):
    """Many sites with one tap and sites of over 153 articles, against every pair of user and article."""
    a = J.first_wins(spark.read.parquet(f"{small}/article.parquet"), ["url_id"], [F.asc("crawl_time")]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(5))))
    a = a.withColumn("published_time", F.col("published_time") - F.col("copy").cast("bigint") * 10**9).withColumn("url_id", F.concat("url_id", F.lit("-"), "copy"))
    a = a.withColumn("origin", F.when(F.col("copy") > 0, "big").otherwise(F.concat(F.lit("site"), F.pmod(F.xxhash64("url_id"), F.lit(7))))).drop("copy")
    a.write.parquet(f"{tmp_path}/article.parquet")
    some = [r[0] for r in a.select("url_id").orderBy(F.xxhash64("url_id")).limit(60).collect()]
    taps = [(f"u{i % 6}", u) for i, u in enumerate(some)] + [("u0", some[0])] * 11 + [("once", some[5]), ("none", None)]
    acts = spark.createDataFrame([(u, x, "TAP_FROM_STREAM") for u, x in taps] + [("u9", some[1], "SCROLL_PAST")], "user_id string, url_id string, action_type string")
    acts.write.parquet(f"{tmp_path}/user_action.parquet")

    art = {r["url_id"]: r for r in a.select("url_id", "origin", "published_time", "feature").collect()}
    n = {}
    for u, x in taps:
        if x:
            n[u, art[x]["origin"]] = n.get((u, art[x]["origin"]), 0) + 1
    want = {}
    for (u, site), k in n.items():
        for x, r in art.items():
            if r["origin"] == site:
                score = max([f["similarity"] for f in r["feature"] or []], default=0.0) * 0.7 + min(k / 10, 1.0) * 0.3
                hours = (1_480_000_000_000 - (r["published_time"] or 0)) / 3_600_000
                want.setdefault(u, []).append((round(score / (1 + max(0.0, hours - 18) / 8760), 12), x))
    want = {u: sorted(v, key=lambda p: (-p[0], p[1]))[:153] for u, v in want.items()}
    got = {}
    for r in suite_text._candidates(spark, str(tmp_path), 153).collect():
        got.setdefault(r["stream"], []).append((r["rank_score"], r["url_id"]))
    assert {u: len(v) for u, v in got.items()} == {u: len(v) for u, v in want.items()} and max(map(len, want.values())) == 153
    for u, v in want.items():
        assert np.allclose(sorted(p[0] for p in got[u]), sorted(p[0] for p in v), atol=1e-9)
        least = min(p[0] for p in v) + 1e-9
        assert {p[1] for p in got[u] if p[0] > least} == {p[1] for p in v if p[0] > least}
    streams = {r[0] for r in suite_text.rank_streams(spark, str(tmp_path)).select("stream").distinct().collect()}
    assert streams == set(want) and "once" in streams


def test_recency_gate_batch_equals_stream(spark, tmp_path):
    rnd = random.Random(4)
    data = [(f"u{rnd.randrange(5)}", rnd.randrange(1000)) for _ in range(300)] + [("u1", None), (None, 5)]
    df = spark.createDataFrame(data, "u string, t bigint")
    want = []
    for k in {d[0] for d in data if d[0]}:
        last = None
        for t in sorted({d[1] for d in data if d[0] == k and d[1] is not None}):
            if last is None or t - last >= 100:
                want.append((k, t))
                last = t
    assert rows(gates.recency_gate_batch(df, "u", "t", 100)) == sorted(want, key=str)
    df.filter("u is not null").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))  # one batch: files are read together
    assert rows(gates.run_to_end(gates.recency_gate(stream, "u", "t", 100), "gate_test", "append")) == sorted(want, key=str)
    assert rows(gates.run_to_end(gates.running_count(stream, ["u"]), "count_test", "complete")) == rows(df.filter("u is not null").groupBy("u").count())
