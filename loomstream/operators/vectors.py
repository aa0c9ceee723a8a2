"""Sparse and dense vectors: word frequencies, TF-IDF, cosine, classification and small networks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstream.functions.text import STOP_WORDS
from loomstream.operators.aggregates import order_statistic, project_quantile, top_per_group
from loomstream.session import salted_join, ship, skew_join, written


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)


def word_counts(docs: DataFrame, key: str, text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(key, word, tf): words of more than two letters that are no stop words."""
    w = docs.select(F.col(key), F.explode(tokens(text)).alias("word"))
    return w.filter(~F.col("word").isin(*stop_words)).groupBy(key, "word").agg(F.count("*").alias("tf"))


def universe(counts: DataFrame, key: str) -> DataFrame:
    """(word, tf, df): the vector of a whole corpus."""
    return counts.groupBy("word").agg(F.sum("tf").alias("tf"), F.count(key).alias("df"))


def tf_idf(counts: DataFrame, corpus: DataFrame, documents: int) -> DataFrame:
    """Counts with weight tf ln(N / (1e-6 + df)); a word the corpus doesn't have has df 0.

    Words that many documents have are spread over tasks by their df. The corpus is read three times: a written table.
    """
    df = F.coalesce(F.col("df"), F.lit(0))
    return skew_join(counts, corpus.select("word", "df"), ["word"], "df", "left").withColumn("weight", F.col("tf") * F.log(F.lit(float(documents)) / (df + 1e-6))).drop("df")


def cosine_with(weights: DataFrame, key: str, seed: DataFrame) -> DataFrame:
    """(key, similarity) of each vector with one seed vector (word, weight); zero norms give 0."""
    norm = seed.agg(F.sqrt(F.sum(F.col("weight") ** 2))).scalar()
    both = salted_join(weights, seed.select("word", F.col("weight").alias("ws")), ["word"], "left")
    out = both.groupBy(key).agg(F.sum(F.col("weight") * F.coalesce("ws", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    out = out.withColumn("ns", norm)
    return out.select(key, F.coalesce(F.try_divide("dot", F.col("n") * F.col("ns")), F.lit(0.0)).alias("similarity"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null for a zero norm."""
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), add)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x), F.lit(0.0), add))
    return F.try_divide(dot, norm(a) * norm(b))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): mean vector of each group, summed element by element before the shuffle."""
    e = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def seed_threshold(df: DataFrame, score: str, share: float) -> DataFrame:
    """(threshold): the distinct score at rank floor(n (1 - share)) from the top, n the distinct scores."""
    d = written(df.select(score).filter(F.col(score).isNotNull()).distinct(), "scores")
    n = d.count()
    return order_statistic(d, score, min(int(n * (1 - share) + 1e-9), n - 1), descending=True).select(F.col(score).alias("threshold")) if n else d.select(F.col(score).alias("threshold"))


def piecewise(quantile: Column, boost: Column, low: Column, high: Column) -> Column:
    """Quantile plus a hundredth of the boost, clamped, then mapped on [0, .78], [.78, .925], [.925, 1] at the cuts low and high."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), quantile + boost / 100))
    part = lambda a, b, x, y: x + F.try_divide(q - a, b - a) * (y - x)
    return F.when(q < low, part(F.lit(0.0), low, 0.0, 0.78)).when(q < high, part(low, high, 0.78, 0.925)).otherwise(F.coalesce(part(high, F.lit(1.0), 0.925, 1.0), F.lit(1.0)))


def kept_features(feature: Column, threshold: float, n: int) -> Column:
    """The n strongest elements of array<struct<feature_id, similarity>> at or above the threshold, ties by id."""
    good = F.filter(feature, lambda f: F.coalesce(f["similarity"] >= threshold, F.lit(False)))
    ordered = F.array_sort(F.transform(good, lambda f: F.struct((-f["similarity"]).alias("o"), f["feature_id"].alias("feature_id"), f["similarity"].alias("similarity"))))
    return F.transform(F.slice(ordered, 1, n), lambda f: F.struct(f["feature_id"].alias("feature_id"), f["similarity"].alias("similarity")))


def similarity_of(feature: Column, feature_id: int) -> Column:
    """Similarity of the first element with this id, else 0."""
    return F.coalesce(F.get(F.filter(feature, lambda f: f["feature_id"] == feature_id), F.lit(0))["similarity"], F.lit(0.0))


def network_output(inputs: list[Column], hidden: list[list[float]], output: list[float]) -> Column:
    """One sigmoid output of a network with one sigmoid hidden layer (or none); weights end with the bias. All in the JVM."""

    def unit(xs: list[Column], w: list[float]) -> Column:
        z = F.lit(float(w[-1]))
        for x, k in zip(xs, w[:-1], strict=True):
            z = z + x * float(k)
        return 1 / (1 + F.exp(-z))

    return unit([unit(inputs, w) for w in hidden] if hidden else inputs, output)


def _backprop(x: np.ndarray, y: np.ndarray, hidden: int, seed: int, rounds: int, rate: float = 0.5, momentum: float = 0.7) -> tuple[list, list, float]:
    """Full-batch gradient descent with momentum on the squared error."""
    rng = np.random.default_rng(seed)
    one = np.ones((len(x), 1))
    shapes = [(x.shape[1] + 1, hidden), (hidden + 1, 1)] if hidden else [(x.shape[1] + 1, 1)]
    ws = [rng.uniform(-0.5, 0.5, s) for s in shapes]
    speed = [np.zeros(s) for s in shapes]
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    out = np.zeros((len(x), 1))
    for _ in range(rounds):
        acts = [np.c_[x, one]]
        for i, w in enumerate(ws):
            z = s(acts[-1] @ w)
            acts.append(np.c_[z, one] if i + 1 < len(ws) else z)
        out = acts[-1]
        d = (out - y[:, None]) * out * (1 - out) / max(len(x), 1)
        for i in range(len(ws) - 1, -1, -1):
            g = acts[i].T @ d
            if i:
                h = acts[i][:, :-1]
                d = (d @ ws[i][:-1].T) * h * (1 - h)
            speed[i] = momentum * speed[i] - rate * g * 10
            ws[i] = ws[i] + speed[i]
    error = float(((out[:, 0] - y) ** 2).mean()) if len(x) else 0.0
    return ([list(map(float, w)) for w in ws[0].T] if hidden else []), list(map(float, ws[-1][:, 0])), error


def train_networks(rows: DataFrame, inputs: str, label: str, holdback: str, hidden: list[int], tries: int, rounds: int = 2000, most: int = 100_000) -> DataFrame:
    """(hidden, try, train_error, holdback_error, weights): a grid of small networks, one task each.

    `rows` is a labelled training set of at most `most` rows (more is an error): inputs array<double>, label 0/1.
    """
    spark = rows.sparkSession
    ship(spark)
    data = rows.select(inputs, F.col(label).cast("double"), holdback).limit(most + 1).toPandas()
    if len(data) > most:
        raise ValueError(f"more than {most} training rows")
    x = np.array(data[inputs].tolist(), float) if len(data) else np.zeros((0, 1))
    y, held = data[label].to_numpy(float), data[holdback].to_numpy(bool)
    shared = spark.sparkContext.broadcast((x, y, held))
    grid = spark.createDataFrame([(h, t) for h in hidden for t in range(tries)], "hidden int, try int")

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, ys, hb = shared.value
        for pdf in it:
            out = []
            for h, t in zip(pdf["hidden"], pdf["try"], strict=True):
                hw, ow, err = _backprop(xs[~hb], ys[~hb], int(h), int(h) * 1000 + int(t), rounds)
                a = np.c_[xs[hb], np.ones(hb.sum())]
                s = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                a = np.c_[s(a @ np.array(hw).T), np.ones(len(a))] if hw else a
                held_err = float(((s(a @ np.array(ow)) - ys[hb]) ** 2).mean()) if hb.any() else None
                out.append((int(h), int(t), err, held_err, [*[list(w) for w in hw], list(ow)]))
            yield pd.DataFrame(out, columns=["hidden", "try", "train_error", "holdback_error", "weights"])

    return grid.repartition(min(len(hidden) * tries, 64)).mapInPandas(fit, "hidden int, try int, train_error double, holdback_error double, weights array<array<double>>")


def ratio_above(df: DataFrame, score: Column, threshold: Column | float) -> DataFrame:
    """(ratio, n): share of the known scores at or above the threshold."""
    return df.agg(F.avg(F.when(score.isNotNull(), F.when(score >= threshold, 1.0).otherwise(0.0))).alias("ratio"), F.count(score).alias("n"))


def rescaled(similarity: Column) -> Column:
    """The upper third of similarities stretched over all of them."""
    return F.greatest(F.lit(0.0), similarity * 3 - 2)


def feature_score(similarity: Column, dist: Column, boost: Column, low: Column, high: Column) -> Column:
    """Score of a text for a feature: the quantile of its similarity, boosted by its site, mapped piecewise; no similarity scores 0."""
    return F.when(similarity.isNull() | dist.isNull(), 0.0).otherwise(piecewise(project_quantile(dist, similarity), boost, low, high))


def top_words(weights: DataFrame, key: str, n: int) -> DataFrame:
    """The n heaviest words of each vector, ties by word."""
    return top_per_group(weights, [key], [F.desc("weight"), F.asc("word")], n)


def reclassified(articles: DataFrame, features: DataFrame, key: str, since: int, until: int, time: str = "published_time", retain: str = "retain") -> DataFrame:
    """Articles with new features where they fall into a slice of time or are retained, and there are new ones; others as they are."""
    due = F.coalesce(F.col(retain), F.lit(False)) | ((F.col(time) >= since) & (F.col(time) < until))
    new = features.select(key, F.col("feature").alias("__new"))
    out = articles.join(new, key, "left").withColumn("feature", F.when(F.coalesce(due, F.lit(False)) & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("feature")))
    return out.select(*articles.columns)
