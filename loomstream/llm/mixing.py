"""Mix sources to target shares of all tokens: cube-method balanced sampling.

Each source's documents are used floor(r) times in full plus a fraction, where r is the wanted tokens over the
source's tokens, at most max_repeats. The fraction is drawn by the cube method: every document starts with the
fractional inclusion probability, and the vector of probabilities walks through the null space of the balancing
constraints (documents and tokens of the source) until all but at most two are 0 or 1. The walk runs on chunks of
each source in parallel; what stays open in a chunk (at most two documents) goes on to the next round together
with that of other chunks, and the last few are landed by the largest remainders of the token balance.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstream.session import salted_join, ship, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokeniser pattern of the byte-level vocabulary (public, as published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 4_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every row; null and empty texts have 0 tokens. The vocabulary file goes to all workers."""
    ship(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(path)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(SparkFiles.get(os.path.basename(path)))
        for b in it:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def source_shares(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(token counts per document of the target sources, one row per target source with what it can reach).

    The output is as large as all documents of the target sources taken once. A source without documents has
    0 tokens and can't reach a positive share. Null sources belong to no target.
    """
    targets = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    wanted = targets.select("source")
    mine = written(token_counts(docs.join(F.broadcast(wanted.limit(10_000)), "source", "left_semi") if wanted.count() <= 10_000 else docs.join(wanted, "source", "left_semi"), path), "tokens")
    per = mine.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    total = mine.agg(F.sum("n_tokens")).first()[0] or 0
    plan = targets.join(per, "source", "left").fillna(0, ["tokens", "docs"])
    plan = plan.withColumn("wanted_tokens", F.col("target_share") * F.lit(float(total)))
    plan = plan.withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= F.col("wanted_tokens"))
    return mine, plan.withColumn("repeats", F.when(F.col("tokens") > 0, F.least(F.col("wanted_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))


def flight(p: np.ndarray, x: np.ndarray, lanes: int = 64) -> np.ndarray:
    """Flight phase for two balancing variables: x is (n, 2); at most two entries of p stay between 0 and 1.

    Three open units always have a direction u with x.T u = 0; the step along it goes as far as a unit allows, on
    the side drawn so that the expectation of p is kept. Units fly in `lanes` at once; what stays open in the lanes
    flies on in fewer. The draw hashes the units' own values.
    """
    p = np.where(np.abs(p - np.round(p)) < _EPS, np.round(p), p)
    rng = np.random.default_rng(abs(int(x.sum() * 1000)) % (1 << 32))
    while True:
        left = np.flatnonzero((p > 0) & (p < 1))
        if len(left) <= 2:
            return p
        _fly_lanes(p, x, left, max(1, min(lanes, len(left) // 6)), rng)


_EPS = 1e-9


def _fly_lanes(p: np.ndarray, x: np.ndarray, units: np.ndarray, lanes: int, rng: np.random.Generator) -> None:
    """Walk the units of each lane until it has at most two open ones; p is changed in place."""
    width = -(-len(units) // lanes)
    grid = np.full((lanes, width), -1)
    grid.ravel()[: len(units)] = units
    nxt, end = np.zeros(lanes, np.int64), (grid >= 0).sum(1)
    held = np.full((lanes, 3), -1)
    while True:
        for k in range(3):  # fill the free seats
            go = np.flatnonzero((held[:, k] < 0) & (nxt < end))
            held[go, k] = grid[go, nxt[go]]
            nxt[go] += 1
        full = np.flatnonzero((held >= 0).all(1))
        if not len(full):
            return
        three = held[full]
        a, b, c = (x[three[:, k]] for k in range(3))
        u = np.stack([b[:, 0] * c[:, 1] - c[:, 0] * b[:, 1], c[:, 0] * a[:, 1] - a[:, 0] * c[:, 1], a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]], 1)
        flat = ~(np.abs(u) > _EPS).any(1)  # the three are proportional: trade between two of them
        some = flat & ((a[:, 0] != 0) | (b[:, 0] != 0))
        u[flat] = (1.0, -1.0, 0.0)
        u[some] = np.stack([b[some, 0], -a[some, 0], np.zeros(int(some.sum()))], 1)
        q = p[three]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min(1)
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min(1)
        step = np.where(rng.random(len(full)) < down / (up + down), up, -down)
        q = np.clip(q + step[:, None] * u, 0, 1)
        q = np.where(q < _EPS, 0.0, np.where(q > 1 - _EPS, 1.0, q))
        p[three] = q
        held[full] = np.where((q == 0) | (q == 1), -1, three)


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
    pdf["p"] = flight(pdf["p"].to_numpy(float), np.stack([np.ones(len(pdf)), pdf["n_tokens"].to_numpy(float)], 1))
    return pdf[["doc_id", "source", "n_tokens", "whole", "p"]]


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """Round the last open documents so that the tokens they add are nearest to what they owe."""
    pdf = _fly(pdf)
    p, tokens = pdf["p"].to_numpy(float), pdf["n_tokens"].to_numpy(float)
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    best = min(range(1 << len(open_)), key=lambda s: abs(sum((((s >> k) & 1) - p[i]) * tokens[i] for k, i in enumerate(open_))))
    for k, i in enumerate(open_):
        p[i] = (best >> k) & 1
    pdf["p"] = p.round()
    return pdf


_STATE = "doc_id bigint, source string, n_tokens bigint, whole int, p double"


def mixed(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document is used; documents used no time have no row.

    A source that can't reach its share is used max_repeats times in full. Repeated doc_ids are rows of their own.
    """
    return sampled(*source_shares(docs, targets, path), chunk).filter("copies > 0")


def sampled(mine: DataFrame, plan: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """mixed() from the results of source_shares(); documents used no time have a row of 0 copies."""
    rows = salted_join(mine.hint("merge"), plan.select("source", "repeats"), ["source"])  # the documents are never broadcast
    rows = rows.withColumn("whole", F.floor("repeats").cast("int"))
    rows = rows.select("doc_id", "source", "n_tokens", "whole", (F.col("repeats") - F.col("whole")).alias("p"))
    exact = rows.filter("p <= 1e-9").withColumn("p", F.lit(0.0))
    rows = rows.filter("p > 1e-9")
    n = max(1, -(-mine.count() // chunk))
    done = [exact]
    while n > 1:
        flown = written(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n))).groupBy("source", "chunk").applyInPandas(_fly, _STATE), "flight")
        done.append(flown.filter("p <= 1e-9 or p >= 1 - 1e-9"))
        rows = flown.filter("p > 1e-9 and p < 1 - 1e-9")
        n = 1 if 3 * n <= chunk else -(-3 * n // chunk)
    done.append(rows.groupBy("source").applyInPandas(_land, _STATE))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("copies", F.col("whole") + F.round("p").cast("int")).select("doc_id", "source", "n_tokens", "copies")


def unreachable_sources(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(source): what the mixture holds of the source stays below its target though each of its documents is used max_repeats times.

    A source without documents holds nothing, and is here when its target is above nothing; with no documents at all no
    source is.
    """
    mine, plan = source_shares(docs, targets, path)
    per = sampled(mine, plan).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("reached"), F.min("copies").alias("least"))
    got = plan.join(per, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    used_up = F.coalesce(F.col("least") >= F.col("max_repeats"), F.lit(True))
    return got.filter(used_up & (F.col("reached") < F.col("wanted_tokens"))).select("source")


def mix_report(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(source, target_share, actual_share, copies, tokens): shares of the output as large as the sources' documents once."""
    out = mixed(docs, targets, path)
    per = out.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    per = written(per, "shares")
    total = per.agg(F.sum("tokens")).first()[0] or 1
    return targets.select("source", "target_share").join(per, "source", "left").fillna(0, ["copies", "tokens"]).withColumn("actual_share", F.col("tokens") / F.lit(total))
