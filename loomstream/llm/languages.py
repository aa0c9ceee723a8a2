"""The language of texts by character trigrams: a naive Bayes model of hashed trigrams, trained on labelled documents.

Labels are brought to the two letters before any region ('en-US', 'EN' and 'en' are one language). The model is fitted
on at most PER_LANGUAGE documents of each language, drawn by hash of the id, each as a whole, or on all of them, which
are then counted on the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstream.llm.words import batches, codepoints, lowered

PER_LANGUAGE, BITS = 300, 15


@dataclass
class Languages:
    names: list[str]  # in order; '?' is what has no trigram, or all when nothing is labelled
    weight: np.ndarray  # (trigram buckets, languages): log chances

    def of(self, texts: list[str]) -> np.ndarray:
        """Index into names (+ '?' at the end) of each text's language."""
        n = len(texts)
        out = np.full(n, len(self.names), np.int64)
        if not self.names:
            return out
        for a, b in batches(n, np.array([len(t or "") + 1 for t in texts])):
            bucket, text = _trigrams(texts[a:b])
            if len(text):
                starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                out[a + text[starts]] = np.add.reduceat(self.weight[bucket], starts, axis=0).argmax(1)
        return out

    def named(self, texts: list[str]) -> list[str]:
        return [([*self.names, "?"])[i] for i in self.of(texts)]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every trigram of letters and single gaps; digits and signs are gaps."""
    cp, starts = codepoints(texts)
    cp = lowered(cp).astype(np.uint64)
    letter = ((cp >= 0x61) & (cp <= 0x7A)) | (cp >= 0xC0)
    cp = np.where(letter, cp, np.uint64(0x20))
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    keep = letter | np.r_[True, letter[:-1]]
    cp, text = cp[keep], text[keep]
    if len(cp) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = (cp[:-2] << np.uint64(42)) ^ (cp[1:-1] << np.uint64(21)) ^ cp[2:]
    ok = text[:-2] == text[2:]
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)[ok], text[:-2][ok]


def fit(texts: list[str], labels: list[str]) -> Languages:
    names = sorted(set(labels))
    counts = np.full((1 << BITS, len(names)), 0.1)
    for j, name in enumerate(names):
        mine = [t for t, x in zip(texts, labels, strict=True) if x == name]
        for a, b in batches(len(mine), np.array([len(t) + 1 for t in mine])):
            counts[:, j] += np.bincount(_trigrams(mine[a:b])[0], minlength=1 << BITS)
    return Languages(names, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32))


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bucket, trigrams) of all rows; bucket -1 has the documents."""
    total: dict[str, np.ndarray] = {}
    for batch in it:
        texts, lang = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for name in sorted(set(lang)):
            mine = [t for t, x in zip(texts, lang, strict=True) if x == name]
            n = total.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
            n[-1] += len(mine)
            for a, b in batches(len(mine), np.array([len(t) + 1 for t in mine])):
                n[:-1] += np.bincount(_trigrams(mine[a:b])[0], minlength=1 << BITS)
    for name, n in total.items():
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell)), pa.array(np.where(cell < 1 << BITS, cell, -1), pa.int32()), pa.array(n[cell])], names=["lang", "bucket", "n"])


def _fit_counts(rows: DataFrame) -> Languages:
    got = rows.select("text", "lang").mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = np.array(got.column("lang").to_pylist(), object), got.column("bucket").to_numpy(), got.column("n").to_numpy()
    names = sorted(lang[(bucket < 0) & (n >= 5)])
    counts = np.full((1 << BITS, len(names)), 0.1)
    for j, name in enumerate(names):
        mine = (lang == name) & (bucket >= 0)
        counts[bucket[mine], j] += n[mine]
    return Languages(names, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32))


def train(docs: DataFrame, limit: int | None = PER_LANGUAGE) -> Languages:
    """Fit on docs (doc_id, text, lang); null languages and texts don't teach, nor does a language of fewer than 5 documents."""
    lang = F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2})(?:[-_]|\s*$)", 1))
    rows = docs.select("doc_id", "text", lang.alias("lang")).filter("lang <> '' and length(text) > 0")
    if limit is None:
        return _fit_counts(rows)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit).collect()  # bounded by limit and the languages there are
    size: dict[str, int] = {}
    for r in rows:
        size[r["lang"]] = size.get(r["lang"], 0) + 1
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in rows if size[r["lang"]] >= 5)
    return fit([r[1] for r in rows], [r[2] for r in rows])
