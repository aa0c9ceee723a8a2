"""Evaluation passages inside training text: Wu-Manber multi-pattern search over words.

Patterns are all windows of `m` consecutive words of the test items. The search reads a document from its m-th
word on and looks at the block of the last two words there: the shift table says how many words can be skipped
because no pattern has that block nearer to its end; where the shift is zero, the block's bucket lists the
patterns that end in it, and those whose m words equal the document's are occurrences. All documents of a batch
advance together in numpy, so a step costs no Python per document.

The tables depend on the test items alone (a few hundred kilobytes for some hundred items); items are collected
only up to MAX_ITEM_CHARS, beyond which the tables are built for one slice of the items at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomstream.llm.words import batches, words
from loomstream.session import ship

MIN_WORDS = 15
MAX_ITEM_CHARS = 8_000_000
_OUT = "doc_id bigint, item_id bigint"


@dataclass
class Tables:
    m: int
    blocks: np.ndarray  # sorted block keys that occur in any pattern
    shifts: np.ndarray  # words to advance at each block
    bucket: np.ndarray  # first entry in `ends` of each block (and the end), by block key
    ends: np.ndarray  # pattern start in `text`, ordered by last block
    text: np.ndarray  # words of all items
    items: np.ndarray  # item id of each word


def _blocks(h: np.ndarray) -> np.ndarray:
    """Key of the block that ends at each word; the first word has none of its own text."""
    return h * np.uint64(0x9E3779B97F4A7C15) + np.r_[np.uint64(0), h[:-1]]


def build(ids: list[int], texts: list[str], m: int = MIN_WORDS) -> Tables:
    h, at, _ = words(texts, apart=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    left = at[1:][owner] - np.arange(len(h))  # words from here to the end of the item
    starts = np.flatnonzero(left >= m)
    key = _blocks(h)
    each = np.concatenate([key[starts + j] for j in range(1, m)]) if len(starts) else np.zeros(0, np.uint64)
    dist = np.repeat(np.arange(m - 2, -1, -1), len(starts))
    blocks, inverse = np.unique(each, return_inverse=True)
    shifts = np.full(len(blocks), m - 1, np.int64)
    np.minimum.at(shifts, inverse, dist)
    last = np.searchsorted(blocks, key[starts + m - 1]) if len(starts) else np.zeros(0, np.int64)
    order = np.argsort(last, kind="stable")
    bucket = np.searchsorted(last[order], np.arange(len(blocks) + 1))
    return Tables(m, blocks, shifts, bucket, starts[order], h, np.asarray(ids, np.int64)[owner] if len(h) else np.zeros(0, np.int64))


def search(t: Tables, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, item id) of all occurrences in documents given as word hashes and offsets."""
    if not len(t.blocks) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _blocks(h)
    doc = np.flatnonzero(np.diff(at) >= t.m)
    pos, end = at[doc] + t.m - 1, at[doc + 1]
    found_doc, found_item = [], []
    while len(doc):
        b = np.searchsorted(t.blocks, key[pos])
        b[b == len(t.blocks)] = 0
        known = t.blocks[b] == key[pos]
        step = np.where(known, t.shifts[b], t.m - 1)
        hit = np.flatnonzero(step == 0)
        if len(hit):
            lo, n = t.bucket[b[hit]], t.bucket[b[hit] + 1] - t.bucket[b[hit]]
            who = np.repeat(hit, n)
            pattern = t.ends[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            begin = pos[who] - t.m + 1
            same = h[begin] == t.text[pattern]
            who, pattern, begin = who[same], pattern[same], begin[same]
            same = (h[begin[:, None] + np.arange(t.m)] == t.text[pattern[:, None] + np.arange(t.m)]).all(1)
            found_doc.append(doc[who[same]])
            found_item.append(t.items[pattern[same]])
        pos = pos + np.maximum(step, 1)
        go = pos < end
        doc, pos, end = doc[go], pos[go], end[go]
    if not found_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(found_doc), np.concatenate(found_item)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _scanner(tables):
    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for batch in it:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            sizes = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            docs, items = [], []
            for a, b in batches(len(ids), sizes):
                h, at, _ = words(texts.slice(a, b - a).to_pylist(), apart=True)
                d, i = search(t, h, at)
                docs.append(ids[a:b][d])
                items.append(i)
            if docs and sum(map(len, docs)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(items), pa.int64())], names=["doc_id", "item_id"])

    return scan


def leaked_documents(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id): document and item share at least min_words consecutive words.

    Case, punctuation and spacing don't count: a word is a run of letters and digits, so an apostrophe parts two words. One row per document and item; null or short texts and items have
    none; documents are read once, without a shuffle. Items beyond MAX_ITEM_CHARS are searched slice by slice.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    slices: list[tuple[list[int], list[str]]] = [([], [])]
    size = 0
    for r in items.select("item_id", "text").filter("text is not null").toLocalIterator():
        if size + len(r[1]) > MAX_ITEM_CHARS and slices[-1][0]:
            slices.append(([], []))
            size = 0
        slices[-1][0].append(r[0])
        slices[-1][1].append(r[1])
        size += len(r[1])
    out = None
    for ids, texts in slices:
        found = docs.mapInArrow(_scanner(spark.sparkContext.broadcast(build(ids, texts, min_words))), _OUT)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
