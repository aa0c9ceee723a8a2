"""Reading level of documents from the levels of their sentences.

A multinomial logistic model with L2 penalty judges every sentence by its hashed words and word pairs, its
character four-grams and its shape. It is fitted on a bounded sample of labelled documents (MAX_LABELLED): each
sentence starts with its document's level, then levels are shared out again by the model and the document's own
mixture (a text for beginners may quote the news), and the model is fitted anew. A document's level comes from the
mean of its sentences' distributions; how much a sentence counts by its length, and the offset of each level, are
calibrated on documents that the models they are judged by have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstream.llm.words import batches, codepoints, distinct, lowered, mix, words
from loomstream.session import ship

MAX_LABELLED, MAX_CHARS = 3_000, 30_000_000  # labelled documents, and their characters in all
LEVELS = (1, 2, 3, 4)
BITS = 17
MIN_DOCS = 3
N_SHAPE = 4
ROUNDS, EPOCHS, PENALTY = 3, 25, 2e-5


@dataclass
class Features:
    """Buckets of words and word pairs (w, sentence ws) and of four-grams (c, sentence cs), both in order of sentences, and shapes."""

    w: np.ndarray
    ws: np.ndarray
    c: np.ndarray
    cs: np.ndarray
    shape: np.ndarray
    length: np.ndarray  # words of each sentence
    text: np.ndarray  # text of each sentence


def features(texts: list[str]) -> Features:
    cp, starts = codepoints(texts)
    h, at, begin = words(texts, (cp, starts))
    stop = np.zeros(len(cp), bool)
    stop[:-1] = np.isin(cp[:-1], [0x2E, 0x21, 0x3F]) & np.isin(cp[1:], [0x20, 0x0A, 0xA0, 0x201D, 0x22, 0x2019, 0xBB, 0x29])
    stop |= cp == 0x0A
    piece_of = np.cumsum(stop) - stop
    piece = piece_of[begin]
    new = np.r_[True, piece[1:] != piece[:-1]] if len(piece) else np.zeros(0, bool)  # words come in order
    uniq, sent = piece[new], np.cumsum(new) - 1
    n = len(uniq)
    text = np.searchsorted(starts, begin[np.searchsorted(piece, uniq)], "right") - 1 if n else np.zeros(0, np.int64)
    low = lowered(cp).astype(np.uint64)
    low = np.where((low >= 0x30) & (low <= 0x39), np.uint64(0x30), low)
    where = np.searchsorted(uniq, piece_of) if n else piece_of
    inside = (where < n) & (uniq[np.minimum(where, max(n - 1, 0))] == piece_of) if n else np.zeros(len(cp), bool)
    grams = (low[:-3] | (low[1:-2] << np.uint64(16)) | (low[2:-1] << np.uint64(32)) | (low[3:] << np.uint64(48))) if len(cp) > 3 else np.zeros(0, np.uint64)
    ok = inside[:-3] & inside[3:] & (where[:-3] == where[3:]) if len(cp) > 3 else np.zeros(0, bool)
    mask = np.uint64((1 << BITS) - 1)
    c = ((grams[ok] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)
    pair = sent[1:] == sent[:-1] if n else np.zeros(0, bool)
    pairs = mix(h[:-1] * np.uint64(31) + h[1:] + np.uint64(1))[pair] if n else h
    w = np.concatenate([h & mask, pairs & mask]).astype(np.int32)
    ws = np.concatenate([sent, sent[1:][pair]]).astype(np.int32) if n else np.zeros(0, np.int32)
    order = np.argsort(ws, kind="stable")
    w, ws = w[order], ws[order]
    length = np.bincount(sent, minlength=n)
    chars = np.bincount(where[:-3][ok], minlength=n) + 3.0
    commas = np.bincount(where[inside & (cp == 0x2C)], minlength=n)
    shape = np.stack([np.log1p(length) / 3, chars / np.maximum(length, 1) / 8, commas / np.maximum(length, 1) * 5, np.ones(n)], 1) if n else np.zeros((0, N_SHAPE))
    return Features(w, ws, c, where[:-3][ok].astype(np.int32) if len(cp) > 3 else ws, shape, length, text)


def joined(parts: list[tuple[Features, int]]) -> Features:
    """Features of several lists of texts as those of one; each with its number of texts."""
    sents, texts, out = 0, 0, {k: [] for k in Features.__dataclass_fields__}
    for x, n in parts:
        for k in ("w", "c", "shape", "length"):
            out[k].append(getattr(x, k))
        out["ws"].append(x.ws + np.int32(sents))
        out["cs"].append(x.cs + np.int32(sents))
        out["text"].append(x.text + texts)
        sents, texts = sents + len(x.shape), texts + n
    return Features(**{k: np.concatenate(v) for k, v in out.items()})


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): sums of the rows of each owner; owners in order."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(owner):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


@dataclass
class ReadingModel:
    word: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, len(LEVELS)), np.float32))
    char: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, len(LEVELS)), np.float32))
    shape: np.ndarray = field(default_factory=lambda: np.zeros((N_SHAPE, len(LEVELS)), np.float32))
    power: float = 0.0
    offset: np.ndarray = field(default_factory=lambda: np.zeros(len(LEVELS)))

    def chances(self, x: Features) -> np.ndarray:
        """(sentences, levels)."""
        n = len(x.shape)
        z = x.shape @ self.shape
        for table, b, s in ((self.word, x.w, x.ws), (self.char, x.c, x.cs)):
            if len(b):
                count = np.bincount(s, minlength=n)
                z = z + _sums(table.take(b, axis=0), s, n) / np.sqrt(np.maximum(count, 1))[:, None]
        z = np.exp(z - z.max(1, keepdims=True)) if n else z
        return z / z.sum(1, keepdims=True) if n else z

    def documents(self, x: Features, n: int, chances: np.ndarray | None = None) -> np.ndarray:
        """(texts, levels): mean distribution over the sentences of each text; zeros for texts without words."""
        p = self.chances(x) if chances is None else chances
        weight = np.maximum(x.length, 1) ** self.power
        total = np.stack([np.bincount(x.text, p[:, k] * weight, minlength=n) for k in range(len(LEVELS))], 1)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-12)

    def levels(self, share: np.ndarray) -> np.ndarray:
        """The level of each distribution; 0 without words."""
        best = np.asarray(LEVELS)[(np.log(share + 1e-3) + self.offset).argmax(1)]
        return np.where(share.sum(1) > 0.5, best, 0)


def _fit(model: ReadingModel, x: Features, target: np.ndarray, known_w: np.ndarray, known_c: np.ndarray, use: np.ndarray) -> None:
    """Adagrad over the sentences that are in `use`; buckets seen in few documents keep weight 0."""
    n, tables = max(int(use.sum()), 1), []
    for table, b, s, known in ((model.word, x.w, x.ws, known_w), (model.char, x.c, x.cs, known_c)):
        keep = known[b] & use[s]
        b, s = b[keep], s[keep]
        order = np.argsort(b, kind="stable")
        ids, at = np.unique(b[order], return_index=True)
        place = np.zeros(1 << BITS, np.int32)
        place[ids] = np.arange(len(ids))
        inv = place[b]
        scale = (1 / np.sqrt(np.maximum(np.bincount(s, minlength=len(target)), 1))).astype(np.float32)[:, None]
        tables.append((table, ids, inv, s, s[order], at, scale, np.full((len(ids), len(LEVELS)), 1e-6, np.float32), table[ids].astype(np.float32)))
    seen, shape, goal = np.full(model.shape.shape, 1e-6), x.shape.astype(np.float32), target.astype(np.float32)
    live = use.astype(np.float32)[:, None] / n
    for _ in range(EPOCHS):
        z = shape @ model.shape
        for _, _, inv, s, _, _, scale, _, v in tables:
            z += _sums(v.take(inv, axis=0), s, len(target)) * scale
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - goal) * live
        for _, ids, _, _, by_bucket, at, scale, g2, v in tables:
            g = (np.add.reduceat((d * scale).take(by_bucket, axis=0), at, axis=0) if len(ids) else np.zeros_like(v)) + PENALTY * v
            g2 += g**2
            v -= 0.3 * g / np.sqrt(g2)
        g = shape.T @ d + PENALTY * model.shape
        seen += g**2
        model.shape -= (0.3 * g / np.sqrt(seen)).astype(np.float32)
    for table, ids, *_, v in tables:
        table[:] = 0
        table[ids] = v


def _known(b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    pairs = distinct((doc.astype(np.int64) << BITS) | b)
    return np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS) >= MIN_DOCS


def _rounds(x: Features, onehot: np.ndarray, rounds: int, use: np.ndarray) -> ReadingModel:
    """Fit on the documents in `use`, sharing out the sentences' levels between the rounds."""
    model, levels = ReadingModel(), np.asarray(LEVELS)
    near = np.exp(-1.0 * np.abs((onehot @ levels)[:, None] - levels[None, :]))
    near /= near.sum(1, keepdims=True)
    target = (0.7 * onehot + 0.3 * near)[x.text]
    mine = use[x.text]
    known_w, known_c = (_known(b[mine[s]], x.text[s][mine[s]]) for b, s in ((x.w, x.ws), (x.c, x.cs)))
    for r in range(rounds):
        _fit(model, x, target, known_w, known_c, mine)
        if r + 1 < rounds:
            p = model.chances(x)
            mixture = 0.4 * onehot + 0.4 * model.documents(x, len(use), p) + 0.2 * near
            target = p * mixture[x.text]
            target /= target.sum(1, keepdims=True)
    return model


def train(texts: list[str], levels: np.ndarray) -> ReadingModel:
    """Fit the sentence model on labelled texts, and calibrate it on two halves, each judged by a model of the other."""
    pieces = batches(len(texts), np.array([len(t) for t in texts]), 400_000)
    x = joined([(features(texts[a:b]), b - a) for a, b in pieces])
    onehot = (levels[:, None] == np.asarray(LEVELS)[None, :]).astype(float)
    part = np.arange(len(texts)) % 2
    p = np.zeros((len(x.shape), len(LEVELS)))
    for k in (0, 1):
        p = np.where((part[x.text] == k)[:, None], _rounds(x, onehot, 1, part != k).chances(x), p)
    model = _rounds(x, onehot, ROUNDS, np.ones(len(texts), bool))
    has = np.bincount(x.text, minlength=len(texts)) > 0

    def right() -> float:
        got = model.levels(model.documents(x, len(texts), p))
        return float((got == levels)[has].mean()) if has.any() else 0.0

    def margin(q: float) -> float:
        """What a change of offset must be worth: two documents in a hundred, and twice the error of the measure."""
        return max(0.01, 2 * math.sqrt(q * (1 - q) / max(1, has.sum())))

    scores = {}
    for power in (0.5, 0.25, 0.75, 0.0, 1.0):
        model.power = power
        scores[power] = right()
    model.power = max(scores, key=scores.__getitem__)  # the first of equals
    for k in range(len(LEVELS)):
        now = right()
        for step in (-0.5, -0.25, 0.25, 0.5):
            model.offset[k] += step
            if right() > now + margin(now):
                now = right()
            else:
                model.offset[k] -= step
    return model


def _judge(model):
    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ReadingModel = model.value
        for batch in it:
            texts = batch.column("text")
            for a, b in batches(batch.num_rows, pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)):
                share = m.documents(features(texts.slice(a, b - a).to_pylist()), b - a)
                level = m.levels(share)
                keep = np.flatnonzero(level)
                out = [batch.column("doc_id").slice(a, b - a).take(pa.array(keep)), pa.array(level[keep], pa.int32()), pa.array(share[keep] @ np.asarray(LEVELS, float))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "reading_level", "difficulty"])

    return judge


def reading_levels(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, reading_level, difficulty): one row per document with words; difficulty is the mean level of its sentences.

    Documents with several different labels don't teach, nor, of the `limit` that are drawn by hash, those after the
    first `chars` characters; null and empty texts have no row; without labels all
    levels are as likely and the first is given.
    """
    spark = docs.sparkSession
    ship(spark)
    per = labels.filter(F.col("reading_level").isin(*LEVELS)).groupBy("doc_id").agg(F.min("reading_level").alias("lo"), F.max("reading_level").alias("hi")).filter("lo = hi")
    chosen = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", F.col("lo").alias("level"))
    few = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")  # bounded by limit
    room = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = sorted((r[0], r[1], r[2]) for r in few.withColumn("room", room).filter((F.col("room") <= chars) | (F.col("room") == F.length("text"))).collect())  # and by chars
    model = train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64)) if rows else ReadingModel()
    return docs.select("doc_id", "text").mapInArrow(_judge(spark.sparkContext.broadcast(model)), "doc_id bigint, reading_level int, difficulty double")
