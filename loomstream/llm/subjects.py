"""Subject areas of documents by subject-specific interpolated n-gram language models.

Each subject has an interpolated model: bigrams of the subject, its unigrams, and the unigrams of the whole corpus
as background, all over hashed words. A sentence is worth, for each subject, the per-token cross-entropy of the
background less that of the subject's model. The models are fitted on all hand-labelled articles: sentences of an
article start with its labelled subjects and are reassigned by the models themselves (expectation maximisation),
because an article about one subject may give part of its sentences to another. The share of a document's sentences
that go to a subject is compared with a cut that is calibrated on the labels, wrong and undecided ones included.

The labelled articles' words are written once and stay on the workers; every round of training is a pass over them.
The driver gets counts of word buckets, whose number is fixed, and of the word pairs that can have a chance. They are
whole numbers, so no order of adding changes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstream.llm.boilerplate import Labeller, page_columns, page_pieces, train_labeller
from loomstream.llm.languages import Languages
from loomstream.llm.languages import train as train_languages
from loomstream.llm.words import batches, codepoints, mix, words
from loomstream.session import ship, written

UNI, BI = 17, 35
ROUNDS = 6
#: Counts are in whole parts of a document; words of a piece that is counted at a time.
ONE, WORDS = 1 << 12, 300_000
#: Documents taken off each count (in languages with FEW documents a subject or more), and the weights of bigrams and
#: unigrams to begin with (the rest is the background's): held-out text settles them.
DISCOUNT, FEW, W_BI, W_UNI = 3.0, 100, 0.2, 0.7
#: The part of it where there is no document, and the documents from which on it grows with them: stray words are a share of all.
LEAST_OFF, MANY = 0.1, 300
SHARE = 0.25
#: What held-out labels choose from: how much a token's gain counts, and how likely a sentence of no subject is.
TEMPERS, NONES = (0.3, 0.5, 0.8), (1.0, 1.5, 2.5)


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, sentence of each word, text of each sentence); sentences end with . ! or ? before a gap, and with lines."""
    cp, starts = codepoints(texts)
    h, at, begin = words(texts, (cp, starts))
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.isin(cp[:-1], [0x2E, 0x21, 0x3F]) & np.isin(cp[1:], [0x20, 0x0A, 0xA0, 0x201D, 0x22, 0x2019, 0xBB, 0x29])
    cuts = np.union1d(np.flatnonzero(stop), np.flatnonzero(cp == 0x0A))
    piece = np.searchsorted(cuts, begin)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    new = np.r_[True, (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])]
    sent = np.cumsum(new) - 1
    return h, sent, text[new]


def tagged(texts: list[str], languages: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sentences() with words of different languages kept apart, and the language of each text."""
    h, sent, text = sentences(texts)
    lang = languages.of(texts)
    return mix(h + (lang[text[sent]] * 7919).astype(np.uint64)) if len(h) else h, sent, text, lang


def _uni(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << UNI) - 1)).astype(np.int64)


def _bi(h: np.ndarray, sent: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Key of each word with the one before it in its sentence: language, bucket of the word before + 1 (0: it is the first), and a hash of both; lang: of each sentence."""
    first = np.r_[True, sent[1:] != sent[:-1]][: len(h)]
    before, given = np.r_[np.uint64(0), h[:-1]][: len(h)], np.r_[0, _uni(h)[:-1] + 1][: len(h)]
    pair = (mix(np.where(first, np.uint64(12345), before) * np.uint64(31) + h) >> np.uint64(64 - BI)).astype(np.int64)
    return (lang[sent] << (BI + UNI + 1)) | (np.where(first, 0, given) << BI) | pair


@dataclass
class Models:
    subjects: list[str]
    languages: Languages
    background: np.ndarray  # count of each unigram bucket in the corpus, then the words of each language
    uni: np.ndarray  # (buckets, subjects) chance under the subject
    keys: np.ndarray  # of the bigrams that have a chance, in order
    bi: np.ndarray  # (bigrams, then one for all others; subjects) chance of the word after the one before
    weights: tuple[float, float] = (W_BI, W_UNI)
    temper: float = 0.5
    none: float = 1.5
    cuts: np.ndarray | None = None  # share of sentences from which each subject is accepted

    def rows(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key)
        return np.where(np.r_[self.keys, -1][at] == key, at, len(self.keys))

    def parts(self, h: np.ndarray, sent: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of each word by the bigrams and unigrams of each subject, and by the background; lang: of each sentence."""
        u = _uni(h)
        bg = (self.background[u] / self.background[(1 << UNI) + lang[sent]]).astype(np.float32)[:, None]
        return self.bi.take(self.rows(_bi(h, sent, lang)), axis=0), self.uni.take(u, axis=0), bg

    def gains(self, h: np.ndarray, sent: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """(sentences, subjects): cross-entropy of the background less that of the subject, in nats per token; lang: of each sentence."""
        n = len(lang)
        out = np.zeros((n, len(self.subjects)), np.float32)
        starts = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]]) if len(sent) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(sent)]
        count = np.maximum(np.bincount(sent, minlength=n), 1).astype(np.float32)[:, None]
        for a in range(0, len(starts), 8_000):  # sentences at a time
            first = starts[a : a + 8_000]
            t = slice(first[0], ends[min(a + 8_000, len(ends)) - 1])
            bi, uni, bg = self.parts(h[t], sent[t], lang)
            w_bi, w_uni = self.weights
            p = w_bi * bi + w_uni * uni + (1 - w_bi - w_uni) * bg
            out[sent[first]] = np.add.reduceat(np.log(p / bg), first - first[0], axis=0)
        return out / count


def _per_document(cell: np.ndarray, text: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each distinct cell and document, which of these each word belongs to)."""
    pairs, inverse = np.unique((text.astype(np.int64) << bits) | cell, return_inverse=True)
    return pairs & ((1 << bits) - 1), inverse


def kinds(h: np.ndarray, sent: np.ndarray, lang: np.ndarray, n_lang: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unigram bucket, language, words) of all there are; lang: of each sentence."""
    pair, n = np.unique(_uni(h) * n_lang + lang[sent], return_counts=True)
    return pair // n_lang, pair % n_lang, n


def commonest(cell: np.ndarray, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The language that each unigram bucket holds most often."""
    out, order = np.zeros(1 << UNI, np.int64), np.lexsort((lang, n, cell))
    out[cell[order]] = lang[order]
    return out


def counted(h: np.ndarray, sent: np.ndarray, text: np.ndarray, lang: np.ndarray, weight: np.ndarray, n_lang: int, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by subject, in parts of ONE: (unigram buckets, bigrams by the bucket before, languages; subjects) added to `out`, keys of bigrams, (keys, subjects).

    A word counts at most once per document, so that the names a story repeats don't pass for its subject's words. weight is
    (sentences, subjects).
    """
    doc, n = text[sent], len(lang)
    ucell, uwhere = _per_document(_uni(h), doc, UNI)
    keys, key = np.unique(_bi(h, sent, lang[text]), return_inverse=True)
    pairs, bwhere = np.unique(doc.astype(np.int64) * max(1, len(keys)) + key, return_inverse=True)
    bcell, given = pairs % max(1, len(keys)), given_of(keys)
    out = np.zeros(((2 << UNI) + n_lang, weight.shape[1]), np.int64) if out is None else out
    bi = np.zeros((len(keys), weight.shape[1]), np.int64)
    parts = lambda where, w, n: np.rint(np.minimum(np.bincount(where, w, minlength=n), 1.0) * ONE)
    add = lambda to, cell, n: np.add(to, np.bincount(cell, n, minlength=len(to)).astype(np.int64), out=to)
    for s in range(weight.shape[1]):
        w = weight[sent, s]
        add(out[: 1 << UNI, s], ucell, parts(uwhere, w, len(ucell)))
        add(bi[:, s], bcell, parts(bwhere, w, len(pairs)))
        add(out[1 << UNI : 2 << UNI, s], given[given >= 0], bi[given >= 0, s])
        add(out[-n_lang:, s], lang, parts(text, weight[:, s], n))
    return out, keys, bi


def given_of(keys: np.ndarray) -> np.ndarray:
    """Unigram bucket of the word before; -1: none."""
    return ((keys >> BI) & ((2 << UNI) - 1)) - 1


def models_of(subjects: list[str], languages: Languages, background: np.ndarray, uni_lang: np.ndarray, counts: np.ndarray, keys: np.ndarray, bigrams: np.ndarray) -> Models:
    """Models from what counted() gives."""
    k, n_lang = len(subjects), len(languages.names) + 1
    uni, bi = np.zeros((1 << UNI, k), np.float32), np.zeros((len(keys), k), np.float32)
    before, lang = given_of(keys), keys >> (BI + UNI + 1)
    for s in range(k):
        c, follows, docs = np.split(counts[:, s] / ONE, [1 << UNI, 2 << UNI])
        off = DISCOUNT * np.maximum(LEAST_OFF + (1 - LEAST_OFF) * np.minimum(docs / FEW, 1), docs / MANY)
        total = np.maximum(np.bincount(uni_lang, c, minlength=n_lang), 1.0)
        uni[:, s] = np.maximum(c - off[uni_lang], 0) / total[uni_lang]
        given = np.where(before < 0, max(docs.sum(), 1.0), np.maximum(follows[np.maximum(before, 0)], 1.0))
        bi[:, s] = np.maximum(bigrams[:, s] / ONE - off[lang], 0) / given
    some = bi.any(1)
    return Models(subjects, languages, background, uni, keys[some], np.r_[np.minimum(bi[some], 1.0), np.zeros((1, k), np.float32)])


def fit_models(subjects: list[str], languages: Languages, background: np.ndarray, h: np.ndarray, sent: np.ndarray, text: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> Models:
    """Models from sentences weighted by subject, all here: weight is (sentences, subjects)."""
    n_lang = len(languages.names) + 1
    return models_of(subjects, languages, background, commonest(*kinds(h, sent, lang[text], n_lang)), *counted(h, sent, text, lang, weight, n_lang))


def mixtures(gains: np.ndarray, tokens: np.ndarray, text: np.ndarray, prior: np.ndarray, temper: float = 0.5, none: float = 1.5, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(share of each document's sentences by subject, chances of each sentence's subject).

    A document is a mixture of few subjects: its sentences are judged together, so that a stray best subject of one
    sentence gives way to the subjects of the others. `prior` counts as PRIOR_SENTENCES sentences.
    """
    n, k = prior.shape
    like = np.exp(np.clip(gains * np.minimum(tokens, TOKENS)[:, None] * temper, -30, 30))
    like = np.concatenate([like, np.full((len(like), 1), none)], 1)
    full = np.concatenate([prior, np.full((n, 1), 0.1)], 1)
    full /= full.sum(1, keepdims=True)
    mix_ = full.copy()
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    for _ in range(rounds):
        each = mix_.take(text, axis=0) * like
        each /= each.sum(1, keepdims=True)
        if len(starts):
            total = np.zeros((n, k + 1))
            total[text[starts]] = np.add.reduceat(each, starts, axis=0)
            total = np.maximum(total - SPARSE, 0) + full * PRIOR_SENTENCES
            mix_ = total / total.sum(1, keepdims=True)
    count = np.bincount(text, minlength=n)[:, None]
    share = np.zeros((n, k + 1))
    if len(starts):
        share[text[starts]] = np.add.reduceat(each, starts, axis=0)
    return (share / np.maximum(count, 1))[:, :k], each[:, :k] if len(text) else np.zeros((0, k))


TOKENS, SPARSE, PRIOR_SENTENCES = 30, 0.4, 0.5


def sentence_weights(models: Models | None, h: np.ndarray, sent: np.ndarray, text: np.ndarray, lang: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """(sentences, subjects): by the labels alone to begin with, then by the models, where they are sure.

    yes and no are (texts, subjects) booleans; texts with neither are unlabelled and help the mixtures.
    """
    share = 1 / np.maximum(yes.sum(1, keepdims=True), 1)
    if models is None:
        return np.where(yes, share, 0.0)[text]
    prior = np.where(no, 0.005, np.where(yes, 0.7 * share, 0.03))
    _, weight = mixtures(models.gains(h, sent, lang[text]), np.bincount(sent, minlength=len(text)), text, prior)
    return weight * (weight.max(1, keepdims=True) > 0.6)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(word hashes, sentence of each word, text of each sentence, language, half, yes, no) of the rows of tokens(), a bounded number of words at a time."""
    flat = lambda c, a, b: batch.column(c).slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
    size = lambda c, a, b: pc.list_value_length(batch.column(c).slice(a, b - a)).to_numpy(zero_copy_only=False)
    n = batch.num_rows
    for a, b in batches(n, size("h", 0, n), WORDS):
        lens, label = flat("lens", a, b), flat("label", a, b).reshape(b - a, -1)
        sent, text = np.repeat(np.arange(len(lens)), lens), np.repeat(np.arange(b - a), size("lens", a, b))
        lang, part = (batch.column(c).slice(a, b - a).to_numpy().astype(np.int64) for c in ("lang", "part"))
        yield flat("h", a, b).astype(np.int64).view(np.uint64), sent, text, lang, part, label > 0, label < 0


def _tokens(net, languages, subjects: list[str]):
    names = {s: i for i, s in enumerate(subjects)}

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, texts in _bodies(net.value, batch):
                h, sent, text, lang = tagged(texts, languages.value)
                label = np.zeros((b - a, len(names)), np.int8)
                for sign, column in ((1, "yes"), (-1, "no")):
                    for i, codes in enumerate(batch.column(column).slice(a, b - a).to_pylist()):
                        label[i, [names[c] for c in codes if c in names]] = sign
                lens, first = np.bincount(sent, minlength=len(text)), np.searchsorted(text, np.arange(b - a + 1))
                word = np.r_[0, np.cumsum(lens)][first]
                lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
                parts = [batch.column("part").slice(a, b - a), pa.array(lang, pa.int32()), lists(word, h.view(np.int64)), lists(first, lens.astype(np.int32)), lists(np.arange(b - a + 1) * len(names), label.ravel())]
                yield pa.RecordBatch.from_arrays(parts, names=["part", "lang", "h", "lens", "label"])

    return make


def tokens(pages: DataFrame, net, languages, subjects: list[str]) -> DataFrame:
    """The words, sentences, language and labels of each row of labelled(), written once, as many files as there are cores."""
    pages = pages.withColumn("part", F.pmod(F.xxhash64("url_id", F.lit(29)), F.lit(2)).cast("int"))  # two halves, each judged by the models of the other
    rows = pages.mapInArrow(_tokens(net, languages, subjects), "part int, lang int, h array<bigint>, lens array<int>, label array<tinyint>")
    return written(rows.repartition(pages.sparkSession.sparkContext.defaultParallelism), "tokens")


def _gather_kinds(n_lang: int):
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for h, sent, text, lang, *_ in _pieces(batch):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kinds(h, sent, lang[text], n_lang)], names=["cell", "lang", "n"])

    return count


def _gather(shared, n_lang: int, halves: bool):
    """What counted() gives by the subjects that the models give to the sentences, of each half apart where halves are wanted; key -1 - i is row i of the counts."""

    def rows(part: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, subject = np.nonzero(n)
        for a in range(0, len(at), 1 << 18):
            t, s = at[a : a + (1 << 18)], subject[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), part, np.int32)), pa.array(key[t]), pa.array(s, pa.int32()), pa.array(n[t, s])], names=["part", "key", "subject", "n"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | None] = [None] * (1 + halves)
        for batch in it:
            for h, sent, text, lang, part, yes, no in _pieces(batch):
                weight = sentence_weights(shared.value, h, sent, text, lang, yes, no)
                for i in range(1 + halves):
                    total[i], keys, bi = counted(h, sent, text, lang, weight * (part[text] == i)[:, None] if halves else weight, n_lang, total[i])
                    yield from rows(i, keys, bi)
        for i, t in enumerate(total):
            if t is not None:
                yield from rows(i, -1 - np.arange(len(t)), t)

    return count


def _counts_of(rows: DataFrame, shared, n_lang: int, k: int, halves: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(halves, counts, subjects), keys, (halves, keys, subjects); bigrams that even the least discount leaves nothing of are not sent."""
    of = lambda i: F.sum(F.when(F.col("part") == i, F.col("n")).otherwise(0)).alias(f"n{i}")
    got = rows.mapInArrow(_gather(shared, n_lang, halves), "part int, key bigint, subject int, n bigint").groupBy("key", "subject").agg(of(0), of(1))
    got = got.filter(f"key < 0 or n0 + n1 > {DISCOUNT * LEAST_OFF * ONE}d").toArrow()
    key, subject, *n = (got.column(c).to_numpy() for c in ("key", "subject", "n0", "n1"))
    pair = key >= 0
    keys, at = np.unique(key[pair], return_inverse=True)
    counts, bigrams = np.zeros((1 + halves, (2 << UNI) + n_lang, k), np.int64), np.zeros((1 + halves, len(keys), k), np.int64)
    for i in range(1 + halves):
        counts[i][-1 - key[~pair], subject[~pair]], bigrams[i][at, subject[pair]] = n[i][~pair], n[i][pair]
    return counts, keys, bigrams


def _gather_held_out(shared):
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, halves = shared.value
        for batch in it:
            for h, sent, text, lang, part, yes, no in _pieces(batch):
                p = held_out(halves, h, sent, text, lang, sentence_weights(models, h, sent, text, lang, yes, no), part)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, i].astype(np.float32)) for i in range(3)], names=["bi", "uni", "bg"])

    return make


def _gather_hits(shared):
    """How many labels of each subject the shares reach at every choice and cut; cut -1 has all labels."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = shared.value
        k = len(halves[0].subjects)
        total = np.zeros((2, len(_CHOICES), k, len(_GRID) + 1), np.int64)
        for batch in it:
            for h, sent, text, lang, part, yes, no in _pieces(batch):
                both = np.zeros((len(text), k), np.float32)
                for i, m in enumerate(halves):
                    both = np.where((part[text] == i)[:, None], m.gains(h, sent, lang[text]), both)
                count = np.bincount(sent, minlength=len(text))
                for c, (temper, none) in enumerate(_CHOICES):
                    shares = mixtures(both, count, text, np.full((len(lang), k), 1.0), temper, none)[0]
                    for j, label in enumerate((yes, no)):
                        total[j, c, :, -1] += label.sum(0)
                        for g, t in enumerate(_GRID):
                            total[j, c, :, g] += (label & (shares >= t)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], names=["cell", "n"])

    return make


def _summed(rows: DataFrame, gather, size: int) -> np.ndarray:
    got = rows.mapInArrow(gather, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def train(subjects: list[str], languages: Languages, background: np.ndarray, rows: DataFrame, rounds: int = ROUNDS) -> Models:
    """Fit on all rows of tokens(), where they are."""
    context, n_lang, k = rows.sparkSession.sparkContext, len(languages.names) + 1, len(subjects)
    met = rows.mapInArrow(_gather_kinds(n_lang), "cell bigint, lang bigint, n bigint").groupBy("cell", "lang").agg(F.sum("n").alias("n")).toArrow()
    fit = lambda c, keys, b: models_of(subjects, languages, background, uni_lang, c, keys, b)
    uni_lang = commonest(*(met.column(c).to_numpy() for c in ("cell", "lang", "n")))
    models = None
    for _ in range(rounds):
        shared = context.broadcast(models)
        counts, keys, bigrams = _counts_of(rows, shared, n_lang, k, False)
        models = fit(counts[0], keys, bigrams[0])
        shared.destroy()
    shared = context.broadcast(models)
    counts, keys, bigrams = _counts_of(rows, shared, n_lang, k, True)
    shared.destroy()
    halves = [fit(counts[1 - i], keys, bigrams[1 - i]) for i in (0, 1)]
    shared = context.broadcast((models, halves))
    kept = written(rows.mapInArrow(_gather_held_out(shared), "bi float, uni float, bg float"), "held")
    shared.destroy()
    models = fit(counts.sum(0), keys, bigrams.sum(0))
    models.weights = interpolated(lambda w: _responsible(kept, w))
    for m in halves:
        m.weights = models.weights
    shared = context.broadcast(halves)
    size = (2, len(_CHOICES), k, len(_GRID) + 1)
    yes, no = _summed(rows, _gather_hits(shared), int(np.prod(size))).reshape(size)
    shared.destroy()
    best = max(range(len(_CHOICES)), key=lambda c: best_cut(yes[c].sum(0), no[c].sum(0))[1])
    models.temper, models.none = _CHOICES[best]
    models.cuts = subject_cuts(yes[best], no[best])
    return models


def _responsible(kept: DataFrame, w: np.ndarray) -> np.ndarray:
    """Sums over all rows of what each part of the mixture has of their chance, added as whole numbers."""
    each = [F.col(c).cast("double") * float(x) for c, x in zip(("bi", "uni", "bg"), w, strict=True)]
    all_ = F.greatest(each[0] + each[1] + each[2], F.lit(1e-30))
    got = kept.agg(*(F.coalesce(F.sum(F.rint(x / all_ * (1 << 24)).cast("bigint")), F.lit(0)) for x in each)).first()
    return np.array(list(got), float)


def held_out(halves: list[Models], h: np.ndarray, sent: np.ndarray, text: np.ndarray, lang: np.ndarray, weight: np.ndarray, part: np.ndarray) -> np.ndarray:
    """(words, 3): chances of the words of sure sentences by bigrams, unigrams and background, looked up in the models of the other half."""
    words_ = np.flatnonzero((weight.max(1) > 0.6)[sent])
    rows, key = [np.zeros((0, 3))], _bi(h, sent, lang[text])
    for i, m in enumerate(halves):
        mine = words_[part[text[sent[words_]]] == i]
        own = weight[sent[mine]].argmax(1)
        u, b = _uni(h[mine]), m.rows(key[mine])
        bg = m.background[u] / m.background[(1 << UNI) + lang[text[sent[mine]]]]
        rows.append(np.stack([m.bi[b, own], m.uni[u, own], bg], 1))
    return np.concatenate(rows)


def interpolated(responsible: Callable[[np.ndarray], np.ndarray], rounds: int = 12) -> tuple[float, float]:
    """Weights of bigrams and unigrams that make held-out sentences likeliest under their own subjects (deleted interpolation)."""
    w = np.array([W_BI, W_UNI, 1 - W_BI - W_UNI])
    for _ in range(rounds):
        total = responsible(w)
        if not total.sum():
            break
        w = np.maximum(total / total.sum(), 0.01)
        w /= w.sum()
    return float(w[0]), float(w[1])


def interpolation(halves: list[Models], h: np.ndarray, sent: np.ndarray, text: np.ndarray, lang: np.ndarray, weight: np.ndarray, part: np.ndarray) -> tuple[float, float]:
    """interpolated() of words that are all here."""
    p = held_out(halves, h, sent, text, lang, weight, part)
    return interpolated(lambda w: (p * w / np.maximum((p * w).sum(1, keepdims=True), 1e-30)).sum(0))


_GRID = np.arange(0.10, 0.41, 0.01)
_CHOICES = [(t, z) for t in TEMPERS for z in NONES]


def best_cut(yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """(share, F1): the cut of best F1, from the positive and negative labels that reach each cut, and all at the end; of about equally good ones the stated quarter's neighbour."""
    f1 = 2 * yes[:-1] / np.maximum(1, yes[:-1] + yes[-1] + no[:-1])
    good = np.flatnonzero(f1 >= f1.max() - 0.01)
    return float(_GRID[good[np.abs(_GRID[good] - SHARE).argmin()]]), float(f1.max())


def subject_cuts(yes: np.ndarray, no: np.ndarray, least: int = 30) -> np.ndarray:
    """Each subject's own cut on held-out shares; that of all subjects where fewer than `least` articles are labelled with it, or none without it."""
    every = best_cut(yes.sum(0), no.sum(0))[0]
    return np.array([best_cut(y, n)[0] if y[-1] >= least and n[-1] >= 5 else every for y, n in zip(yes, no, strict=True)])


def document_shares(models: Models, h: np.ndarray, sent: np.ndarray, text: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """(documents, subjects): share of the sentences that deal with each subject."""
    tokens = np.bincount(sent, minlength=len(text))
    return mixtures(models.gains(h, sent, lang[text]), tokens, text, np.full((len(lang), len(models.subjects)), 1.0), models.temper, models.none)[0]


def accepted(models: Models, shares: np.ndarray, least: int = 0, most: int | None = None) -> np.ndarray:
    """Subjects whose share reaches their cut; at least `least` of those with any share, at most `most`, by share."""
    order = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1)  # rank of each subject in its document
    hit = shares >= (np.full(shares.shape[1], SHARE) if models.cuts is None else models.cuts)
    hit = (hit | (order < least)) & (shares > 0)
    return hit if most is None else hit & (order < most)


def _counts(languages):
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_lang = len(languages.value.names) + 1
        total = np.zeros((1 << UNI) + n_lang, np.int64)
        for batch in it:
            lists = batch.column("paragraph").to_pylist()
            for a, b in batches(len(lists), np.array([sum(len(x) for x in p or [] if x) for p in lists])):
                h, sent, text, lang = tagged(["\n".join(x for x in p or [] if x) for p in lists[a:b]], languages.value)
                total[: 1 << UNI] += np.bincount(_uni(h), minlength=1 << UNI)
                if len(h):
                    total[1 << UNI :] += np.bincount(lang[text[sent]], minlength=n_lang)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell])], names=["cell", "n"])

    return count


def background_model(articles: DataFrame, languages: Languages) -> np.ndarray:
    """Counts of the unigram buckets over all rows' paragraphs, and of the words of each language (half a count is added)."""
    shared = articles.sparkSession.sparkContext.broadcast(languages)
    got = articles.select("paragraph").mapInArrow(_counts(shared), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return smoothed(got.column("cell").to_numpy(), got.column("n").to_numpy(), languages)


def smoothed(cell: np.ndarray, n: np.ndarray, languages: Languages) -> np.ndarray:
    total = np.zeros((1 << UNI) + len(languages.names) + 1)
    total[: 1 << UNI] = 0.5
    total[cell] += n
    total[1 << UNI :] += 1 << 12  # room for the half counts of words never met
    return total


def _bodies(net: Labeller, batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end, texts of title and body elements joined by line feeds) in pieces of bounded size."""
    titles = batch.column("title").to_pylist()
    for a, b, blocks, per_doc, p in page_pieces(net, batch):
        blocks, own, at = blocks.to_pylist(), p <= 0.5, np.r_[0, np.cumsum(per_doc)]
        yield a, b, ["\n".join([titles[a + i] or "", *(blocks[k] for k in range(at[i], at[i + 1]) if own[k] and blocks[k])]) for i in range(b - a)]


def _tagger(model, net, least: int, most: int | None):
    def tag(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = model.value
        names = pa.array(models.subjects)
        for batch in it:
            for a, b, texts in _bodies(net.value, batch):
                h, sent, text, lang = tagged(texts, models.languages)
                shares = document_shares(models, h, sent, text, lang)
                doc, subject = np.nonzero(accepted(models, shares, least, most))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("url_id").slice(a, b - a).take(pa.array(doc)), names.take(pa.array(subject)), pa.array(shares[doc, subject])], names=["url_id", "subject", "share"]
                )

    return tag


def labelled(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per labelled article, all of them, with its decided labels: the codes `yes` and `no`.

    Of contradicting rows for one article and subject, both sides count as undecided.
    """
    per = labels.filter("checked is not null and url_id is not null").groupBy("url_id", F.col("article_classification_code").alias("code")).agg(F.min("checked").alias("lo"), F.max("checked").alias("hi"))
    per = per.filter("lo = hi").groupBy("url_id").agg(F.collect_set(F.when(F.col("hi"), F.col("code"))).alias("yes"), F.collect_set(F.when(~F.col("hi"), F.col("code"))).alias("no"))
    pages = page_columns(articles, "title").join(per, "url_id")
    return pages.groupBy("url_id").agg(F.min(F.struct(*(c for c in pages.columns if c != "url_id"))).alias("page")).select("url_id", "page.*")


def document_subjects(articles: DataFrame, labels: DataFrame, areas: DataFrame, clean: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """(url_id, subject, share): the subjects that each article's share of sentences is calibrated to accept.

    Where it is known how many subjects an article has, `least` and `most` say so: the best ones by share are taken.

    Null titles and arrays are empty; rows delivered twice give equal rows. Without labels there is no result.
    """
    spark = articles.sparkSession
    ship(spark)
    subjects = sorted(r[0] for r in areas.select("subject").distinct().collect())
    net = spark.sparkContext.broadcast(train_labeller(articles, clean))
    languages = train_languages(clean, None)  # on all documents
    rows = tokens(labelled(articles, labels), net, spark.sparkContext.broadcast(languages), subjects)
    models = train(subjects, languages, background_model(articles, languages), rows)
    tag = _tagger(spark.sparkContext.broadcast(models), net, least, most)
    return page_columns(articles, "title").mapInArrow(tag, "url_id string, subject string, share double")
