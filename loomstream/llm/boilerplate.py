"""Page furniture against the article's own body: a bidirectional LSTM that labels every block of a page.

Each block is a vector: the mean of trained embeddings of its hashed words, of its edges and of its tag path, and its
shape (lengths, capitals, digits, separators, how it begins and ends, where it stands). Tag paths are read where the
pages have them (`tag_path`, an array parallel to the blocks, such as "html/body/div.nav/ul/li"); pages without markup
have none, and place and shape stand in for them. The network reads a document's blocks in both directions, so each label
rests on the whole document. All of it is numpy; documents of like length are labelled together.

There are no hand labels. The network is trained on a bounded sample of pages (`sample_pages`) with labels made
from two facts: lines that stand in several pages of their site (counted over all pages there are, not in the sample),
or whose wording is frequent on pages but unknown to the corpus of clean texts, are furniture; paragraphs of the clean
texts are body. A logistic model over these spreads
the labels to the other blocks of the sample; what it is unsure of is left out of the loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstream.llm.repeated_lines import MIN_SUPPORT, line_key, line_rows
from loomstream.llm.words import batches, codepoints, mix, runs, words
from loomstream.session import ship, written

BUCKETS, DIM, HIDDEN = 1 << 13, 12, 24
SAMPLE_PAGES, SAMPLE_CLEAN = 2_000, 2_000
_NUMBER = np.uint64(0x1F2E3D4C5B6A7988)
#: Classes of characters: letters upper and lower, digits, spaces, ends of sentences, separators, commas, quotes, others.
_SEPARATORS, _ENDS, _QUOTES = "|›»>·•/\\«‹–—", ".!?", "\"'”’“‘)]"


@lru_cache(1)
def _char_kinds() -> np.ndarray:
    t = np.full(0x3000, 11, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c == "\n":
            t[i] = 9
        elif c.isspace():
            t[i] = 3
        elif c.isupper():
            t[i] = 0
        elif c.isalpha():
            t[i] = 1
        elif c.isdigit():
            t[i] = 2
        elif c in _ENDS:
            t[i] = 4
        elif c in _SEPARATORS:
            t[i] = 5
        elif c == ",":
            t[i] = 6
        elif c in _QUOTES:
            t[i] = 7
        elif c == ":":
            t[i] = 8
        elif c in "@©®™…":
            t[i] = 10
    return t


class Blocks:
    """Features of the blocks of some documents.

    h, at: word hashes (numbers alike) and the first word of each block; edges: buckets of a block's first word,
    first two words and last word, of its tag path and of that path's last two steps (-1: none); shape: numbers about form, place, and how many of its names the rest of the
    document uses too; heads: first block of each document.
    """

    def __init__(self, texts: list[str], per_doc: np.ndarray, origins: list[str], common: np.ndarray, tags: list[str] | None = None):
        self.h, self.at, self.shape, self.heads, self.edges = block_features(texts, per_doc, origins, common)
        self.edges = np.concatenate([self.edges, tag_edges(tags, len(texts))], 1)

    def __len__(self) -> int:
        return len(self.shape)


def tag_edges(tags: list[str] | None, n: int) -> np.ndarray:
    """(blocks, 2): buckets of each tag path and of its last two steps; -1 where there is none."""
    out = np.full((n, 2), -1, np.int64)
    for i, path in enumerate(tags or []):
        if path:
            for j, part in enumerate((path, "/".join(path.split("/")[-2:]))):
                out[i, j] = zlib.crc32(f"{j} {part}".encode()) & (BUCKETS - 1)
    return out


def _cohesion(h, at, named, heads, origins) -> tuple[np.ndarray, np.ndarray]:
    """(names in each block, share of them that another block of the document has)."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))[named]
    doc = (np.searchsorted(heads, owner, "right") - 1).astype(np.uint64)
    key = mix(h[named] + doc * np.uint64(0x9E3779B97F4A7C15))
    oh, oat, _ = words(origins)
    site = mix(oh + np.repeat(np.arange(len(origins)), np.diff(oat)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = ~np.isin(key, site)  # the site's own name is on all of its pages
    owner, key = owner[own], key[own]
    shared = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key)
        cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        blocks = owner[order]
        several = np.minimum.reduceat(blocks, cuts) != np.maximum.reduceat(blocks, cuts)
        shared[order] = np.repeat(several, np.diff(np.r_[cuts, len(key)]))
    count = np.bincount(owner, minlength=n).astype(np.float32)
    return count, (np.bincount(owner, shared, minlength=n) / np.maximum(count, 1)).astype(np.float32)


def _named_words(h, at, begin, kind) -> np.ndarray:
    """Which words begin with a capital that neither a block nor a sentence begins with."""
    lead = np.zeros(len(h), bool)
    lead[at[:-1][np.diff(at) > 0]] = True
    return (kind[begin] == 0) & ~lead & (kind[np.maximum(begin - 2, 0)] != 4)


def common_names(texts: list[str], per_doc: np.ndarray, share: float = 0.01) -> np.ndarray:
    """Sorted hashes of the capitalised words that stand in more than `share` of the documents: places in no story."""
    cp, starts = codepoints(texts)
    h, at, begin = words(texts, (cp, starts))
    named = _named_words(h, at, begin, _char_kinds()[np.minimum(cp, 0x2FFF)])
    doc = np.repeat(np.repeat(np.arange(len(per_doc)), per_doc), np.diff(at))[named]
    pairs = np.unique(np.stack([h[named], doc.astype(np.uint64)], 1), axis=0)
    vocab, n = np.unique(pairs[:, 0], return_counts=True)
    return vocab[n > max(2, share * len(per_doc))]


def block_features(texts: list[str], per_doc: np.ndarray, origins: list[str], common: np.ndarray) -> tuple[np.ndarray, ...]:
    cp, starts = codepoints(texts)
    h, at, begin = words(texts, (cp, starts))
    n = len(texts)
    kind = _char_kinds()[np.minimum(cp, 0x2FFF)]
    h = np.where(kind[begin] == 2, _NUMBER, h)
    heads = np.r_[0, np.cumsum(per_doc)].astype(np.int64)
    full = np.flatnonzero(np.diff(at))
    named = _named_words(h, at, begin, kind)
    named[named] = ~np.isin(h[named], common)
    names, cohesion = _cohesion(h, at, named, heads, origins)
    edges = np.full((n, 3), -1, np.int64)
    if len(full):
        one, two, end = h[at[full]], h[np.minimum(at[full] + 1, at[full + 1] - 1)], h[at[full + 1] - 1]
        for j, e in enumerate((mix(one + np.uint64(1)), mix(one * np.uint64(3) + mix(two + np.uint64(2))), mix(end + np.uint64(5)))):
            edges[full, j] = (e & np.uint64(BUCKETS - 1)).astype(np.int64)
    kind[starts[1:] - 1] = 12  # the line feeds between blocks
    block = np.repeat(np.arange(n), np.diff(starts))
    counts = np.bincount(block * 13 + kind, minlength=n * 13).reshape(n, 13)[:, :12].astype(np.float32)
    solid = (kind != 3) & (kind != 9) & (kind != 12)
    place = np.arange(len(cp))
    last = np.maximum.reduceat(np.where(solid, place, -1), starts[:-1]) if n else np.zeros(0, np.int64)
    first = np.minimum.reduceat(np.where(solid, place, len(cp)), starts[:-1]) if n else np.zeros(0, np.int64)
    blank = last < 0
    last_kind = np.where(blank, 12, kind[np.maximum(last, 0)])
    before = np.where(blank, 12, kind[np.maximum(last - 1, 0)])
    first_kind = np.where(blank, 12, kind[np.minimum(first, max(len(cp) - 1, 0))])
    n_words = np.diff(at).astype(np.float32)
    n_chars = np.diff(starts).astype(np.float32) - 1
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    place_in = runs(per_doc).astype(np.float32)
    size = np.repeat(per_doc, per_doc).astype(np.float32)
    cols = [
        np.log1p(n_chars) / 4, np.log1p(n_words) / 3, counts[:, 0] / letters, counts[:, 2] / np.maximum(n_chars, 1), np.log1p(counts[:, 5]),
        np.log1p(counts[:, 9]), np.log1p(counts[:, 4]), np.log1p(counts[:, 6]), counts[:, 8] > 0, counts[:, 10] > 0, counts[:, 7] / np.maximum(n_words, 1),
        (last_kind == 4) | ((last_kind == 7) & (before == 4)), last_kind <= 1, last_kind == 2, last_kind == 5, first_kind == 0, first_kind == 1, first_kind == 2, first_kind > 3,
        np.log1p(names) / 2, cohesion, (cohesion >= 0.5) & (names >= 2) & (counts[:, 4] >= 2),
        np.minimum(letters / np.maximum(n_words, 1), 12) / 6, counts[:, 4] / np.maximum(n_words, 1) * 5, place_in == 0, place_in == size - 1, place_in / np.maximum(size - 1, 1), np.log1p(size) / 3,
    ]
    return h, at, np.stack(cols, 1).astype(np.float32), heads, edges


N_SHAPE = 28
#: Columns of the shape that weak labels look at.
_ENDS_SENTENCE, _NAMES, _COHESION, _SENTENCES = 11, 19, 20, 6


def pooled(emb: np.ndarray, x: Blocks) -> np.ndarray:
    """Mean embedding of each block's hashed words, next to that of its edges."""
    n = len(x)
    total = np.zeros((n, emb.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(x.at))
    if len(full):
        total[full] = np.add.reduceat(emb.take((x.h & np.uint64(BUCKETS - 1)).astype(np.int64), axis=0), x.at[full], axis=0)
    edge = (emb.take(np.maximum(x.edges, 0), axis=0) * (x.edges >= 0)[:, :, None]).sum(1)
    return np.concatenate([total / np.maximum(np.diff(x.at), 1)[:, None].astype(np.float32), edge / 3], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _layout(heads: np.ndarray, cells: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of documents of like length: (index of each cell's block or -1, shaped documents x steps; documents)."""
    sizes = np.diff(heads)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    b = len(order)
    while b:
        longest = sizes[order[b - 1]]
        a = max(0, b - max(1, cells // longest))
        docs = order[a:b]
        steps = np.arange(longest)
        grid = np.where(steps[None, :] < sizes[docs][:, None], heads[docs][:, None] + steps[None, :], -1)
        yield grid, docs
        b = a


def _lstm(x: np.ndarray, u: np.ndarray, live: np.ndarray, keep: bool = False):
    """x: (docs, steps, 4H) already projected. Hidden states (docs, steps, H); padding keeps a zero state."""
    n, steps, k = x.shape
    hid = k // 4
    h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    out = np.zeros((n, steps, hid), np.float32)
    tape = []
    for t in range(steps):
        z = x[:, t] + h @ u
        s = _sigmoid(z[:, : 3 * hid])
        i, f, o, g = s[:, :hid], s[:, hid : 2 * hid], s[:, 2 * hid :], np.tanh(z[:, 3 * hid :])
        m = live[:, t, None]
        c_new = (f * c + i * g) * m
        tc = np.tanh(c_new)
        h_new = o * tc * m
        if keep:
            tape.append((i, f, o, g, c, tc, h))
        h, c = h_new, c_new
        out[:, t] = h
    return out, tape


def _lstm_back(d: np.ndarray, tape: list, u: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients for the projected inputs and for u."""
    n, steps, hid = d.shape
    dx, du = np.zeros((n, steps, 4 * hid), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, tc, h = tape[t]
        m = live[:, t, None]
        dh = (dh + d[:, t]) * m
        dc = (dc + dh * o * (1 - tc**2)) * m
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
        dx[:, t] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dx, du


class Labeller:
    """The network: embeddings, two LSTMs and an output layer."""

    def __init__(self, common: np.ndarray, seed: int = 7):
        self.common = common
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        n_in = 2 * DIM + N_SHAPE
        self.p = {"emb": r(BUCKETS, DIM), "b": np.zeros(1, np.float32), "w": r(2 * HIDDEN + n_in, 1)}
        for side in "fb":
            self.p |= {f"w{side}": r(n_in, 4 * HIDDEN), f"u{side}": r(HIDDEN, 4 * HIDDEN), f"b{side}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{side}"][HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, grid: np.ndarray, keep: bool = False):
        live = (grid >= 0).astype(np.float32)
        cells = x.take(np.maximum(grid, 0), axis=0) * live[:, :, None]
        fw, tf = _lstm(cells @ self.p["wf"] + self.p["bf"], self.p["uf"], live, keep)
        bw, tb = _lstm((cells @ self.p["wb"] + self.p["bb"])[:, ::-1], self.p["ub"], live[:, ::-1], keep)
        top = np.concatenate([fw, bw[:, ::-1], cells], 2)
        return _sigmoid((top @ self.p["w"])[:, :, 0] + self.p["b"]), (live, cells, tf, tb, top)

    def predict(self, texts: list[str], per_doc: np.ndarray, origins: list[str], tags: list[str] | None = None) -> np.ndarray:
        """Chance of each block to be furniture."""
        return self.predict_features(Blocks(texts, per_doc, origins, self.common, tags))

    def predict_features(self, blocks: Blocks) -> np.ndarray:
        x = np.concatenate([pooled(self.p["emb"], blocks), blocks.shape], 1)
        out = np.zeros(len(x), np.float32)
        for grid, _ in _layout(blocks.heads):
            p, _ = self.forward(x, grid)
            out[grid[grid >= 0]] = p[grid >= 0]
        return out

    def train(self, data: Blocks, n_docs: int, target: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.01, docs_a_step: int = 48) -> None:
        """Adam on the weighted log loss of the first n_docs documents; blocks of weight 0 are context only."""
        h, at, shape, heads, edges = data.h, data.at, data.shape, data.heads[: n_docs + 1], data.edges
        rng = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        lengths = np.diff(at)
        sizes = np.diff(heads)
        docs = np.flatnonzero(sizes)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(docs)
            for a in range(0, len(order), docs_a_step):
                ds = order[a : a + docs_a_step]
                blocks = np.concatenate([np.arange(heads[i], heads[i + 1]) for i in ds])
                local = np.r_[0, np.cumsum(sizes[ds])]
                ws = np.repeat(at[blocks], lengths[blocks]) + runs(lengths[blocks])
                keep = rng.random(len(ws)) < 0.9  # words drop out at random
                owner = np.repeat(np.arange(len(blocks)), lengths[blocks])
                scale = 1 / np.maximum(lengths[blocks], 1).astype(np.float32)
                pool = np.zeros((len(blocks), DIM), np.float32)
                full = np.flatnonzero(lengths[blocks])
                if len(full):
                    vec = self.p["emb"].take(bucket[ws], axis=0) * keep[:, None]
                    pool[full] = np.add.reduceat(vec, np.searchsorted(owner, full), axis=0)
                e = edges[blocks]
                has = ((e >= 0) & (rng.random((len(blocks), 1)) < 0.85))[:, :, None]
                edge = (self.p["emb"].take(np.maximum(e, 0), axis=0) * has).sum(1) / 3
                x = np.concatenate([pool * scale[:, None], edge, shape[blocks]], 1).astype(np.float32)
                grads = {k: np.zeros_like(v) for k, v in self.p.items() if k != "emb"}
                dx_all = np.zeros_like(x)
                wsum = max(weight[blocks].sum(), 1e-6)
                for grid, _ in _layout(local):
                    p, (live, cells, tf, tb, top) = self.forward(x, grid, True)
                    g = np.maximum(grid, 0)
                    dz = ((p - target[blocks][g]) * weight[blocks][g] * live / wsum).astype(np.float32)[:, :, None]
                    grads["w"] += top.reshape(-1, top.shape[2]).T @ dz.reshape(-1, 1)
                    grads["b"] += dz.sum()
                    dtop = dz @ self.p["w"].T
                    dcells = dtop[:, :, 2 * HIDDEN :].copy()
                    for side, part, tape, rev in (("f", dtop[:, :, :HIDDEN], tf, False), ("b", dtop[:, ::-1, HIDDEN : 2 * HIDDEN], tb, True)):
                        dxp, du = _lstm_back(part, tape, self.p[f"u{side}"], live[:, ::-1] if rev else live)
                        dxp = dxp[:, ::-1] if rev else dxp
                        grads[f"u{side}"] += du
                        grads[f"b{side}"] += dxp.sum((0, 1))
                        grads[f"w{side}"] += cells.reshape(-1, cells.shape[2]).T @ dxp.reshape(-1, dxp.shape[2])
                        dcells += dxp @ self.p[f"w{side}"].T
                    dx_all[grid[grid >= 0]] = dcells[grid >= 0]
                step += 1
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                de = (dx_all[:, :DIM] * scale[:, None])[owner[keep]]
                dedge = (dx_all[:, None, DIM : 2 * DIM] * has / 3).reshape(-1, DIM)
                rows, inv = np.unique(np.r_[bucket[ws[keep]], np.maximum(e, 0).ravel()], return_inverse=True)
                ge = np.zeros((len(rows), DIM), np.float32)
                np.add.at(ge, inv, np.concatenate([de, dedge]))
                for k, gr, at_rows in [*((k, v, slice(None)) for k, v in grads.items()), ("emb", ge, rows)]:
                    norm = np.sqrt((gr**2).sum())
                    gr = gr * min(1.0, 5 / max(norm, 1e-9))
                    first[k][at_rows] = 0.9 * first[k][at_rows] + 0.1 * gr
                    second[k][at_rows] = 0.999 * second[k][at_rows] + 0.001 * gr**2
                    self.p[k][at_rows] -= rate * fix * first[k][at_rows] / (np.sqrt(second[k][at_rows]) + 1e-7)


def _trigrams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of three consecutive words within blocks, and their block."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    if len(h) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[2:])))
    ok = owner[:-2] == owner[2:]
    return g[ok], owner[:-2][ok]


def weak_labels(x: Blocks, doc_of: np.ndarray, n_pages: int, listed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(label, weight) of the blocks of pages (doc_of < n_pages) and clean texts.

    Furniture: blocks that are `listed` as repeated on their site, the same words in five pages or more, or wording frequent on pages and unknown to clean texts at
    the block's start or in much of it. Body: clean texts, and whole sentences about the names that the rest of
    the page is about; these win over wording, as prose may talk of cookies or rights.
    """
    h, at, shape = x.h, x.at, x.shape
    n = len(at) - 1
    clean = doc_of >= n_pages
    target, weight = np.zeros(n, np.float32), clean.astype(np.float32)
    g, b = _trigrams(h, at)

    def page_only(gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
        pairs = np.unique(np.stack([gram, doc.astype(np.uint64)], 1), axis=0)
        is_clean = pairs[:, 1] >= n_pages
        vocab, inv = np.unique(pairs[:, 0], return_inverse=True)
        on_pages, on_clean = (np.bincount(inv[m], minlength=len(vocab)) for m in (~is_clean, is_clean))
        return ((on_pages >= 5) & (on_clean == 0))[np.searchsorted(vocab, gram)] if len(gram) else np.zeros(0, bool)

    marked = page_only(g, doc_of[b])
    share = np.bincount(b, marked, minlength=n) / np.maximum(np.bincount(b, minlength=n), 1)
    full = np.flatnonzero(np.diff(at))
    leads = np.zeros(n, bool)
    two = h[at[full]] * np.uint64(3) + mix(h[np.minimum(at[full] + 1, at[full + 1] - 1)])
    leads[full] = page_only(two, doc_of[full])
    bag = np.zeros(n, np.uint64)
    spelled = np.where(h == _NUMBER, np.uint64(0), mix(h * np.uint64(7) + runs(np.diff(at)).astype(np.uint64)))
    bag[full] = np.bitwise_xor.reduceat(spelled, at[full]) if len(full) else 0
    ids = np.unique(np.stack([bag, doc_of.astype(np.uint64)], 1)[~clean], axis=0)
    lines, docs = np.unique(ids[:, 0], return_counts=True)
    repeated = np.zeros(n, bool)
    if len(lines):
        repeated[~clean] = docs[np.searchsorted(lines, bag[~clean])] >= 5
    if listed is not None:
        repeated |= listed
    known = np.isin(bag, bag[clean])
    prose = (shape[:, _ENDS_SENTENCE] > 0) & (shape[:, _COHESION] >= 0.5) & (shape[:, _NAMES] >= np.log(3) / 2) & (np.diff(at) >= 8)
    body = ~clean & (known | prose & ((shape[:, _SENTENCES] >= np.log(3)) | ~(repeated | leads | (share >= 0.3))))
    wording = leads | (share >= 0.3)
    open_ = ~clean & ~body & ~repeated & wording & (shape[:, _ENDS_SENTENCE] > 0) & (shape[:, _COHESION] > 0) & (shape[:, _SENTENCES] >= np.log(3))
    furniture = ~clean & ~body & ~open_ & (repeated | wording)
    target[furniture], weight[furniture], weight[body] = 1, 1, 1
    weight[body & wording] = 2  # the rare and telling cases
    # a logistic model over words and shape spreads the labels
    bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))
    inv_len = 1 / np.sqrt(np.maximum(np.diff(at), 1))
    w, v, c = np.zeros(BUCKETS), np.zeros(N_SHAPE), 0.0
    local = shape.copy()
    local[:, [_COHESION, _COHESION + 1, *range(N_SHAPE - 4, N_SHAPE)]] = 0  # place on the page says nothing about clean texts
    gw, gv = np.full(BUCKETS, 1e-3), np.full(N_SHAPE, 1e-3)
    class_weight = weight * np.where(target > 0, 1 / max(1, (weight * target).sum()), 1 / max(1, (weight * (1 - target)).sum()))
    for _ in range(80):
        p = _sigmoid(np.bincount(owner, w[bucket], minlength=n) * inv_len + local @ v + c)
        d = (p - target) * class_weight
        dw = np.bincount(bucket, (d * inv_len)[owner], minlength=BUCKETS) + 1e-6 * w
        dv = local.T @ d + 1e-5 * v
        gw, gv = 0.9 * gw + 0.1 * dw**2, 0.9 * gv + 0.1 * dv**2
        w -= 0.05 * dw / np.sqrt(gw + 1e-12)
        v -= 0.05 * dv / np.sqrt(gv + 1e-12)
        c -= 0.5 * d.sum()
    p = _sigmoid(np.bincount(owner, w[bucket], minlength=n) * inv_len + local @ v + c)
    sure = (weight == 0) & ~open_ & ((p > 0.95) | (p < 0.05))
    target[sure], weight[sure] = (p[sure] > 0.5), 0.5
    return target, weight


def fit(pages: list[list[str]], origins: list[str], clean: list[str], listed: list[list[bool]] | None = None, tags: list[list[str]] | None = None, epochs: int = 6) -> Labeller:
    """Train on the blocks of sampled pages and the paragraphs of clean texts; `listed` says which blocks repeat on their site."""
    docs = [[x or "" for x in p or []] for p in pages] + [[x for x in (t or "").split("\n") if x.strip()] for t in clean]
    per_doc = np.array([len(d) for d in docs], np.int64)
    flat = [b for d in docs for b in d]
    common = common_names(flat, per_doc)
    rest = int(per_doc[len(pages) :].sum())
    x = Blocks(flat, per_doc, [*origins, *[""] * len(clean)], common, [*(t for p in tags for t in p), *[""] * rest] if tags else None)
    flags = np.array([*(f for p in listed for f in p), *[False] * rest], bool) if listed else None
    target, weight = weak_labels(x, np.repeat(np.arange(len(docs)), per_doc), len(pages), flags)
    model = Labeller(common)
    model.train(x, len(pages), target, weight, epochs)  # clean texts have no furniture around them: only pages teach context
    return model


def train_labeller(articles: DataFrame, clean: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_clean: int = SAMPLE_CLEAN) -> Labeller:
    """Fit on at most sample_pages articles and sample_clean clean documents, drawn by hash of their ids.

    Which lines of the sampled pages repeat on their site is counted over all articles.
    """
    tagged = "tag_path" in articles.columns
    paths = F.transform("paragraph", lambda _, i: F.coalesce(F.get("tag_path", i), F.lit(""))) if tagged else F.lit(None).cast("array<string>")
    art = articles.select("url_id", "origin", "paragraph", paths.alias("tag_path")).filter("paragraph is not null")
    share = lambda df, key, n: df.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < _cut(df, n)).orderBy(F.xxhash64(key), key).limit(n)
    sample = written(share(art, "url_id", sample_pages).withColumn("lines", F.transform("paragraph", line_key)), "pages")
    wanted = sample.select(F.col("origin").alias("source"), F.explode("lines").alias("line")).filter("line is not null and source is not null").distinct()
    met = line_rows(articles, "origin", "url_id", "paragraph").join(F.broadcast(wanted), ["source", "line"], "left_semi")  # the lines of at most sample_pages pages
    often = met.select("source", "line", "doc").distinct().groupBy("source", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SUPPORT)
    known = often.groupBy(F.col("source").alias("origin")).agg(F.collect_set("line").alias("often"))  # bounded by the sample's lines
    listed = F.transform("lines", lambda x: F.coalesce(F.array_contains("often", x), F.lit(False)))
    pages = sample.join(known, "origin", "left").select("paragraph", "origin", "tag_path", listed.alias("listed"), "url_id").collect()
    pages = sorted(pages, key=lambda r: (r["url_id"] or "", r["paragraph"] and str(r["paragraph"])))
    texts = sorted(r[0] for r in share(clean.select("doc_id", "text").filter("text is not null"), "doc_id", sample_clean).select("text").collect())
    return fit([r["paragraph"] for r in pages], [r["origin"] or "" for r in pages], texts, [r["listed"] for r in pages], [r["tag_path"] for r in pages] if tagged else None)


def _cut(df: DataFrame, n: int) -> int:
    """Hash share that keeps about twice n rows, so that the sort sees a bounded number."""
    return (1 << 20) if (total := df.count()) <= 2 * n else int((1 << 20) * 2 * n / total)


def page_columns(articles: DataFrame, *more: str) -> DataFrame:
    """What page_pieces() reads, and more columns."""
    return articles.select("url_id", "origin", "paragraph", *(["tag_path"] if "tag_path" in articles.columns else []), *more)


def page_pieces(net: Labeller, batch: pa.RecordBatch, room: int = 0) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, end, blocks, blocks per page, chance of each block to be furniture) in pieces of bounded size; `room` is added to a page's size."""
    lists = batch.column("paragraph")
    per_doc = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    heads = np.r_[0, np.cumsum(per_doc)]
    chars = np.r_[0, np.cumsum(pc.utf8_length(flat).fill_null(0).to_numpy(zero_copy_only=False))]
    paths = batch.column("tag_path").to_pylist() if "tag_path" in batch.schema.names else None
    for a, b in batches(len(per_doc), np.diff(chars[heads]) + room, 800_000):
        blocks = flat.slice(heads[a], heads[b] - heads[a])
        tags = [(*(p or ()), *[""] * n)[:n] for p, n in zip(paths[a:b], per_doc[a:b].tolist(), strict=True)] if paths else None
        yield a, b, blocks, per_doc[a:b], net.predict(blocks.to_pylist(), per_doc[a:b], batch.column("origin").slice(a, b - a).to_pylist(), [t for p in tags for t in p] if tags else None)


def _tagger(model):
    def tag(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, _, per_doc, p in page_pieces(model.value, batch):
                hit = p > 0.5
                doc, pos = np.repeat(np.arange(a, b), per_doc)[hit], runs(per_doc)[hit]
                if len(doc):
                    yield pa.RecordBatch.from_arrays([batch.column("url_id").take(pa.array(doc)), pa.array(pos, pa.int32())], names=["url_id", "pos"])

    return tag


def furniture(articles: DataFrame, clean: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(url_id, pos) of every element of `paragraph` that is not the article's own body.

    Null arrays have no rows; null and blank elements are labelled by their place like any other; repeated rows
    give repeated results. Pages are read whole, however long.
    """
    spark = articles.sparkSession
    ship(spark)
    model = model or train_labeller(articles, clean)
    return page_columns(articles).mapInArrow(_tagger(spark.sparkContext.broadcast(model)), "url_id string, pos int")


def _keeper(model):
    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, blocks, per_doc, p in page_pieces(model.value, batch):
                own = p <= 0.5
                kept = np.r_[0, np.cumsum(own)][np.r_[0, np.cumsum(per_doc)]]
                yield pa.RecordBatch.from_arrays([batch.column("url_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(kept, pa.int32()), blocks.filter(pa.array(own)))], names=["url_id", "body"])

    return keep


def bodies(articles: DataFrame, clean: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(url_id, body): the elements of `paragraph` that are the article's own, in order, one row per row; null arrays have an empty body."""
    spark = articles.sparkSession
    ship(spark)
    model = model or train_labeller(articles, clean)
    return page_columns(articles).mapInArrow(_keeper(spark.sparkContext.broadcast(model)), "url_id string, body array<string>")
