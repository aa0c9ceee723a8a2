"""Text decoded with the wrong encoding: find it, and undo it by round trips.

A garbled stretch is encoded again in a candidate legacy encoding and strictly decoded as the intended one;
the result is kept when the garbling cost of the value drops, and the step is repeated for nested layers. The
cost counts what does not occur in well-decoded prose of Latin script: replacement and control characters,
signs and foreign letters inside words, capitals with accents in the middle of lower-case words, lead letters
without their follower.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from loomstream.llm.words import batches, runs
from loomstream.session import ship

#: Encodings a UTF-8 text may have been read in; w1252 is the web's reading of cp1252, C1 bytes included.
LEGACY = ("w1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_15", "koi8_r")
#: (read in, meant) pairs of two single-byte encodings.
SINGLE = (("mac_roman", "w1252"), ("w1252", "mac_roman"), ("cp437", "w1252"), ("cp850", "w1252"), ("w1252", "cp850"), ("cp1251", "w1252"), ("cp1250", "w1252"))
LAYERS = 4


@lru_cache(None)
def table(name: str) -> dict[str, int]:
    """Character to byte, 0x80 to 0xFF."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        if name == "w1252":
            out.setdefault(chr(b), b)
            try:
                out[bytes([b]).decode("cp1252")] = b
            except UnicodeDecodeError:
                pass
        else:
            try:
                out[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                pass
    return out


@lru_cache(None)
def _utf8_pattern(name: str) -> re.Pattern:
    """Sequences of characters whose bytes in `name` look like UTF-8."""
    t = table(name)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in t.items() if lo <= b <= hi) + "]"
    follow = cls(0x80, 0xBF)
    space = "|(?<=(?<![A-Z])" + cls(0xC3, 0xC3) + ") " if " " in t else ""
    return re.compile(f"(?:{cls(0xC2, 0xDF)}(?:{follow}{space})|{cls(0xE0, 0xEF)}{follow}{{2}}|{cls(0xF0, 0xF4)}{follow}{{3}})+")


def _undo_utf8(text: str, name: str) -> str:
    t = table(name)

    def back(m: re.Match) -> str:
        try:
            return bytes(t.get(c, 0xA0) for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _utf8_pattern(name).sub(back, text)


@lru_cache(None)
def _single_map(read: str, meant: str) -> dict[int, str]:
    back = {b: c for c, b in table(meant).items() if c > "\x9f"}
    return {ord(c): back[b] for c, b in table(read).items() if b in back}


_WORD = re.compile(r"\S*[^\x00-\x7f]\S*")


@lru_cache(None)
def _class(c: str) -> str:
    """l, u: Latin letters; d; s: spaces; q: typographic signs usual in prose; x: what prose hardly has; -: other."""
    o, cat = ord(c), unicodedata.category(c)
    if o < 128:
        return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" if c.isspace() else "p"
    if c in "–—‘’“”„‚…«»‹›·•€£©®°™¿¡­":
        return "q"
    if cat[0] == "Z" or c in "​﻿‎‏":
        return "s"
    if cat[0] == "L":
        if c in "ªºıƒˆ" or "LATIN" not in unicodedata.name(c, ""):
            return "f"
        return "l" if c.islower() else "u"
    if cat[0] == "M":
        return "l"
    if cat in ("Cc", "Co", "Cn") or c == "�" or 0x2500 <= o < 0x25A0:
        return "x"
    return "y"


def cost(text: str) -> float:
    """How garbled a text looks; 0 for clean prose of Latin script."""
    out, n = 0.0, len(text)
    for m in _NON_ASCII.finditer(text):
        i = m.start()
        c, k = text[i], _class(text[i])
        p = _class(text[i - 1]) if i else "s"
        q = _class(text[i + 1]) if i + 1 < n else "s"
        if k == "x":
            out += 3
        elif k == "f":
            out += 0 if c in "ªº" and p == "d" else 2 if p in "lufqyx" or q in "lufqyx" else 0
        elif k == "y":
            out += 2 if p in "lufyxq" or q in "lufyxqd" else 0.5
        elif k == "q":
            if c in "€£©®°™·•…«»‹›„‚—–“”‘":
                if p in "l" and q in "l" and c not in "…—–":
                    out += 1.5
                elif p == "s" and q == "l" and c in "…—–»”“„‚" and c not in "“„‚":
                    out += 1.5
                elif c == "«" and q == "l" and p in "sp" and i + 2 < n and text[i + 2] != " ":
                    out += 0.8
                elif c in "€£" and (p in "l" and q != "s" or q in "lu"):
                    out += 1.5
                elif c in "©®°™" and (q in "lufyx" or p in "uq"):
                    out += 1.5
            if c in "’‘“”„‚…–—" and p in "uf" and text[i - 1 : i] > "\x7f":
                out += 1.0
        elif k == "u":
            if c in "ÃÐ" and (q not in "u" or text[i + 1 : i + 2] > "\x7f"):
                out += 0 if p == "u" and q in "sp" else 2
            elif c in "ÂÅÄÎÏ" and q in "qyxf":
                out += 2
            elif p == "l" and text[i - 1 : i].isalpha():
                out += 1.5
            elif p == "u" and q == "u" and i and text[i - 1] > "\x7f" and text[i + 1] > "\x7f":
                out += 1
        elif k == "l" and c in "âãäåðïîëѓ" and q in "qyxf":
            out += 1.5 if text[i + 1] not in "’”“…–—»:·" else (1.5 if i + 2 < n and _class(text[i + 2]) in "qyxf" and text[i + 1] in "’”“…–—" and c == "â" else 0)
    return out


_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def repair(text: str, layers: int = LAYERS) -> tuple[str, float, float]:
    """(repaired text, cost before, cost after)."""
    before = now = cost(text)
    for _ in range(layers):
        if now == 0:
            break
        tries = []
        for name in LEGACY:
            t = _undo_utf8(text, name)
            if t != text:
                tries.append(t)
                if cost(t) == 0:
                    return t, before, 0.0
        if not tries:
            for read, meant in SINGLE:
                m = _single_map(read, meant)
                tries.append(_WORD.sub(lambda w, m=m: _best(w[0], m), text))
        best, score = text, now
        for t in tries:
            if t != text and (c := cost(t)) < score - 0.4:
                best, score = t, c
        if best == text:
            break
        text, now = best, score
    return text, before, now


def _best(word: str, m: dict[int, str]) -> str:
    new = word.translate(m)
    return new if cost(f" {new} ") < cost(f" {word} ") else word


ACCEPT = 1.5


def garbled(texts: list[str]) -> list[tuple[int, str, float, float]]:
    """(index, restored text, cost before, cost after) of the texts that were wrongly decoded.

    A text counts when its cost is at least ACCEPT; what can't be restored is returned as it is.
    """
    out = []
    for i, text in enumerate(texts):
        if text and not text.isascii() and cost(text) >= ACCEPT:
            fixed, before, after = repair(text)
            if after < before or before >= 2:
                out.append((i, fixed, before, after))
    return out


_OUT = "url_id string, field string, pos int, restored string, cost_before double, cost_after double, lost boolean"


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        lists = batch.column("paragraph")
        n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        every = np.arange(batch.num_rows)
        for field, texts, owner, pos in (("title", batch.column("title"), every, np.zeros(len(every), np.int64)), ("paragraph", lists.flatten(), np.repeat(every, n), runs(n))):
            odd = np.flatnonzero(~pc.string_is_ascii(texts).fill_null(True).to_numpy(zero_copy_only=False))  # only these can be garbled
            texts = texts.take(pa.array(odd))
            for a, b in batches(len(odd), pc.utf8_length(texts).to_numpy(zero_copy_only=False)):
                found = garbled(texts.slice(a, b - a).to_pylist())
                if found:
                    at = odd[a + np.array([i for i, *_ in found])]
                    before, after = (np.array([x[k] for x in found], float) for k in (2, 3))
                    cols = [batch.column("url_id").take(pa.array(owner[at])), pa.array([field] * len(at)), pa.array(pos[at], pa.int32()), pa.array([x[1] for x in found]), pa.array(before), pa.array(after), pa.array(after >= before)]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _OUT.split(", ")])


def garbled_values(df: DataFrame) -> DataFrame:
    """(url_id, field, pos, restored, cost_before, cost_after, lost) of title and paragraph values wrongly decoded.

    `lost` marks values that no round trip makes better: their cost alone tells, and `restored` is as it was. One row per
    value and delivery of the record; nulls and empty texts are clean; order and repeats of rows
    don't matter; no shuffle.
    """
    ship(df.sparkSession)
    return df.select("url_id", "title", "paragraph").mapInArrow(_scan, _OUT)
