"""Text cut off by field limits: a backward character n-gram model of where texts end.

For every position of all titles and descriptions the model counts, by the characters before it, whether the text (or,
in descriptions, its sentence) ends there or goes on. A value's final context is then looked up from the shortest to
the longest: each longer context refines the chance of an end by its own counts. Short contexts are counted everywhere,
so that a cut within a word stands out; long ones at ends of words. To the log-odds of going on against ending is added
how often values of this very length are cut at their site, which is where a field limit shows. The sum is compared
with a threshold per language and column, and that alone decides.

Some records show what follows - the words of the title in its URL, the sentence of the description in its body, a
closing mark. These settled values teach the model which final contexts are ends and set the thresholds (each is
judged without its own event); they have no other say. Counts are a distributed table by the contexts' 64-bit hashes,
to which each value's final contexts are joined, so that they are as exact at any size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstream.llm.languages import fit, train
from loomstream.llm.words import _powers, batches, codepoints, lowered, mix
from loomstream.session import salted_join, ship, written

LENGTHS = (3, 5, 7, 10, 14)
EVERYWHERE = 5  # contexts up to this length are counted at all positions
FIELDS = ("title", "description")
PRIOR = 4.0
_B, _BI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MARK = re.compile(r"\s*(?:…|\.\.\.)\s*$")
_ENDS = re.compile(r"[.!?][\"”’»)\]“]*\s*$")
_INITIAL = re.compile(r"(?:^|[^\w])\w\.$")
_SLUG = re.compile(r"/([^/?#]+?)(?:-[a-z]?[0-9a-f]*\d[0-9a-f]*)?/?(?:[?#].*)?$")
_STOPS, _CLOSING = [0x2E, 0x21, 0x3F], [ord(c) for c in "\"”’»)]“"]
#: Letters that don't fall apart into a base letter and a mark.
_FOLD = str.maketrans({"ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ı": "i"})


def slug(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().translate(_FOLD))
    return re.sub(r"[^a-z0-9]+", "-", "".join(c for c in text if not unicodedata.combining(c))).strip("-")


def title_goes_on(title: str, url: str | None) -> bool | None:
    """Whether the URL's words go on after the title; None when the URL doesn't tell."""
    m = _SLUG.search(url or "")
    mine = slug(_MARK.sub("", title))
    if not m or m[1].count("-") < 2 or len(mine) < 6:
        return None
    theirs = m[1].lower()
    if theirs.startswith(mine):
        rest = theirs[len(mine) :]
    else:
        tail = mine[-14:]
        at = theirs.rfind(tail)
        if at < 0:
            return None
        rest = theirs[at + len(tail) :]
    return len(rest.strip("-")) > 0


_SPACE = re.compile(r"\s+")


def description_goes_on(text: str, body: list[str] | None) -> bool | None:
    """Whether the body goes on within the sentence that the description ends in; None when it isn't there."""
    marked = bool(_MARK.search(text))
    tail = _MARK.sub("", text).rstrip()[-45:]
    if len(tail) < 20 or not body:
        return None
    for p in body:
        if not p:
            continue
        at = p.find(tail)
        if at < 0 and "  " in p:
            p = _SPACE.sub(" ", p)
            at = p.find(_SPACE.sub(" ", tail))
        if at >= 0:
            rest = p[at + len(tail) :]
            return True if marked else bool(rest[:1].strip()) and rest[0] not in ".!?…" if rest[:1].strip() else bool(rest.strip())
    return None


def observed(field: str, text: str, url: str | None, body: list[str] | None) -> bool | None:
    """True: cut; False: whole; None: the record doesn't tell."""
    if field == "description":
        whole = _ENDS.search(text) and not text.rstrip().endswith("...") and not _INITIAL.search(text)
        return False if whole else description_goes_on(text, body)
    return title_goes_on(text, url)


def _contexts(total: np.ndarray, pos: np.ndarray, start: np.ndarray, field: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the LENGTHS[k] characters before each position, which positions have that many)."""
    n = LENGTHS[k]
    ok = pos - n >= start
    a = np.where(ok, pos - n, 0)
    h = mix((total[pos] - total[a]) * _powers(1 << max(12, int(len(total)).bit_length()), _BI)[a] + np.uint64(field * 2 + 1))
    return mix(h + np.uint64(k)).view(np.int64), ok


def _prefix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cp, starts = codepoints(texts)
    cp = lowered(cp)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(cp.astype(np.uint64) * _powers(1 << max(12, int(len(cp) + 1).bit_length()), _B)[: len(cp)], out=total[1:])
    return cp, starts, total


@lru_cache(1)
def _letter() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x3000)])


def _summed(context: np.ndarray, e: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, at = np.unique(context, return_inverse=True)
    return own, np.bincount(at, e, len(own)).astype(np.int64), np.bincount(at, g, len(own)).astype(np.int64)


def count_events(texts: list[str], field: int, outcome: list[bool | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, ends, goes) of the events of some values; `outcome` as of observed()."""
    cp, starts, total = _prefix(texts)
    n = np.diff(starts) - 1
    text_of = np.repeat(np.arange(len(texts)), n)
    pos = np.arange(len(text_of)) + text_of + 1  # after each character, the text's last included
    last = pos == starts[1:][text_of] - 1
    nxt = cp[np.minimum(pos, len(cp) - 1)]
    letter = _letter()[np.minimum(nxt, 0x2FFF)]
    state = np.array([2 if o is None else int(o) for o in outcome])[text_of]
    if field:  # a sentence's end is an end, before its closing mark and after it; the point of an initial is none
        at = lambda k: cp[np.clip(pos + k, 0, len(cp) - 1)]
        known = lambda c: _letter()[np.minimum(c, 0x2FFF)]
        quoted = np.isin(at(-1), _CLOSING)
        mark = np.where(quoted, at(-2), at(-1))
        initial = ~quoted & (at(-1) == 0x2E) & known(at(-2)) & ~known(at(-3))
        stop = np.isin(nxt, _STOPS) & ~known(at(1)) | np.isin(mark, _STOPS) & ~letter & ~initial
        is_end = stop & ~last | (last & (state == 0))
    else:
        is_end = last & (state == 0)
    skip = last & (state == 2)  # what isn't settled teaches nothing about ends
    parts = []
    for k, length in enumerate(LENGTHS):
        use = ~skip if length <= EVERYWHERE else ~skip & (~letter | last)
        p = pos[use]
        context, ok = _contexts(total, p, starts[text_of[use]], field, k)
        e = is_end[use][ok]
        parts.append(_summed(context[ok], e, ~e))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def final_contexts(texts: list[str], field: int) -> list[list[int | None]]:
    """The contexts at the end of each value, one of each length; null where it is shorter."""
    _, starts, total = _prefix(texts)
    each = [_contexts(total, starts[1:] - 1, starts[:-1], field, k) for k in range(len(LENGTHS))]
    return [[c if o else None for c, o in zip(cs, oks, strict=True)] for cs, oks in zip(np.stack([x[0] for x in each], 1).tolist(), np.stack([x[1] for x in each], 1).tolist(), strict=True)]


def log_odds(values: DataFrame, counts: DataFrame) -> DataFrame:
    """(rid, score) of values (rid, seen, contexts): log-odds that each goes on after its last character rather than ends there.

    A settled value's own event is left out of the counts (context, e, g) it is judged by.
    """
    looked = values.select("rid", F.posexplode("contexts").alias("k", "context")).filter("context is not null")
    wanted = counts.join(looked.select("context").distinct(), "context", "left_semi")
    found = salted_join(looked, wanted, ["context"])
    sums = [F.sum(F.when(F.col("k") == k, F.col(x))).alias(f"{x}{k}") for k in range(len(LENGTHS)) for x in ("e", "g")]
    rows = values.select("rid", "seen").join(found.groupBy("rid").agg(*sums), "rid", "left").fillna(0, [f"{x}{k}" for k in range(len(LENGTHS)) for x in ("e", "g")])
    p = F.lit(0.02)
    for k in range(len(LENGTHS)):
        rows = rows.withColumn("p", p)
        e = F.greatest(F.col(f"e{k}") - F.coalesce((~F.col("seen")).cast("int"), F.lit(0)), F.lit(0))
        g = F.greatest(F.col(f"g{k}") - F.coalesce(F.col("seen").cast("int"), F.lit(0)), F.lit(0))
        p = (e + PRIOR * F.col("p")) / (e + g + PRIOR)
    rows = rows.withColumn("p", p).withColumn("p", F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)))
    return rows.select("rid", (F.log(1 - F.col("p")) - F.log("p")).alias("score"))


def _values(batch: pa.RecordBatch, a: int, b: int, field: int) -> tuple[np.ndarray, list[str], list[bool | None]]:
    part = batch.slice(a, b - a)
    text = part.column(FIELDS[field]).to_pylist()
    rows = [i for i, t in enumerate(text) if t and t.strip()]
    other = part.column("paragraph" if field else "url").to_pylist()
    stripped = [text[i].rstrip() for i in rows]
    out = [observed(FIELDS[field], t, None if field else other[i], other[i] if field else None) for i, t in zip(rows, stripped, strict=True)]
    return np.array(rows, np.int64) + a, stripped, out


def _pieces(batch: pa.RecordBatch):
    """Slices of bounded text: a row is its title, description, URL and paragraphs."""
    n = lambda c: pc.utf8_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column("paragraph")
    total = np.r_[0, np.cumsum(n(lists.flatten()))]
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    sizes = n(batch.column("title")) + n(batch.column("description")) + n(batch.column("url")) + np.diff(total[np.r_[0, ends]]) + 50
    return batches(batch.num_rows, sizes, 2_000_000)


def _events(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        parts = []
        for a, b in _pieces(batch):
            for field in (0, 1):
                _, texts, outcome = _values(batch, a, b, field)
                if texts:
                    parts.append(count_events(texts, field, outcome))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))], names=["context", "e", "g"])


_VALUES = "rid bigint, url_id string, origin string, site string, field string, lang string, size int, contexts array<bigint>, seen boolean, marked boolean"


def _reader(model):
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33
        for batch in it:
            for a, b in _pieces(batch):
                part = batch.slice(a, b - a)
                both = [f"{t or ''} {d or ''}" for t, d in zip(part.column("title").to_pylist(), part.column("description").to_pylist(), strict=True)]
                lang = pa.array(model.value.named(both))
                for field in (0, 1):
                    rows, texts, outcome = _values(batch, a, b, field)
                    if not texts:
                        continue
                    at, n = pa.array(rows), len(texts)
                    cols = [
                        pa.array(rid + np.arange(n)), *(batch.column(c).take(at) for c in ("url_id", "origin", "site")), pa.array([FIELDS[field]] * n), lang.take(pa.array(rows - a)),
                        pa.array([len(t) for t in texts], pa.int32()), pa.array(final_contexts(texts, field), pa.list_(pa.int64())), pa.array(outcome, pa.bool_()), pa.array([bool(_MARK.search(t)) for t in texts]),
                    ]
                    rid += n
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _VALUES.split(", ")])

    return read


def _thresholds(bins: pd.DataFrame) -> dict[tuple[str, str, bool], float]:
    """Per column, language and mark: the score from which most settled values are cut (best F1), else the column's.

    Fewer than 20 settled values of either kind take the threshold of all languages.
    """
    out: dict[tuple[str, str, bool], float] = {}

    def best(x: pd.DataFrame) -> float:
        x = x.groupby("bin")[["cut", "whole"]].sum().sort_index(ascending=False).cumsum()
        missed = x["cut"].iloc[-1] - x["cut"]
        f1 = 2 * x["cut"] / (2 * x["cut"] + missed + x["whole"]).clip(lower=1)
        return float(f1.idxmax()) / 4

    for (field, marked), part in bins.groupby(["field", "marked"]):
        total = best(part) if part["cut"].sum() >= 20 and part["whole"].sum() >= 20 else (0.0 if not marked else -2.0)
        out[field, "", marked] = total
        for lang, own in part.groupby("lang"):
            if own["cut"].sum() >= 20 and own["whole"].sum() >= 20:
                out[field, lang, marked] = best(own)
    return out


def judged_values(articles: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(url_id, origin, field, lang, score, seen, marked, cut) of every non-blank title and description; `seen` is what settles a value, if anything.

    `docs` (doc_id, text, lang) train the language model; without them there is one threshold per column. The site of a
    record is the host of its URL, else its origin. One row per value and delivery of the record. Null and blank values
    have none; very long values are counted whole.
    """
    spark = articles.sparkSession
    ship(spark)
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^(www|m)\.", "")
    cols = articles.select("url_id", "origin", "url", F.coalesce(host, "origin", F.lit("")).alias("site"), "title", "description", "paragraph")
    model = spark.sparkContext.broadcast(train(docs) if docs is not None else fit([], []))
    counts = cols.mapInArrow(_events, "context bigint, e bigint, g bigint").groupBy("context").agg(F.sum("e").alias("e"), F.sum("g").alias("g"))
    values = written(cols.mapInArrow(_reader(model), _VALUES), "values")
    scored = written(values.drop("contexts").join(log_odds(values, counts), "rid").drop("rid"), "scores")
    settled = scored.filter("seen is not null")
    kinds = [F.count_if("seen").alias("cut_n"), F.count_if(~F.col("seen")).alias("whole_n")]
    rate = {r["field"]: (r["cut_n"] + 1) / (r["whole_n"] + 1) for r in settled.groupBy("field").agg(*kinds).collect()}
    sizes = settled.groupBy("site", "field", "size").agg(*kinds)
    scored = salted_join(scored, sizes, ["site", "field", "size"], "left").fillna(0, ["cut_n", "whole_n"])
    c = F.col("cut_n") - F.coalesce(F.col("seen").cast("int"), F.lit(0))
    w = F.col("whole_n") - F.coalesce((~F.col("seen")).cast("int"), F.lit(0))
    odds = F.when(F.col("field") == "title", F.lit(rate.get("title", 1.0))).otherwise(F.lit(rate.get("description", 1.0)))
    at_limit = F.log((F.greatest(c, F.lit(0)) + 2 * odds / (1 + odds)) / (F.greatest(w, F.lit(0)) + 2 / (1 + odds))) - F.log(odds)
    scored = written(scored.withColumn("score", F.col("score") + at_limit).drop("site", "cut_n", "whole_n"), "judged")
    settled = scored.filter("seen is not null").groupBy("field", "lang", "marked", F.floor(F.col("score") * 4).alias("bin"))
    bins = settled.agg(F.count_if("seen").alias("cut"), F.count_if(~F.col("seen")).alias("whole")).toPandas()
    cut = F.lit(False)
    limits = _thresholds(bins)
    for field in FIELDS:
        for marked in (False, True):
            base = limits.get((field, "", marked), 0.0 if not marked else -2.0)
            limit = F.lit(base)
            for (f, lang, m), t in limits.items():
                if (f, m) == (field, marked) and lang:
                    limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
            cut = F.when((F.col("field") == field) & (F.col("marked") == marked), F.col("score") >= limit).otherwise(cut)
    return scored.withColumn("cut", cut)


def cut_values(articles: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(url_id, field) of the values that were cut off, one row each."""
    return judged_values(articles, docs).filter("cut").select("url_id", "field").distinct()


def cut_rates(articles: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(origin, field, n_values, n_cut, cut_share) over records; the null origin has its own rows."""
    per = judged_values(articles, docs).groupBy("url_id", "origin", "field").agg(F.max("cut").alias("cut"))
    out = per.groupBy("origin", "field").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"))
    return out.withColumn("cut_share", F.col("n_cut") / F.col("n_values"))
