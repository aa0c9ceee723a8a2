"""Ranked streams: candidates, score times time, duplicates out, diversified - for all users at once.

Order-dependent passes run per stream on at most `3 k` candidates, after window limits that Spark pushes below the
shuffle; each partition is read in order of streams, one stream's few rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.operators.aggregates import top_per_group
from loomstream.session import ship

HOUR = 3_600_000


def decay(age_hours: Column, free_hours: Column | float, half: float) -> Column:
    """1 / (1 + hours beyond the free ones / half)."""
    return 1 / (1 + F.greatest(F.lit(0.0), age_hours - free_hours) / half)


def main_decay(age_hours: Column, hours_away: Column, weekend: Column) -> Column:
    """Time since the last use is free, at most 18 hours (42 on a weekend)."""
    return decay(age_hours, F.least(F.when(weekend, 42.0).otherwise(18.0), hours_away), 24.0)


def latest_engagement(engagement: Column, site: str) -> Column:
    """The newest engagement struct of a site; the first of equally new ones."""
    mine = F.filter(engagement, lambda e: e["site"] == site)
    return F.aggregate(mine, F.lit(None).cast("struct<site:string,share_count:bigint,share_score:double,like_count:bigint,comment_count:bigint,create_time:bigint>"),
                       lambda a, e: F.when(a.isNull() | (a["create_time"] < e["create_time"]), e).otherwise(a))


def _each_stream(rows: DataFrame, work: Callable[[list[dict]], list[dict]], ddl: str) -> DataFrame:
    """work() on the rows of each stream, best score first; streams are bounded by the limits before."""
    ship(rows.sparkSession)
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=kinds)
            out.clear()
            return made

        for b in it:
            for r in b.to_pylist():
                if held and held[-1]["stream"] != r["stream"]:
                    out.extend(work(held))
                    held = []
                held.append(r)
            if len(out) > 5_000:
                yield batch()
        if held:
            out.extend(work(held))
        if out:
            yield batch()

    kinds = pa.schema([pa.field(x.split()[0], _ARROW[x.split()[1]]) for x in ddl.split(", ")])
    return rows.repartition("stream").sortWithinPartitions("stream", F.desc("score"), "url_id").mapInArrow(run, ddl)


_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}


def _dedupe(rows: list[dict], window: int, least: int) -> list[dict]:
    kept: list[dict] = []
    for r in rows:
        stems = set(r["stems"] or ())
        r |= {"_s": stems, "hot_count": 0, "oldest": r["time"]}
        for i, o in enumerate(kept):
            if abs(o["time"] - r["time"]) <= window and len(o["_s"] & stems) >= least:
                worth, other = r["share_score"], o["share_score"]
                if other is None or (worth is not None and worth > other):
                    r["hot_count"], r["oldest"] = 1, min(r["time"], o["time"])
                    kept[i] = r
                else:
                    o["hot_count"] += 1
                    o["oldest"] = min(o["oldest"], r["time"])
                break
        else:
            kept.append(r)
    for r in kept:
        r["hot_count"] += 1 if r["hot_count"] else 0
    return kept


def dedupe_streams(rows: DataFrame, window: int = 30 * HOUR, least: int = 2) -> DataFrame:
    """Rows (stream, url_id, score, time, stems, share_score): each joins the first kept row of its stream that shares
    `least` stems within the window; of the two the one of higher share score stays (the newcomer when the kept one
    has none). hot_count is how many rows a row stands for (0 for one), oldest the earliest time among them.
    """
    cols = ["stream", "url_id", "score", "time", "share_score", "stems"]
    return _each_stream(rows.select(*cols), lambda x: _dedupe(x, window, least), "stream string, url_id string, score double, time bigint, share_score double, hot_count int, oldest bigint")


def difference(a: dict, b: dict) -> int:
    """100 less 15 a shared keyword, 1 a shared stem, 5 for the same domain; plus half the square of the features that differ."""
    score = 100 - (15 * len(a["k"] & b["k"]) + len(a["s"] & b["s"]) + (5 if a["d"] == b["d"] else 0))
    return score + len(a["f"] ^ b["f"]) ** 2 // 2


def diversified(items: list[dict], ahead: int = 8, behind: int = 3) -> list[int]:
    """Order of items: of the next `ahead`, the one that differs most from the last `behind` chosen (nearer ones weigh more)."""
    left, chosen = list(range(len(items))), []
    while left:

        def worth(i: int) -> int:
            total = 0
            for n in range(1, behind + 1):
                total += int(difference(items[i], items[chosen[-n]]) / n) if len(chosen) >= n else 120 // n
            return total

        best = max(left[:ahead], key=lambda i: (worth(i), -left.index(i)))
        chosen.append(best)
        left.remove(best)
    return chosen


def _diversify(rows: list[dict], ahead: int, behind: int) -> list[dict]:
    items = [{"k": set(r["keywords"] or ()), "s": set(r["stems"] or ()), "f": set(r["features"] or ()), "d": r["domain"]} for r in rows]
    return [rows[i] | {"position": at} for at, i in enumerate(diversified(items, ahead, behind))]


def diversify_streams(rows: DataFrame, ahead: int = 8, behind: int = 3) -> DataFrame:
    """(stream, url_id, score, position): rows need keywords, stems, features (arrays) and domain."""
    cols = ["stream", "url_id", "score", "keywords", "stems", "features", "domain"]
    return _each_stream(rows.select(*cols), lambda x: _diversify(x, ahead, behind), "stream string, url_id string, score double, position int")


def ranked_streams(candidates: DataFrame, k: int, window: int = 30 * HOUR, least: int = 2) -> DataFrame:
    """(stream, url_id, score, hot_count, position): the k rows of each stream.

    candidates: stream, url_id, score, rank_score (score times time), time, stems, share_score, second_score,
    keywords, features, domain. Top 3 k by rank_score, duplicates out, top k + 5 by score (1 + second_score),
    diversified, the first k: one shuffle for the limit and one pass for the rest.
    """
    top = top_per_group(candidates, ["stream"], [F.desc("rank_score"), F.asc("url_id")], 3 * k).drop("rank", "rank_score")

    def work(rows: list[dict]) -> list[dict]:
        few = sorted(_dedupe(rows, window, least), key=lambda r: (-r["score"] * (1 + (0.5 if r["second_score"] is None else r["second_score"])), r["url_id"]))[: k + 5]
        return _diversify(sorted(few, key=lambda r: (-r["score"], r["url_id"])), 8, 3)[:k]

    return _each_stream(top, work, "stream string, url_id string, score double, hot_count int, position int")


def with_next_page(rows: DataFrame, k: int) -> DataFrame:
    """The first k positions of each stream and whether there are more (rows hold one position more than shown)."""
    more = rows.groupBy("stream").agg((F.count("*") > k).alias("next_page"))
    return rows.filter(F.col("position") < k).join(more, "stream")


def image_first(rows: DataFrame, group: str, order: list[Column], has_image: Column) -> DataFrame:
    """Rows with `rank` in their group's order, but the first row with an image at the head; the others keep their order."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("__r", F.row_number().over(w))
    first = ranked.filter(has_image).groupBy(group).agg(F.min("__r").alias("__i"))
    out = ranked.join(first, group, "left")
    moved = F.when(F.col("__r") == F.col("__i"), 1).when(F.col("__r") < F.col("__i"), F.col("__r") + 1).otherwise(F.col("__r"))
    return out.withColumn("rank", moved.cast("int")).drop("__r", "__i")
