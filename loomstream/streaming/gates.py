"""Structured Streaming forms of the recurring jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstream.session import shared_dir, ship


def recency_gate(stream: DataFrame, key: str, time: str, gap: int, late: str = "1 hour") -> DataFrame:
    """(key, time) of the events that come at least `gap` after the key's last one let through; state is one time per key.

    A key's state ends when event time has passed it by the gap, so what is kept is bounded by the keys of one gap.
    Events that come later than `late` after newer ones are dropped.
    """
    ship(stream.sparkSession)
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(int(t) for pdf in pdfs for t in pdf[time].dropna())
        out = []
        for t in times:
            if last is None or t - last >= gap:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + gap, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), time: out})

    timed = stream.select(key, time, F.timestamp_millis(time).alias("__ts")).filter(F.col(time).isNotNull()).withWatermark("__ts", late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def recency_gate_batch(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """recency_gate() over a table: a key's times are read in order, one after the other, and never held together.

    Null keys and times have no rows; equal times count once.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(time).cast("bigint").alias("t")).filter("k is not null and t is not null").distinct()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in it:
            if not batch.num_rows:
                continue
            times, keep = batch.column("t").to_numpy(), np.zeros(batch.num_rows, bool)
            codes = batch.column("k").dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = batch.column("k")[a].as_py()
                if key != at:
                    at, last = key, None
                i = a if last is None else a + int(np.searchsorted(times[a:b], last + gap))
                while i < b:  # from one time let through to the next, not row by row
                    keep[i] = True
                    last = int(times[i])
                    i += max(1, int(np.searchsorted(times[i:b], last + gap)))
            yield batch.filter(pa.array(keep))

    out = rows.repartition("k").sortWithinPartitions("k", "t").mapInArrow(run, rows.schema)
    return out.select(F.col("k").alias(key), F.col("t").alias(time))


def running_count(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def windowed_count(stream: DataFrame, time: str, keys: list[str], window: str, slide: str | None, late: str) -> DataFrame:
    """Counts per time window; events later than the watermark are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def last_uses(stream: DataFrame, key: str, time: str, n: int = 5, apart: int = 3_600_000) -> DataFrame:
    """(key, times): the newest n uses of each key, a use only when more than `apart` after the event before; updated per batch."""
    ship(stream.sparkSession)
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        uses, before = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        for t in sorted(int(t) for pdf in pdfs for t in pdf[time].dropna()):
            if before is None or t - before > apart:
                uses.append(t)
            before = t if before is None else max(before, t)
        uses = sorted(uses, reverse=True)[:n]
        state.update((uses, before))
        yield pd.DataFrame({key: [k[0]], "times": [uses]})

    out = f"{key} {kind}, times array<bigint>"
    return stream.select(key, time).groupBy(key).applyInPandasWithState(step, out, "uses array<bigint>, before bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Drive a stream over what its source holds now and return the result table, written batch by batch to the shared folder.

    'complete' keeps the last batch's result, 'append' and 'update' all batches' rows.
    """
    root = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/rows")

    df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{root}/rows")
    q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/rows")


def heartbeat(stream: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, started, finished, n, n_open, millis) of running work, to be emitted at each trigger: how much has begun and ended, when, and how long it took."""
    done = F.col(end).isNotNull()
    return stream.groupBy(*keys).agg(F.min(start).alias("started"), F.max(end).alias("finished"), F.count("*").alias("n"), F.count_if(~done).alias("n_open"), F.coalesce(F.sum(F.col(end) - F.col(start)), F.lit(0)).alias("millis"))
