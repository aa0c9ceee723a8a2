"""Per-key results over ordered rows when a few keys hold most of them.

Rows are range-partitioned on (key, order columns) with Spark's sampled quantiles, so a heavy key is cut
into as many partitions as its share asks for and none of them holds more than about 1/n of all rows. Each
partition makes one partial state per key it meets, in order, and the partial states of a key that spans
several partitions are stitched in partition order: what happens across a boundary (the gap between the last
value of one partition and the first of the next) is added there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.session import ship, written

_PARTIAL = (
    "part int, k string, n_rows bigint, n_records bigint, n_values bigint, first_value bigint, last_value bigint, "
    "gap_sum bigint, gap_max bigint, measure_sum bigint"
)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per run of equal keys. Input columns: k, v (order, may be null), id, m; sorted by k, v, id."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out: list[dict] = []
    state: dict | None = None
    last_id: str | None = None

    def flush() -> pa.RecordBatch:
        cols = list(zip(*[r.values() for r in out], strict=True)) if out else [[] for _ in _NAMES]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)
        out.clear()
        return batch

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = batch.column("k")
        enc = key.dictionary_encode()
        codes = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ids = batch.column("id")
        id_codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        values = batch.column("v")
        known = values.is_valid().to_numpy(zero_copy_only=False)
        v = values.fill_null(0).to_numpy(zero_copy_only=False)
        m = batch.column("m").fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = key[int(a)].as_py()
            new = np.r_[True, id_codes[a + 1 : b] != id_codes[a : b - 1]]
            if state is not None and state["k"] == k:
                new[0] = ids[int(a)].as_py() != last_id
            else:
                if state is not None:
                    out.append(state)
                state = dict(zip(_NAMES, (part, k, 0, 0, 0, None, None, 0, None, 0), strict=True))
            state["n_rows"] += int(b - a)
            state["n_records"] += int(new.sum())
            state["measure_sum"] += int(m[a:b][new].sum())
            vs = v[a:b][new & known[a:b]]
            if len(vs):
                seq = vs if state["last_value"] is None else np.r_[state["last_value"], vs]
                gaps = np.diff(seq)
                state["n_values"] += len(vs)
                if state["first_value"] is None:
                    state["first_value"] = int(vs[0])
                state["last_value"] = int(vs[-1])
                if len(gaps):
                    state["gap_sum"] += int(gaps.sum())
                    state["gap_max"] = max(int(gaps.max()), state["gap_max"] or 0)
            last_id = ids[int(b - 1)].as_py()
        if len(out) > 10_000:
            yield flush()
    if state is not None:
        out.append(state)
    if out:
        yield flush()


_NAMES = [x.split()[0] for x in _PARTIAL.split(", ")]
_TYPES = [{"int": pa.int32(), "string": pa.string(), "bigint": pa.int64()}[x.split()[1]] for x in _PARTIAL.split(", ")]


def ordered_key_partials(df: DataFrame, key: Column, order: Column, record: Column, measure: Column, partitions: int = 0) -> DataFrame:
    """Partial states per (partition, key), written once; a key's rows may span any number of partitions.

    Rows of one record (equal key, order and record id) count once; null order values are counted as records
    but have no gaps; a null key is kept as its own state; an empty table gives no state.
    """
    spark = df.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key.cast("string").alias("k"), order.cast("bigint").alias("v"), record.cast("string").alias("id"), measure.cast("bigint").alias("m"))
    ranged = rows.repartitionByRange(n, "k", "v", "id").sortWithinPartitions("k", "v", "id")
    return written(ranged.mapInArrow(_partials, _PARTIAL), "partials")


def stitch(partials: DataFrame) -> DataFrame:
    """Merge the partial states of each key in partition order: at most one state per partition and key."""
    inner = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("last_value", ignorenulls=True).over(inner)
    across = partials.withColumn("across", F.col("first_value") - before)
    return across.groupBy("k").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"), F.sum("n_values").alias("n_values"),
        F.min("first_value").alias("first_value"), F.max("last_value").alias("last_value"),
        (F.sum("gap_sum") + F.coalesce(F.sum("across"), F.lit(0))).alias("gap_sum"),
        F.greatest(F.max("gap_max"), F.max("across")).alias("gap_max"), F.sum("measure_sum").alias("measure_sum"),
    )


def key_profile(df: DataFrame, key: str, order: str, record: str, measure: str, partitions: int = 0) -> DataFrame:
    """Per key: rows, records, share of all records, first and last order value, mean and longest gap, measure sum.

    The null key has its own row. Ties in the order column are kept apart by the record id; a record delivered
    several times with the same key and order counts once. An empty table gives an empty result.
    """
    partials = ordered_key_partials(df, F.col(key), F.col(order), F.col(record), F.col(measure), partitions)
    total = partials.agg(F.sum("n_records")).first()[0] or 0
    out = stitch(partials)
    return out.select(
        F.col("k").alias(key), "n_rows", "n_records",
        (F.col("n_records") / F.lit(max(total, 1))).alias("share"),
        F.col("first_value").alias("first_time"), F.col("last_value").alias("last_time"),
        F.try_divide("gap_sum", F.col("n_values") - 1).alias("mean_gap"), F.col("gap_max").alias("max_gap"), F.col("measure_sum").alias(f"sum_{measure}"),
    )


def heavy_keys(df: DataFrame, key: str, order: str, record: str, measure: str, share: float, partitions: int = 0) -> DataFrame:
    """The non-null keys that hold more than `share` of all records."""
    return key_profile(df, key, order, record, measure, partitions).filter(F.col(key).isNotNull() & (F.col("share") > share)).select(key)
