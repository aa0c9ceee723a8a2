"""What every operator needs of the session: code on the workers, shared tables, salted joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the same path as the driver."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, a session on this machine alone (tests) gets a temporary folder; on a cluster it is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = getattr(shared_dir, "own", None)
        if not set_dir:
            set_dir = shared_dir.own = tempfile.mkdtemp(prefix="loomstream-")
            atexit.register(shutil.rmtree, set_dir, True)
    return f"{set_dir}/loomstream-{spark.sparkContext.applicationId}"


def remove_written(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; call it when the results are no longer needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def skew_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Inner or left join of a large left side to a right side that is unique on the keys and says in `weight` how many rows each key has.

    Keys of more than half a task's share of all rows are heavy - at most two a task, so they may be broadcast; their
    left rows are spread over as many tasks as there are shuffle partitions, and only they are repeated on the right.
    `right` is read three times: a written table.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = right.filter(F.col(weight) > total / (2 * parts)).select(*on, F.lit(parts).alias("__n"))
    hashable = [c for c, t in left.dtypes if not t.startswith("map")]
    left = left.join(F.broadcast(heavy), on, "left").withColumn("__salt", F.pmod(F.xxhash64(*hashable), F.coalesce("__n", F.lit(1))).cast("int")).drop("__n")
    few = F.when(F.col(weight) > total / (2 * parts), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(right.withColumn("__salt", F.explode(few)), [*on, "__salt"], how).drop("__salt")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Join a skewed left side to a right side that is small next to it and unique on the keys.

    Every right row is repeated `salts` times, every left row gets one of the salts by the hash
    of all its columns, so one key's rows are spread over `salts` tasks. Null keys never match.
    """
    salt = "__salt"
    hashable = [c for c, t in left.dtypes if not t.startswith("map")]
    left = left.withColumn(salt, F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    right = right.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, salt], how).drop(salt)


def written_together(frames: dict[str, DataFrame], threads: int = 8) -> dict[str, DataFrame]:
    """Several tables written at the same time, each by its own job, and read back: what asynchronous reads are for."""
    with ThreadPoolExecutor(min(threads, max(1, len(frames)))) as pool:
        done = {name: pool.submit(written, df, name) for name, df in frames.items()}
        return {name: job.result() for name, job in done.items()}
