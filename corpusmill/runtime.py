"""Session helpers: cutting lineage into the shared checkpoint folder, and ranks and running sums without a one-task window."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []
_LOCK, _WRITES, _BEFORE = threading.Lock(), [0], [None]
SMALL = 1 << 30  # bytes of a plan's estimate up to which spread() may move rows


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all tasks run in this process, a temporary folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(_remove, _OWN[app])
    return _OWN[app]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


@contextlib.contextmanager
def _freeing_shuffles(spark: SparkSession):
    """While tables are written, the shuffles behind them go as soon as they are read; writes of several threads may overlap."""
    with _LOCK:
        if not _WRITES[0]:
            _BEFORE[0] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITES[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITES[0] -= 1
            if not _WRITES[0]:
                spark.conf.unset(CLEANUP) if _BEFORE[0] is None else spark.conf.set(CLEANUP, _BEFORE[0])


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and the data survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, f"stage-{name}")
    with _freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that drop_staged() and scratch() remove."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def _leave() -> None:
    """At the end of the driver nothing staged is left: through the session where it still runs, else as local folders."""
    import shutil

    for spark, path in _STAGED:
        try:
            _delete(spark, [path])
        except Exception:  # noqa: BLE001 - the session has ended
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


atexit.register(_leave)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def unstage(*tables: DataFrame) -> None:
    """Removes tables of stage() that nothing will read again."""
    for t in tables:
        path = getattr(t, "_staged_at", None)
        if path:
            _delete(t.sparkSession, [path])
            _STAGED[:] = [x for x in _STAGED if x[1] != path]


def drop_staged(spark: SparkSession) -> None:
    """Removes every table that stage() wrote for this session; results not yet written by then can no longer be computed."""
    _delete(spark, [path for owner, path in _STAGED if owner is spark])
    _STAGED[:] = [x for x in _STAGED if x[0] is not spark]


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Whatever is staged within is removed at the end; results must have been written by then."""
    before = {path for _, path in _STAGED}
    try:
        yield
    finally:
        new = [path for owner, path in _STAGED if owner is spark and path not in before]
        _delete(spark, new)
        _STAGED[:] = [x for x in _STAGED if x[1] not in set(new)]


def _accumulate(order: list[str], by: str | None, amount: str | None, out: str):
    """Rows arrive sorted within a partition; emits them with their local rank or running amount before the row, and the partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, carried = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            amounts = np.ones(len(pdf), np.int64) if amount is None else pdf[amount].to_numpy(np.int64)
            total = np.concatenate([[0], np.cumsum(amounts)])
            before = total[:-1].copy()
            if by is None:
                before += carried
                carried += int(total[-1])
            else:
                keys = pdf[by].to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                base = np.repeat(before[starts], np.diff(np.append(starts, len(keys))))
                before = before - base
                if keys[0] == last:
                    before[: starts[1] if len(starts) > 1 else len(keys)] += carried
                carried = int(before[-1] + amounts[-1])
                last = keys[-1]
            pdf[out] = before
            pdf["_pid"] = pid
            yield pdf

    return run


def running_total(df: DataFrame, order: list[str], out: str, by: str | None = None, amount: str | None = None) -> DataFrame:
    """Adds `out`: the number of rows (or the sum of the integer column `amount`) before the row in the order (by, *order).

    `by` restarts the count and must have no nulls, `order` should end in a unique key. The rows are range-sorted, each partition counts its own, and
    the partitions' totals (one row for each partition and value of `by` in it) shift the local figures; no group is
    gathered into one task, however large.
    """
    keys = [*([by] if by else []), *order]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType()), T.StructField("_pid", T.IntegerType())])
    local = stage(sorted_.mapInPandas(_accumulate(order, by, amount, out), schema), "running")
    group = [F.col("_pid"), *([F.col(by)] if by else [])]
    last = F.max(F.col(out) + (F.col(amount).cast("long") if amount else F.lit(1))).alias("_sum")
    sums = local.groupBy(*group).agg(last)
    from pyspark.sql import Window

    w = Window.orderBy("_pid") if by is None else Window.partitionBy(by).orderBy("_pid")
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    joined = local.join(offsets, ["_pid", *([by] if by else [])])
    return joined.select(*df.columns, (F.col(out) + F.col("_off")).alias(out))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is small (SMALL bytes by the optimiser's estimate) and its files give fewer partitions than there are cores; the result is the same."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df._jdf.rdd().getNumPartitions() < cores else df


def hash_unit(*cols, seed: int = 0) -> F.Column:
    """A uniform number in (0, 1) that depends only on the seed and the columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.pmod(h, F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
