"""Shared helpers: reading, durable cuts of lineage, size-checked broadcasts, Arrow slices."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most ids that are broadcast as Spark's table (the driver takes about 150 bytes each to build it);
#: above it the same join goes through a shuffle.
BROADCAST_IDS = 500_000
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bits of a size estimate that a cut hands on; Spark's own for an unknown size has 63.
ESTIMATE_BITS = 64

#: The driver collects its garbage at a cut once its heap has grown to this share of the largest
#: it may have, so many seconds after the last time at least.
FULL, PAUSE = 0.5, 15.0
_collected = -PAUSE


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Makes checkpoint() and Python workers usable.

    The cluster's spark.checkpoint.dir is taken as it is; only where it is unset (tests, local
    runs) a folder of this process is made. Arrow batches hold fewer rows than by default. Workers get this checkout on their import path."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        path = tempfile.mkdtemp(prefix="strandly-checkpoint-")
        atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    if spark.conf.get(ROWS) == "10000":  # Spark's default; whole texts need smaller batches
        spark.conf.set(ROWS, "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: survives lost executors and is computed once.

    Spark hands a plan's size estimate on to its checkpoint, and estimates a join as the product
    of its sides: over rounds of joins that number fills the driver's memory with its digits. One
    beyond any table's size is dropped, so that the checkpoint has an unknown size; partitioning
    and order stay known. The shuffle files that led to the checkpoint go at once: Spark keeps
    them until the driver happens to collect its garbage."""
    prepare(df.sparkSession)
    own = df.select("*")  # an execution of its own, so that no other reads its shuffles
    done = own.checkpoint(eager=True)
    _drop_shuffles(own)
    _collect(df.sparkSession)
    plan = done._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
        return done
    jvm, session = df.sparkSession._jvm, done._jdf.sparkSession()
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, none, none)
    return type(done)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), df.sparkSession)


def _drop_shuffles(df: DataFrame) -> None:
    """Removes the shuffle files of a frame's own execution, as Spark does for finished queries
    by spark.sql.classic.shuffleDependency.fileCleanup.enabled: a later read would run them again."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        files = df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents()
        for i in plan.context().shuffleIds().keySet().toArray():
            files.removeShuffle(i, False)


def _collect(spark: SparkSession) -> None:
    """Collects the driver's garbage where its heap is large, see FULL.

    Spark forgets map outputs, broadcasts and checkpoints of frames that are gone only then, and a
    heap once grown to its limit stays so, beside all that the driver holds outside of it."""
    global _collected
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if time.monotonic() - _collected >= PAUSE and heap.totalMemory() > FULL * heap.maxMemory():
        gc.collect()
        jvm.java.lang.System.gc()
        _collected = time.monotonic()


def free(*cuts: DataFrame) -> None:
    """Deletes the files of cuts that nothing reads any more."""
    for df in cuts:
        sc = df.sparkSession.sparkContext
        sc._jvm.org.apache.spark.rdd.ReliableRDDCheckpointData.cleanCheckpoint(sc._jsc.sc(), df._jdf.queryExecution().analyzed().rdd().id())


def fresh(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows with whole-number keys whose partitioning is not known, so that a join on
    them deals both sides anew and can split a key with very many rows at runtime."""
    return df.withColumns({k: F.expr(f"`{k}` ^ 0L") for k in keys})


def with_ids(rows: DataFrame, ids: DataFrame, how: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Joins on the columns of `ids` (already cut): broadcast when its counted rows are at most
    `bound`, otherwise by a shuffle with the same result."""
    small = ids.limit(bound + 1).count() <= bound
    return rows.join(F.broadcast(ids) if small else ids.hint("merge"), ids.columns[:1], how)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, though `use` names it in a lambda's body."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of characters outside SPACE."""
    return F.filter(F.split(text, SPACE_RE), lambda x: x != F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches again in pieces of about `most` text bytes, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers outlive their tasks, and
    the next operator's run beside them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a task's batches that calls `forget` and releases memory at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            release()

    return whole


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Strings of a column, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
