"""Plumbing that operators share: durable tables, Arrow batches of bounded bytes, places in an order."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read again, so that what is used several times is computed once
    and survives lost executors.  The folder is ``spark.checkpoint.dir``; one of our own is made only for a local master without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillstone-"))
    return df.checkpoint(eager=True)


_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of 4 MiB, unless the session has a limit of its own (rows differ in size by far too much for Spark's
    usual 10,000 of them); what a task took goes back to the system at its end, since the worker process lives on for other tasks."""
    key, usual, ours = _BATCH
    if df.sparkSession.conf.get(key, usual) == usual:
        df.sparkSession.conf.set(key, ours)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return df.mapInArrow(released, schema)


def summed(rows: DataFrame, keys: list[str], chunk: str, order: list[str | Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of equal ``keys`` up to each, in ``order``.

    ``chunk`` must not fall in that order.  Sums run within a chunk, and the chunks' totals (a row each) run by key: a key
    with a third of all rows is as many tasks' work as it has chunks."""
    totals = rows.groupBy(*keys, chunk).agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(chunk).alias("_chunk_"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = rows[chunk].eqNullSafe(offsets["_chunk_"])
    for k in keys:
        on = on & rows[k].eqNullSafe(offsets[f"_{k}"])
    within = F.sum(value).over(Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(offsets, on).withColumn(name, within + F.col("_before")).drop("_chunk_", "_before", *[f"_{k}" for k in keys])
