"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null becomes empty), under fixed names, so that
    extra columns can neither clash nor be read from disk."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def whole(docs: DataFrame) -> DataFrame:
    """All columns of a table in one, ``row``, so that what an operator adds clashes with none of them."""
    return docs.select(F.struct("*").alias("row"))


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, with its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; one of our own is made only where that
    is unset, none was set by hand and the master is local, as in tests.  The shuffle files behind it go as soon as
    it is written: nothing can ask for them again.
    """
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillstone-"))
    before = conf.get(clean, None)
    conf.set(clean, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, made under this setting
    finally:
        conf.unset(clean) if before is None else conf.set(clean, before)


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of a text column (a longer text is a part of its own),
    so that few texts are Python objects at a time, however long they are."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to larger ones of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def trimmed() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def released(rows: Iterator) -> Iterator:
    """The rows of a task; what it took goes back to the system at its end, since the worker
    process lives on for other tasks."""
    try:
        yield from rows
    finally:
        trimmed()


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 0) among those of equal ``keys`` (of all rows, without keys) in ``order``.

    A key may hold any share of the rows: they are range-sorted by keys and order and written once, and what
    meets is a count for each partition and key.  That table is broadcast; it has at most a row for each
    partition and each key, so the keys must be of a bounded number.
    """
    sort = [*keys, *order]
    held = durable(rows.repartitionByRange(*sort).sortWithinPartitions(*sort)).withColumn("place_", F.monotonically_increasing_id())
    part = held.withColumn("part_", F.shiftright("place_", 33))
    runs = part.groupBy("part_", *keys).agg(F.count("*").alias("n_"), F.min("place_").alias("least_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = runs.select("part_", *[F.col(k).alias(f"{k}_") for k in keys], (before - F.col("least_")).alias("shift_"))
    on = part["part_"] == shifts["part_"]
    for k in keys:
        on = on & part[k].eqNullSafe(shifts[f"{k}_"])
    met = part.join(F.broadcast(shifts), on)
    return met.select(*rows.columns, (F.col("place_") + F.col("shift_")).alias(name))


_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(2 << 20))


def modest(spark: SparkSession) -> None:
    """Arrow batches of texts hold 2 MiB unless the session has a limit of its own: rows differ in
    size by far too much for Spark's usual 10,000 of them."""
    key, usual, ours = _BATCH
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, ours)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes, with ``released`` memory."""
    modest(df.sparkSession)
    return df.mapInArrow(lambda batches: released(run(batches)), schema)


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels no model may learn from: crc32 of the id as text, mod 3, is 1;
    false for a null id."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1, F.lit(False))


#: Labels up to which they are broadcast to the documents (of some 20 bytes each).
FEW_LABELS = 1_000_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """All labelled rows ``doc_id, text, y`` outside the held-out fold, or at most ``limit`` of them.

    Which rows: those with the smallest hash of the id, hence a uniform and repeatable sample that
    depends on nothing but the ids.  The rows are picked among the labels alone, before any text
    is read, and only then joined.  Of documents that
    share an id one, with the least hash of its text, is taken, so the bound holds for repeated ids too.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    if limit is not None:
        picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    few = limit is not None or picked.count() <= FEW_LABELS
    found = texts(docs).join(F.broadcast(picked) if few else picked, "doc_id")
    return found.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("doc_id", "r.text", "r.y")
