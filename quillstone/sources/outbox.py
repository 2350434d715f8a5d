"""An outbox: rows wait in a table until a service has acknowledged each of them.

Rows have an ``insert_id``.  A flush posts what has no acknowledgement, in groups, on the executors, and writes down each
group's answer; what was refused stays for the next flush, and what was accepted is never sent again.  A task that is
repeated may post a group again: the service tells it by its insert ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import mining

ACKS = "insert_id string, accepted boolean, error string, flush long"


class Outbox:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        """``schema``: of the rows, ``insert_id string`` among them."""
        self.spark, self.path, self.schema = spark, path, schema

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def add(self, rows: DataFrame, batch: int | None = None) -> None:
        """Adds rows; a batch of a stream that is repeated replaces itself."""
        if batch is None:
            rows.select(*[c.split()[0] for c in self.schema.split(", ")]).write.mode("append").parquet(f"{self.path}/rows")
        else:
            rows.select(*[c.split()[0] for c in self.schema.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema).dropDuplicates(["insert_id"])

    def acks(self) -> DataFrame:
        return self._read("acks", ACKS)

    def waiting(self) -> DataFrame:
        """Rows without an acknowledgement."""
        return self.rows().join(self.acks().where("accepted").select("insert_id").distinct(), "insert_id", "left_anti")

    def flush(self, post: Callable[[list[dict]], bool], number: int, limit: int = 50) -> DataFrame:
        """Posts what waits; returns ``accepted, n``.  ``post(rows)`` says whether a group is accepted; an error of its is a refusal.
        ``number`` names the flush: one that is repeated replaces its own answers."""
        pending = self.waiting()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a in range(0, len(frame), limit):
                    part = frame.iloc[a : a + limit]
                    error = None
                    try:
                        accepted = bool(post(part.to_dict("records")))
                    except Exception as reason:
                        accepted, error = False, f"{type(reason).__name__}: {reason}"[:160]
                    yield pd.DataFrame({"insert_id": part["insert_id"], "accepted": accepted, "error": error, "flush": number})

        pending.mapInPandas(run, ACKS).write.mode("overwrite").parquet(f"{self.path}/acks/number={number}")
        return self.spark.read.schema(ACKS).parquet(f"{self.path}/acks/number={number}").groupBy("accepted").agg(F.count("*").alias("n"))

    def status(self) -> DataFrame:
        """How many rows wait, and when and how the last flush went."""
        states = self.acks().groupBy("flush").agg(F.when(F.bool_and("accepted"), "ok").when(F.bool_or("accepted"), "partial").otherwise("failed").alias("state"))
        return mining.outbox_status(self.waiting().select("insert_id"), states, "flush")

    def sink(self, post: Callable[[list[dict]], bool], limit: int = 50) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function: a batch's rows are added and all that waits is posted."""

        def send(batch: DataFrame, number: int) -> None:
            self.add(batch, number)
            self.flush(post, number, limit)

        return send
