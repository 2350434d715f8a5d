"""Labels from a teacher: a call for each batch of records, some calls in flight per task, retries, resume.

``ask(records)`` is any callable, shipped to the executors; it answers with label dictionaries.  Records that can't be
labelled give one error row each, and a later run asks for those again.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import records

RAW = "record_id string, should_wake boolean, wake_probability string, confidence string, wake_label string, route_label string, reason string, error string, attempts int"
_RAW = [c.split()[0] for c in RAW.split(", ")]


def answers_of(body) -> list[dict]:
    """The labels of an answer: a list, an object with ``labels`` or ``records``, one label, or text that holds any of these in a fence or among words."""
    if isinstance(body, str):
        text = body.strip()
        if text.startswith("```"):
            text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
        try:
            body = json.loads(text)
        except ValueError:
            starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
            end = max(text.rfind("}"), text.rfind("]"))
            if not starts or end < min(starts):
                raise ValueError("no JSON in the answer") from None
            body = json.loads(text[min(starts) : end + 1])
    if isinstance(body, dict):
        body = next((body[k] for k in ("labels", "records") if isinstance(body.get(k), list)), [body])
    found = [label for label in body if isinstance(label, dict)]
    if not found:
        raise ValueError("missing labels")
    return found


def _asked(batch: list[dict], ask: Callable, attempts: int, backoff: float) -> list[tuple]:
    """One batch with its retries: a row for each record; a batch of which any record has no answer fails as a whole."""
    for attempt in range(1, attempts + 1):
        try:
            found = answers_of(ask(batch))
            by_id = {str(label.get("record_id")): label for label in found}
            rows = []
            for record in batch:
                label = by_id.get(record["record_id"])
                if label is None and len(batch) == len(found) == 1:
                    label = found[0]
                if label is None:
                    raise ValueError(f"missing label for {record['record_id']}")
                wake = label.get("should_wake")
                text = [None if label.get(k) is None else str(label[k]) for k in ("wake_probability", "confidence", "wake_label", "route_label")]
                rows.append((record["record_id"], wake if isinstance(wake, bool) else None, *text, str(label.get("reason") or "")[:240], None, attempt))
            return rows
        except Exception as reason:
            if attempt == attempts:
                said = f"{type(reason).__name__}: {str(reason)[:240]}"
                return [(record["record_id"], None, None, None, None, None, None, said, attempt) for record in batch]
            time.sleep(backoff * attempt)
    raise AssertionError("unreachable")


def asked(rows: DataFrame, ask: Callable[[list[dict]], object], id_col: str = "id", size: int = 1, in_flight: int = 4, attempts: int = 3, backoff: float = 1.5, most_chars: int = 2400) -> DataFrame:
    """``RAW`` rows, one a record.  Batches of ``size`` records, at most ``in_flight`` calls of a task at a time; answers come out in the
    order of the records, and memory holds the batches in flight."""
    sent = rows.select(F.col(id_col).cast("string").alias("record_id"), F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, most_chars).alias("text"), *[c for c in rows.columns if c not in (id_col, "text", "record_id")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def batches() -> Iterator[list[dict]]:
            held: list[dict] = []
            for frame in frames:
                for record in frame.to_dict("records"):
                    held.append(record)
                    if len(held) == size:
                        yield held
                        held = []
            if held:
                yield held

        with ThreadPoolExecutor(in_flight) as pool:
            waiting: deque[Future] = deque()
            for batch in batches():
                waiting.append(pool.submit(_asked, batch, ask, attempts, backoff))
                if len(waiting) >= in_flight:
                    yield pd.DataFrame(waiting.popleft().result(), columns=_RAW)
            while waiting:
                yield pd.DataFrame(waiting.popleft().result(), columns=_RAW)

    return sent.mapInPandas(run, RAW)


def normalised(raw: DataFrame) -> DataFrame:
    """``RAW`` rows with ``should_wake, wake_probability, confidence`` as a decision and numbers; error rows keep nulls."""
    label = records.normalised_label(F.col("should_wake"), F.col("wake_probability"), F.col("confidence"))
    ok = F.col("error").isNull()
    return raw.withColumn("_l", F.when(ok, label)).select("record_id", "_l.should_wake", "_l.wake_probability", "_l.confidence", "wake_label", "route_label", "reason", "error", "attempts")


def open_rows(rows: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Records without a successful row in ``done`` (``record_id, error``): those never asked for and those in error."""
    settled = done.where("error is null and record_id is not null").select(F.col("record_id").alias("_done")).distinct()
    return rows.join(settled, F.col(id_col).cast("string") == F.col("_done"), "left_anti")


def settled(labels: DataFrame, seq: Column) -> DataFrame:
    """One row a record over several runs: its last success, or else its last error."""
    rest = [c for c in labels.columns if c != "record_id"]
    return labels.groupBy("record_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("error").isNull(), seq)).alias("r")).select("record_id", "r.*")


def labelled(rows: DataFrame, ask: Callable[[list[dict]], object], path: str, run: int, id_col: str = "id", **options) -> DataFrame:
    """A run that resumes: asks for what has no label yet at ``path``, writes the answers as its part ``run``, and returns them.
    A part is written once and read from then on, so no call is made again for it."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    kind = "record_id string, should_wake boolean, wake_probability double, confidence double, wake_label string, route_label string, reason string, error string, attempts int"
    done = spark.read.schema(f"{kind}, run int").parquet(path).where(F.col("run") != run) if exists else spark.createDataFrame([], kind)
    part = f"{path}/run={run}"
    normalised(asked(open_rows(rows, done, id_col), ask, id_col, **options)).write.mode("overwrite").parquet(part)
    return spark.read.schema(kind).parquet(part)
