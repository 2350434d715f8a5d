"""Shadow models: old events get the scores of models that they lack.

A line is changed only if it gets a score; all others, and lines that hold no object, go out as they came in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import records
from quillstone.operators import scoring
from quillstone.sources import jsonl

CHANGED = "path string, line long, value string"


def wanted(rows: DataFrame, models: list[str], allow_snippet: bool = True, transcripts: DataFrame | None = None, force: bool = False) -> DataFrame:
    """``rows`` (``jsonl.preserving``) with ``text, provenance``, ``scored`` (the line has a main score) and ``lacks``, the models whose
    alternates it hasn't; ``force`` asks for all.  ``transcripts``: ``path, line, text`` that events point to by ``transcript_path, transcript_line``."""
    get = lambda path, kind="string": F.try_variant_get("row", path, kind)
    rows = rows.withColumns({"_prompt": get("$.prompt"), "_snippet": get("$.snippet"), "_at": get("$.transcript_path"), "_n": get("$.transcript_line", "long")})
    if transcripts is not None:
        told = transcripts.select(F.col("path").alias("_at"), F.col("line").alias("_n"), F.col("text").alias("_told"))
        rows = rows.join(told, ["_at", "_n"], "left")
    else:
        rows = rows.withColumn("_told", F.lit(None).cast("string"))
    have = F.map_keys(F.coalesce(get("$.classifier.alternates", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    text = records.resolved_text(F.col("_prompt"), F.col("_told"), F.col("_snippet"), allow_snippet)
    names = F.array(*map(F.lit, models))
    lacks = names if force else F.array_except(names, have)
    return rows.withColumn("_t", text).withColumns({"text": F.col("_t.text"), "provenance": F.col("_t.provenance"), "scored": get("$.classifier.score", "double").isNotNull(), "lacks": lacks}).drop("_prompt", "_snippet", "_at", "_n", "_told", "_t")


def missing_scores(rows: DataFrame, sections: dict[str, Column], models: DataFrame, intercepts: dict[str, float | None]) -> DataFrame:
    """``key, alternates``: of ``wanted`` rows (with a unique ``key``) a map of the models that they lack to their scores.  Models
    that fail give nothing."""
    docs = rows.where("scored and text <> '' and size(lacks) > 0").select("key", "text")
    lacks = rows.select("key", F.explode("lacks").alias("model"))
    found = scoring.family_scores(docs, "key", sections, models, intercepts, explain=0).where("score is not null").join(lacks, ["key", "model"], "left_semi")
    return found.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "score")))).alias("alternates"))


def backfilled(rows: DataFrame, sections: dict[str, Column], models: DataFrame, intercepts: dict[str, float | None], stamp: str, **options) -> DataFrame:
    """``path, line, value, changed, provenance``: all lines of ``jsonl.preserving`` rows, those that lacked scores with them."""
    keyed = wanted(rows, list(intercepts), **options).withColumn("key", F.concat_ws("\0", "path", "line"))
    joined = keyed.join(missing_scores(keyed, sections, models, intercepts), "key", "left")

    def changed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for value, added, provenance in zip(frame["value"], frame["alternates"], frame["provenance"]):
                event = json.loads(value)
                kept = event["classifier"].get("alternates")
                event["classifier"]["alternates"] = {**(kept if isinstance(kept, dict) else {}), **{m: {"score": s} for m, s in dict(added).items()}}
                event["classifier"] |= {"alternates_backfilled_at": stamp, "alternates_prompt_source": provenance}
                out.append(json.dumps(event, ensure_ascii=False))
            frame["value"] = out
            yield frame[["path", "line", "value"]]

    new = joined.where("alternates is not null").select("path", "line", "value", "alternates", "provenance").mapInPandas(changed, CHANGED)
    new = new.withColumnRenamed("value", "_new")
    out = joined.select("path", "line", "value", "scored", "lacks", "text", "provenance", F.col("alternates").isNotNull().alias("changed")).join(new, ["path", "line"], "left")
    return out.select("path", "line", F.coalesce("_new", "value").alias("value"), "changed", "scored", (F.size("lacks") == 0).alias("complete"), (F.col("text") == "").alias("empty"), "provenance")


def counters(rows: DataFrame) -> DataFrame:
    """What a backfill did: lines, those with a main score, already complete, without text, changed; and texts by provenance."""
    asked = F.col("scored") & ~F.col("complete")
    return rows.agg(
        F.count("*").alias("rows"), F.count_if("scored").alias("classifier_scored"), F.count_if(F.col("scored") & F.col("complete")).alias("already_had_alternates"),
        F.count_if(asked & F.col("empty")).alias("missing_text"), F.count_if("changed").alias("backfilled"),
        *[F.count_if(asked & (F.col("provenance") == p)).alias(f"from_{p}") for p in ("prompt", "transcript", "snippet", "missing")])


def backfill(spark: SparkSession, path: str, out: str, sections: dict[str, Column], models: DataFrame, intercepts: dict[str, float | None], stamp: str, **options) -> DataFrame:
    """Writes all lines of the files at ``path``, in their order, to ``out`` and returns the ``counters``; the files themselves stay as the backup."""
    rows = backfilled(jsonl.preserving(jsonl.lines(spark, path)), sections, models, intercepts, stamp, **options)
    rows.repartitionByRange("path", "line").sortWithinPartitions("path", "line").select("path", "line", "value", "changed", "scored", "complete", "empty", "provenance").write.mode("overwrite").parquet(f"{out}.state")
    told = spark.read.parquet(f"{out}.state")
    told.orderBy("path", "line").select("value").write.mode("overwrite").text(out)
    return counters(told)
