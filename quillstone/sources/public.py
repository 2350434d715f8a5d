"""Rows of public datasets in the shape of the corpus: sentiment files, viewer rows, rows for external models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text

# The sentiments that count, the one that is positive here, and the names of sources and labels.
SENTIMENTS = ("NEGATIVE", "NEUTRAL", "POSITIVE")
SENTIMENT_SOURCE, TRACE_SOURCE, TRACE_LABEL = "hf_agent_trace_sentiment:", "hf_agent_trace:", "hf_agent_trace_prompt"


def is_negative(label: Column) -> Column:
    """1 for a negative sentiment, 0 for the two others, null for anything else."""
    name = F.upper(F.coalesce(label.cast("string"), F.lit("")))
    return F.when(name.isin(*SENTIMENTS), (name == "NEGATIVE").cast("int"))


def sentiments(rows: DataFrame, dataset: str, config: str, split: str, row_idx: str) -> DataFrame:
    """Rows (``content_text, sentiment_label``, further columns stay) as corpus rows with ``label``; other labels and blank texts go.
    The filter on labels reaches the files."""
    label = F.upper(F.coalesce(F.col("sentiment_label").cast("string"), F.lit("")))
    found = rows.where(label.isin(*SENTIMENTS)).withColumn("_text", text.compact(F.col("content_text"))).where("_text <> ''")
    named = F.concat(F.lit(f"hf:{dataset}:{config}:{split}:"), F.col(row_idx).cast("string"))
    kept = [c for c in rows.columns if c not in ("content_text", "sentiment_label", row_idx, "id", "source", "text", "label", "row_idx")]
    return found.select(named.alias("id"), F.lit(SENTIMENT_SOURCE + dataset).alias("source"), F.col(row_idx).alias("row_idx"), F.col("_text").alias("text"), is_negative(F.col("sentiment_label")).alias("label"), label.alias("sentiment_label"), *kept)


def viewer_rows(rows: DataFrame, dataset: str, config: str, most: int = 2400) -> DataFrame:
    """Rows of pages (``split, row_idx, prompt``, further columns stay) as corpus rows; blank prompts go."""
    found = rows.withColumn("_text", text.compact(F.col("prompt"), most)).where("_text <> ''")
    named = F.concat(F.lit(f"hf:{dataset}:{config}:"), F.col("split"), F.lit(":"), F.col("row_idx").cast("string"))
    kept = [c for c in rows.columns if c not in ("prompt", "id", "source", "text", "weak_label", "old_trigger")]
    return found.select(named.alias("id"), F.lit(TRACE_SOURCE + dataset).alias("source"), F.col("_text").alias("text"), F.lit(False).alias("old_trigger"), F.lit(TRACE_LABEL).alias("weak_label"), *kept)


def external_rows(corpus: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """``id, source, text, label, split`` of labelled records (``record_id, label``) for a model elsewhere."""
    found = corpus.join(labels.select(F.col("record_id").alias("id"), F.col("label").cast("int").alias("label")), "id")
    return found.select("id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), "label", F.lit(split).alias("split"))


def newest_per_root(files: DataFrame, root: str, k: int = 500) -> DataFrame:
    """The newest files (``path, modified``) of every root."""
    nth = F.row_number().over(Window.partitionBy(root).orderBy(F.desc("modified"), "path"))
    return files.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
