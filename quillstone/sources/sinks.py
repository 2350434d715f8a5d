"""Sinks: appended and replaced JSON Lines, labelled text, run records, batches in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.store import durable


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace(rows: DataFrame, path: str, backup: str | None = None) -> None:
    """Writes beside the target and swaps the folders by renaming: a failed job leaves the target as it
    was.  With ``backup`` the former target is kept there, else deleted.  Rows may come from the target.

    A run that ended between the two renames has left no target; ``restored`` (also called here) brings it back."""
    new, old = f"{path}.new", backup or f"{path}.old"
    restored(rows.sparkSession, path)
    rows.write.mode("overwrite").json(new)
    hadoop = rows.sparkSession._jvm.org.apache.hadoop.fs
    here, there, source = hadoop.Path(path), hadoop.Path(old), hadoop.Path(new)
    files = here.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    if files.exists(here):
        if backup is None:
            files.delete(there, True)
        elif files.exists(there):
            raise FileExistsError(old)
        if not files.rename(here, there):
            raise OSError(f"{path} could not be moved")
    if not files.rename(source, here):
        raise OSError(f"{new} could not be moved")
    if backup is None:
        files.delete(there, True)


def restored(spark: SparkSession, path: str) -> bool:
    """After a swap that was cut off: the complete new folder takes the target's place, or else the old one returns to it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    here, done = hadoop.Path(path), hadoop.Path(f"{path}.new/_SUCCESS")
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(here):
        return False
    for kept in ([f"{path}.new"] if files.exists(done) else []) + [f"{path}.old"]:
        if files.exists(hadoop.Path(kept)):
            return files.rename(hadoop.Path(kept), here)
    return False


def report(rows: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A Markdown table of at most ``most`` rows, in their order, as one text file; a last line says so if there are more."""
    def cell(v) -> str:
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else " ".join(str(v).split()).replace("|", "\\|")

    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    shown = rows.limit(most + 1).collect()
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in shown[:most]]
    lines += ["", f"The first {most} rows; there are more."] if len(shown) > most else []
    text = rows.sparkSession.createDataFrame([("\n".join(lines),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)


def counted(rows: DataFrame, path: str) -> int:
    """Writes and returns how many rows went out, by counting the written lines: the rows themselves are made once."""
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.text(path).count()


def labelled_text(rows: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    """``__label__x text`` lines."""
    rows.select(F.concat(F.lit("__label__"), F.col(label).cast("string"), F.lit(" "), F.regexp_replace(text, r"\s+", " "))).write.mode("overwrite").text(path)


def run_record(rows: DataFrame, path: str, run_id: str, summary: DataFrame | None = None, title: str = "Run") -> None:
    """A run's result under its own folder, with a summary's table beside it under ``summaries``."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)
    if summary is not None:
        report(summary, f"{path}.summaries/run_id={run_id}", f"{title} {run_id}")


def label_folder(labels: DataFrame, path: str) -> DataFrame:
    """Writes the rows that ``labels.student_labels`` keeps, a folder for each label file, and returns the counters
    ``origin, reason, n`` of all rows; these are made once."""
    told = durable(labels)
    told.where("reason is null").drop("reason").write.mode("overwrite").partitionBy("label_file").json(path)
    return told.groupBy("origin", "reason").agg(F.count("*").alias("n"))


def model(weights: DataFrame, path: str) -> None:
    """The terms of a model that have a weight."""
    weights.where("coef <> 0").write.mode("overwrite").json(path)


def outbox(post, limit: int = 50):
    """A ``foreachBatch`` function that posts rows in groups; what isn't accepted fails the batch,
    which the checkpoint then repeats.  ``post(rows) -> bool`` runs on the executors."""

    def send(batch: DataFrame, _: int) -> None:
        def run(frames):
            for frame in frames:
                for a in range(0, len(frame), limit):
                    if not post(frame.iloc[a : a + limit].to_dict("records")):
                        raise RuntimeError("not accepted")
                yield frame.iloc[:0]

        batch.mapInPandas(run, batch.schema).count()

    return send
