"""JSON Lines as sources: lenient, strict and preserving readers, transcripts, labels, files.

Transcript rows have no fixed schema (a message's content is text or an array of parts), so lines
are parsed to VARIANT and only the paths asked for are extracted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions import text


LINES = "path string, modified timestamp, line long, value string"


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl", newest_since: str | None = None, missing_ok: bool = False) -> DataFrame:
    """``path, modified, line, value``: every line that isn't blank, with its 1-based number in its file.

    Large files are read in splits.  A first pass, which reads no values into rows, counts each split's lines; the sums
    before a split are its offset, and a line's number is offset plus place.  That table (a row for each split) is
    broadcast.  Both passes plan the same splits, since these depend on the files' sizes only.  A path that isn't
    there raises, or gives no rows with ``missing_ok``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LINES)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n")
    if newest_since:
        reader = reader.option("modifiedAfter", newest_since)
    split = [F.col(f"_metadata.{c}").alias(d) for c, d in (("file_path", "path"), ("file_modification_time", "modified"), ("file_block_start", "_split"))]
    found = reader.text(path).select(*split, "value", F.monotonically_increasing_id().alias("_place"))
    splits = found.groupBy("path", "_split").agg(F.count("*").alias("n"), F.min("_place").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("path", "_split", (before - F.col("least") + 1).alias("_offset"))
    numbered = found.join(F.broadcast(offsets), ["path", "_split"])
    return numbered.select("path", "modified", (F.col("_place") + F.col("_offset")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value")).where("trim(value) <> ''")


def strict_lines(rows: DataFrame) -> DataFrame:
    """``lenient`` rows; a line that holds no object stops the job and is named as ``file:line``."""
    where = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": no JSON object"))
    return preserving(rows).withColumn("row", F.coalesce("row", F.raise_error(where).cast("variant")))


def preserving(rows: DataFrame) -> DataFrame:
    """Adds ``row``: the line as a variant, null if it doesn't parse or is no object."""
    v = F.try_parse_json("value")
    return rows.withColumn("row", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def lenient(rows: DataFrame) -> DataFrame:
    """Only lines that hold an object."""
    return preserving(rows).where("row is not null")


def strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Any bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def located_errors(rows: DataFrame) -> DataFrame:
    """``path, line, value`` of lines that hold no object."""
    return preserving(rows).where("row is null").select("path", "line", "value")


def get(path: str, row: str = "row", kind: str = "string") -> Column:
    """A path of the variant, null if it isn't there or has another type."""
    return F.try_variant_get(F.col(row), path, kind)


def content(path: str, row: str = "row") -> Column:
    """A message's content: text itself, or the texts of an array's parts, one per line."""
    parts = F.try_variant_get(F.col(row), path, "array<struct<type:string,text:string,content:string>>")
    texts = F.filter(F.transform(parts, lambda p: F.coalesce(F.nullif(p["text"], F.lit("")), p["content"])), lambda t: t.isNotNull() & (t != ""))
    whole = F.try_variant_get(F.col(row), path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(whole) == "STRING", F.try_variant_get(F.col(row), path, "string")), F.array_join(texts, "\n"), F.lit(""))


def sessions_of(rows: DataFrame) -> DataFrame:
    """Rows with ``session_id`` and ``cwd`` of the last metadata row at or above them in their file."""
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    meta = F.when(get("$.type") == "session_meta", F.struct(get("$.payload.id").alias("id"), get("$.payload.cwd").alias("cwd")))
    last = F.last(meta, ignorenulls=True).over(above)
    return rows.withColumn("_m", last).withColumns({"session_id": F.col("_m.id"), "cwd": F.col("_m.cwd")}).drop("_m")


def first_session(rows: DataFrame) -> DataFrame:
    """``path, session_id, cwd`` of the first metadata row of each file."""
    meta = rows.where(get("$.type") == "session_meta").select("path", "line", get("$.payload.id").alias("session_id"), get("$.payload.cwd").alias("cwd"))
    return meta.groupBy("path").agg(F.min_by(F.struct("session_id", "cwd"), "line").alias("m")).select("path", "m.*")


def codex_messages(rows: DataFrame) -> DataFrame:
    """User messages of transcripts with separate metadata rows."""
    wanted = (get("$.type") == "response_item") & (get("$.payload.type") == "message") & (get("$.payload.role") == "user")
    found = sessions_of(lenient(rows)).where(wanted).withColumn("text", F.btrim(content("$.payload.content")))
    return found.where(~text.is_corpus_control(F.col("text"))).select(F.lit("codex").alias("source"), "path", "line", get("$.timestamp").alias("timestamp"), "session_id", "cwd", "text")


def claude_messages(rows: DataFrame) -> DataFrame:
    """User and enqueued messages of transcripts with metadata in every row; no side chains."""
    user = (get("$.type") == "user") & ~F.coalesce(get("$.isSidechain", kind="boolean"), F.lit(False))
    queued = (get("$.type") == "queue-operation") & (get("$.operation") == "enqueue")
    body = F.when(queued, content("$.content")).otherwise(content("$.message.content"))
    found = lenient(rows.where(~F.contains("path", F.lit("/subagents/")))).where(user | queued).withColumn("text", text.without_system_instruction(body))
    return found.where(~text.is_corpus_control(F.col("text"))).select(F.lit("claude").alias("source"), "path", "line", get("$.timestamp").alias("timestamp"), get("$.sessionId").alias("session_id"), get("$.cwd").alias("cwd"), "text")


def assistant_turns(rows: DataFrame, low: int = 12, high: int = 1200, limit: int = 10_000, exclude: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Distinct assistant texts of a length, short ones first; equal lengths in the order of their first place.

    ``exclude``: a pattern (without regard to case) whose texts go, as do those that look like records or signatures.
    ``files``: only these files' rows (``path``; the newest of each root, say)."""
    if files is not None:
        rows = rows.join(files.select("path"), "path", "left_semi")
    t = text.compact(F.coalesce(F.nullif(content("$.payload.content"), F.lit("")), content("$.message.content")))
    payload = (get("$.type") == "response_item") & (get("$.payload.type") == "message") & (get("$.payload.role") == "assistant")
    message = (get("$.type") == "assistant") & (get("$.message.role") == "assistant")
    found = lenient(rows).where(payload | message).select(t.alias("text"), "path", "line").where(F.length("text").between(low, high))
    found = found.where(~F.startswith("text", F.lit("{")) & ~F.contains(F.substring("text", 1, 200), F.lit("signature")))
    if exclude:
        found = found.where(~F.col("text").rlike("(?iU)" + exclude))
    first = found.groupBy("text").agg(F.min(F.struct("path", "line")).alias("_at"))
    return first.orderBy(F.length("text") > 500, F.length("text"), "_at").limit(limit).select("text")


def points(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Events (with ``path, line``) joined to the transcript line that they point to."""
    return events.join(rows.select("path", "line", "value"), ["path", "line"], "left")


def labels(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All label files of a folder, the file's name in ``label_file``."""
    return spark.read.schema(schema).json(folder, pathGlobFilter="*.jsonl").withColumn("label_file", F.col("_metadata.file_name"))


def newest_files(spark: SparkSession, path: str, k: int = 20, since: str | None = None) -> DataFrame:
    """``path, modified, size`` of the newest files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "path").limit(k)


def snapshot(spark: SparkSession, path: str, head: int = 1 << 20, depth: int | None = None, skipped: list[str] | None = None, names: list[str] | None = None, most_bytes: int | None = None) -> DataFrame:
    """``path, modified, size, head`` of the files below a folder: the head is the SHA-256 of a file's first bytes.

    ``depth``: folders below ``path`` at most; ``skipped``: names of folders that are left out with all below;
    ``names``: patterns (SQL ``like``) one of which a file's name must match; ``most_bytes``: larger files go.
    Listing reads no contents; a task then reads the first ``head`` bytes of its files, and no more."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    below = F.slice(F.split(F.substring_index("path", root + "/", -1), "/"), 1, 1 << 20)
    folders, name = F.slice(below, 1, F.size(below) - 1), F.element_at(below, -1)
    if depth is not None:
        files = files.where(F.size(folders) <= depth)
    if skipped:
        files = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, skipped))))
    if names:
        wanted = F.lit(False)
        for pattern in names:
            wanted = wanted | name.like(pattern)
        files = files.where(wanted)
    if most_bytes is not None:
        files = files.where(F.col("size") <= most_bytes)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                store, at = pa_fs.FileSystem.from_uri(uri)
                with store.open_input_stream(at, compression=None) as stream:
                    found.append(hashlib.sha256(stream.read(head)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "head"])

    return files.mapInArrow(heads, "path string, modified timestamp, size long, head string")


def messages(rows: DataFrame) -> DataFrame:
    """Messages of both kinds of transcripts: a line is of one kind at most."""
    return codex_messages(rows).unionByName(claude_messages(rows))


def last_message(rows: DataFrame) -> DataFrame:
    """The last message of each file."""
    kept = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*kept), "line").alias("_m")).select("path", "_m.*")


def transcript_counts(rows: DataFrame) -> DataFrame:
    """Per source: files and messages."""
    return rows.groupBy("source").agg(F.countDistinct("path").alias("files"), F.count("*").alias("messages"))


def front_matter(text_column: Column) -> Column:
    """The keys and values between two lines of dashes at the start of a text."""
    block = F.regexp_extract(text_column, r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda line: F.contains(line, F.lit(":")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)), F.trim(F.regexp_replace(p, r"^[^:]*:", "")))))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """``term``: one lower-case ASCII word per line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where(F.col("term").rlike("^[a-z]+$")).distinct()


def model(spark: SparkSession, path: str) -> DataFrame:
    """A model's terms as written by the sink; rows that lack a term or a number go."""
    rows = spark.read.schema("section string, term string, idf double, coef double").json(path)
    return rows.where("term is not null and idf is not null and coef is not null")
