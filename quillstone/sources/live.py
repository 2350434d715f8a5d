"""Sources with offsets: growing JSON Lines files as a stream, requests of a hook, and pages of a service.

They are Spark data sources: a range of a file or a page is an input partition, read on the executors; offsets are
in the query's checkpoint, so a restart goes on where the last committed batch ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillstone.functions import text

BLOCK = 1 << 16
RANGE = 64 << 20  # bytes of a file that one task reads


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


class TailReader(DataSourceStreamReader):
    """Offsets are the bytes of whole lines of every file: a line without its end waits.  A file that has become
    shorter is a new one and read from its start."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffix = options.get("suffix", ".jsonl")
        self.store, self.root = pa_fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def _whole(self, path: str, size: int, known: int) -> int:
        """The end of the last whole line between ``known`` and ``size``."""
        with self.store.open_input_file(path) as file:
            end = size
            while end > known:
                start = max(known, end - BLOCK)
                at = file.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return known

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = self.store.get_file_info(pa_fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        files = {f.path: f.size for f in found if f.is_file and f.path.endswith(self.suffix)}
        known = getattr(self, "known", {})
        self.known = {path: known[path] if known.get(path, -1) == size else self._whole(path, size, 0 if size < known.get(path, 0) else known.get(path, 0)) for path, size in files.items()}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, upto in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if begin > upto else begin
            out += [Range(path, a, min(a + RANGE, upto)) for a in range(begin, upto, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path, start, end = partition.value
        with self.store.open_input_file(path) as file:
            number, at, before = 0, 0, b"\n"
            while at < start:  # lines before the range: those that begin before it
                block = file.read_at(min(1 << 22, start - at), at)
                if not block:
                    return
                number += block.count(b"\n")
                at, before = at + len(block), block[-1:]
            if before != b"\n":  # the range begins within a line of the one before
                number += 1
                rest = b""
                while b"\n" not in rest and at < end:
                    rest = file.read_at(BLOCK, at)
                    at = at + rest.index(b"\n") + 1 if b"\n" in rest else at + len(rest)
            carried, rows = b"", []
            while at < end or carried:
                block = file.read_at(min(1 << 22, end - at) if at < end else BLOCK, at)
                if not block:
                    break
                at += len(block)
                found = (carried + block).split(b"\n")
                carried = found.pop()
                if at - len(block) >= end:  # only the line that crosses the range's end
                    found, carried = found[:1], b"" if found else carried
                for line in found:
                    number += 1
                    if line.strip():
                        rows.append((number, line.rstrip(b"\r").decode("utf-8", "replace")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([n for n, _ in rows], pa.int64()), pa.array([v for _, v in rows])], ["path", "line", "value"])
                    rows = []


class Tail(DataSource):
    """``spark.readStream.format("jsonl_tail").load(folder)``: ``path, line, value`` of lines as they are written."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, line long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Tail)
    return spark.readStream.format("jsonl_tail").load(folder)


# The fields of a hook's request.
REQUEST = "prompt string, source string, session_id string, cwd string, transcript_path string"


def requests(rows: DataFrame) -> DataFrame:
    """A hook's requests, one JSON object a line (``value``): what doesn't parse, has no prompt or is a control message is dropped."""
    found = rows.withColumn("_r", F.from_json("value", REQUEST, {"mode": "PERMISSIVE"})).where(F.get_json_object("value", "$").startswith("{"))
    found = found.select(*[c for c in rows.columns if c != "value"], "_r.*")
    return found.where((F.coalesce("prompt", F.lit("")) != "") & ~text.is_control(F.col("prompt")))


def paged(name: str, fetch: Callable[[str, int, int], tuple[list[dict], bool]], first: Callable[[str], list[dict]], splits: list[str], limit: int, page_size: int) -> type[DataSource]:
    """A data source ``split, page, partial, n, body``: a row for each page with its rows as JSON.

    ``fetch(split, offset, n)`` gives a page's rows and whether it is partial; it runs on the executors, a page a task.  If the
    first page can't be fetched ``first(split)`` is taken; any other error fails the task."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition((s, k)) for s in splits for k in range(-(-limit // page_size))]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            split, k = partition.value
            try:
                rows, partial = fetch(split, k * page_size, page_size)
            except Exception:
                if k:
                    raise
                rows, partial = first(split), True
            yield split, k, partial or len(rows) < page_size, len(rows), json.dumps(rows)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "split string, page int, partial boolean, n int, body string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Pages


def page_rows(pages: DataFrame, schema: str, limit: int) -> DataFrame:
    """The rows of pages: of each split up to its first short or partial page, ``limit`` of all splits together, split by split."""
    last = pages.where("partial").groupBy("split").agg(F.min("page").alias("last"))
    used = pages.join(last, "split", "left").where("last is null or page <= last")
    rows = used.select("split", "page", F.posexplode(F.from_json("body", f"array<struct<{schema}>>")).alias("place", "row"))
    return rows.orderBy("split", "page", "place").limit(limit).select("split", "row.*")
