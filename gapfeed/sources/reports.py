"""Report files as lines, read in byte ranges.

`ReportLines` is a data source: it plans one partition for each range of bytes
of the files, whatever their number and size, and a range reads the lines that
begin in it. A line's position is the byte it begins at, so lines of a file are in
order over all ranges without numbering them, and what comes after (see
`operators.scans`) can work by ranges of positions too.

Lines end with \\n, \\r\\n or \\r; the last one needs no end. A line is one row, however long; bytes that
aren't UTF-8 become U+FFFD. Empty files have no lines. A folder stands for the files in it
whose names begin with neither "." nor "_"; a path with *, ? or [ stands for what
it matches. Compressed files (.gz, .bz2) are one range each.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gapfeed.shipping import ship
from gapfeed.sources.lines import to_lines

SPLIT_BYTES = 32 << 20
#: Bytes asked for at once, and rows of one batch.
READ_BYTES, BATCH_ROWS, BATCH_BYTES = 1 << 20, 10_000, 4 << 20
END = re.compile(b"\r\n|\n|\r")
COMPRESSED = {".gz": "gzip", ".bz2": "bz2"}


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the files a path stands for, in order of name."""
    system, at = open_fs(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    base = at
    if any(c in at for c in "*?["):
        parts = at.split("/")
        base = "/".join(parts[: next(i for i, p in enumerate(parts) if any(c in p for c in "*?["))]) or "/"
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(head + info.path, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    below = [f for f in found if not any(p.startswith((".", "_")) for p in f.path[len(base) :].strip("/").split("/"))]
    if base != at:
        below = [f for f in below if fnmatch.fnmatchcase(f.path, at)]
    return sorted((head + f.path, f.size) for f in below)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def plan(paths: list[str], split_bytes: int) -> list[Range]:
    out = []
    for path in paths:
        for file, size in files_of(path):
            if file.endswith(tuple(COMPRESSED)):
                out.append(Range(file, 0, None))
            else:
                out += [Range(file, a, min(size, a + split_bytes)) for a in range(0, size, split_bytes)]
    return out


def lines_in(read, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin from `start` to before `end`; `read(at, n)` gives bytes.

    The byte before a range is read with it: what comes before its first line end is the line of an earlier range.
    """
    at = place = max(0, start - 1)
    held, skip = b"", start > 0
    while True:
        more = read(at, READ_BYTES)
        while more.endswith(b"\r") and (extra := read(at + len(more), 1)):  # its \n may follow
            more += extra
        at += len(more)
        held += more
        done = 0
        for end_of in END.finditer(held):
            line_at, line = place + done, held[done : end_of.start()]
            done = end_of.end()
            if not skip:
                yield line_at, line
            skip = False
            if end is not None and place + done >= end:
                return
        held, place = held[done:], place + done
        if not more:
            if held and not skip:
                yield place, held
            return


class ReportReader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int):
        self.paths, self.split_bytes = paths, split_bytes

    def partitions(self) -> list[Range]:
        return plan(self.paths, self.split_bytes)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(part.path)
        packed = next((c for e, c in COMPRESSED.items() if path.endswith(e)), None)
        with system.open_input_stream(path, compression=packed) if packed else system.open_input_file(path) as f:

            def read(at: int, n: int) -> bytes:
                return f.read(n) if packed else f.read_at(n, at)

            where, lines, size = [], [], 0
            for at, line in lines_in(read, part.start, part.end):
                where.append(at)
                lines.append(line.decode("utf-8", "replace"))
                size += len(line)
                if len(lines) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield self._batch(part, where, lines)
                    where, lines, size = [], [], 0
            if lines:
                yield self._batch(part, where, lines)

    @staticmethod
    def _batch(part: Range, where: list[int], lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([part.start] * n, pa.int64()), pa.array(where, pa.int64()), pa.array(lines, pa.string())], names=["path", "split", "pos", "line"])


class ReportLines(DataSource):
    """spark.read.format("report_lines").option("splitBytes", n).load(path): (path, split, pos, line)."""

    @classmethod
    def name(cls) -> str:
        return "report_lines"

    def schema(self) -> str:
        return "path string, split long, pos long, line string"

    def reader(self, schema) -> ReportReader:
        paths = self.options.get("paths")
        return ReportReader(paths.split("\n") if paths else [self.options["path"]], int(self.options.get("splitBytes", SPLIT_BYTES)))


def report_lines(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, split, pos, line) of report files."""
    ship(spark)
    spark.dataSource.register(ReportLines)
    reader = spark.read.format("report_lines").option("splitBytes", split_bytes)
    return reader.load(paths) if isinstance(paths, str) else reader.option("paths", "\n".join(paths)).load()


def lines_of_files(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines (run_id, pos, line) of report files; a file is a run."""
    return report_lines(spark, paths, split_bytes).select(F.col("path").alias("run_id"), "pos", "line")


def lines_of_inputs(inputs: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines (run_id, pos, line) of inputs (run_id, input), where an input is the path of a file or a report's own text.

    An input is a path if it is one line and such a file is there (asked of one-line
    inputs only; their paths are planned by the driver, texts never come to it).
    """
    spark = inputs.sparkSession
    one_line = (F.char_length("input") < 4096) & ~F.contains("input", F.lit("\n"))
    asked = inputs.where(one_line).select("input").distinct()
    paths = [r.input for r in asked.toLocalIterator() if exists(r.input)]
    texts = to_lines(inputs.join(F.broadcast(spark.createDataFrame([(p,) for p in paths], "input string")), "input", "left_anti").select("run_id", F.col("input").alias("raw")))
    if not paths:
        return texts.select("run_id", F.col("pos").cast("long").alias("pos"), "line")
    read = report_lines(spark, paths, split_bytes).select(F.col("path").alias("input"), "pos", "line")
    named = inputs.select("run_id", "input").join(read, "input").select("run_id", "pos", "line")
    return named.unionByName(texts.select("run_id", F.col("pos").cast("long").alias("pos"), "line"))


def exists(path: str) -> bool:
    try:
        system, at = open_fs(path)
        return bool(path.strip()) and system.get_file_info(at).type == fs.FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False
