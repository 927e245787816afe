"""A data source for JSON lines of crawls, compressed or not, that keeps account of damaged files."""

from __future__ import annotations

import fnmatch
import io
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.shipping import ship_code

#: Bytes that are read at a time.
_CHUNK = 1 << 20


def open_filesystem(path: str):
    """The file system of a path (a local one, or any that pyarrow opens) and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _unpacked(raw, name: str):
    """Chunks of the contents; what comes before a fault is given before the error is raised."""
    if name.endswith(".gz"):
        tool, read = zlib.decompressobj(31), False
        while chunk := raw.read(_CHUNK):
            while chunk:
                read = True
                if tool.eof:  # another member follows
                    tool = zlib.decompressobj(31)
                yield tool.decompress(chunk)
                chunk = tool.unused_data
        if read and not tool.eof:
            raise EOFError("the file ends within a compressed stream")
    elif name.endswith(".zst"):
        import zstandard

        tool, read = zstandard.ZstdDecompressor().decompressobj(), False
        while chunk := raw.read(_CHUNK):
            while chunk:
                read = True
                if tool.eof:
                    tool = zstandard.ZstdDecompressor().decompressobj()
                yield tool.decompress(chunk)
                chunk = tool.unused_data if tool.eof else b""
        if read and not tool.eof:
            raise EOFError("the file ends within a compressed stream")
    else:
        while chunk := raw.read(_CHUNK):
            yield chunk


def _lines(chunks):
    """Whole lines; a last one without line feed counts only if the contents end without a fault."""
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.jsonl*")

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, folder = open_filesystem(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)]

    def read(self, partition: _File):
        system, _ = open_filesystem(self.folder)
        n = 0
        try:
            with system.open_input_stream(partition.path, compression=None) as raw:
                for line in _lines(_unpacked(io.BufferedReader(raw), partition.path)):
                    text = line.decode("utf-8", "replace").strip()
                    if text:
                        yield partition.path, n, text, None
                    n += 1
            yield partition.path, n, None, None
        except Exception as error:  # whatever is wrong with a file is said of it, and the others go on
            yield partition.path, n, None, f"{type(error).__name__}: {error}"


class JsonLines(DataSource):
    """Rows (file, line_no, line, error): the non-blank lines of each file, and one row without a line that has the number
    of lines read and, for a damaged file, the error. Files are read one to a task."""

    @classmethod
    def name(cls) -> str:
        return "ledgered_json_lines"

    def schema(self) -> str:
        return "file string, line_no long, line string, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def crawl_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl*") -> DataFrame:
    """All lines and the accounts of all files of a folder; ``lines`` and ``ledger`` take them apart."""
    ship_code(spark)
    spark.dataSource.register(JsonLines)
    return spark.read.format(JsonLines.name()).option("pattern", pattern).load(folder)


def lines(found: DataFrame) -> DataFrame:
    """(file, line_no, line)"""
    return found.filter("line IS NOT NULL").drop("error")


def ledger(found: DataFrame) -> DataFrame:
    """(file, lines, kept, error): lines read of each file, those that are not blank, and what stopped it."""
    ends = F.col("line").isNull()
    return found.groupBy("file").agg(F.max(F.when(ends, F.col("line_no"))).alias("lines"), F.count("line").alias("kept"), F.max("error").alias("error"))
