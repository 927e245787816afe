"""Tensors of safetensors files, read in slices: the header names where each one lies, so many tasks share a file."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.shipping import ship_code
from .ledger import open_filesystem

#: Values of a slice, and of a batch of rows.
SLICE, BATCH = 1 << 24, 1 << 20
#: Bytes and numpy type of a value of each type; BF16 is the upper half of a 32-bit number.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}


def numbers(raw: bytes, kind: str):
    """The values of a stretch of a tensor, as 64-bit floats."""
    import numpy as np

    values = np.frombuffer(raw, KINDS[kind])
    if kind == "BF16":
        values = (values.astype(np.uint32) << 16).view(np.float32)
    return values.astype(np.float64)


def layout(head: bytes) -> list[tuple[str, str, int, int]]:
    """(key, type, begin, end) of the tensors of a header; places are those behind it."""
    found = []
    for key, about in json.loads(head).items():
        if key != "__metadata__":
            if about["dtype"] not in KINDS:
                raise ValueError(f"type {about['dtype']} of {key}")
            found.append((key, about["dtype"], *about["data_offsets"]))
    return found


class Slice(InputPartition):
    """Bytes begin to end of a file are values of a tensor, the first of which has the given idx."""

    def __init__(self, path: str, key: str, kind: str, begin: int, end: int, idx: int):
        self.path, self.key, self.kind, self.begin, self.end, self.idx = path, key, kind, begin, end, idx


def slices(path: str, head: bytes, most: int) -> list[Slice]:
    import numpy as np

    base = 8 + len(head)
    out = []
    for key, kind, begin, end in layout(head):
        size = np.dtype(KINDS[kind]).itemsize
        for at in range(begin, end, most * size):
            out.append(Slice(path, key, kind, base + at, base + min(end, at + most * size), (at - begin) // size))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("slice", SLICE))

    def partitions(self) -> list[Slice]:
        from pyarrow import fs

        system, path = open_filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        found = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.base_name.endswith(".safetensors"):
                with system.open_input_file(f.path) as raw:
                    (size,) = struct.unpack("<Q", raw.read(8))
                    found += slices(f.path, raw.read(size), self.most)
        return found

    def read(self, partition: Slice) -> Iterator:
        import numpy as np
        import pyarrow as pa

        system, _ = open_filesystem(self.path)
        width = BATCH * np.dtype(KINDS[partition.kind]).itemsize
        with system.open_input_file(partition.path) as raw:
            idx = partition.idx
            for at in range(partition.begin, partition.end, width):
                values = numbers(raw.read_at(min(width, partition.end - at), at), partition.kind)
                keys = pa.array([partition.key], pa.string()).take(pa.array(np.zeros(len(values), np.int64)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(idx, idx + len(values))), pa.array(values)], names=["key", "idx", "value"])
                idx += len(values)


class Tensors(DataSource):
    """Rows (key, idx, value) of a file or of the .safetensors files of a folder, flattened in row-major order."""

    @classmethod
    def name(cls) -> str:
        return "sliced_tensors"

    def schema(self) -> str:
        return "key string, idx long, value double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def sliced_tensors(spark: SparkSession, path: str, most: int = SLICE) -> DataFrame:
    """(key, idx, value) of safetensors files of any size: a task reads ``most`` values of one tensor, and no more. The
    driver reads the headers. The path is local to all machines, or of a store that pyarrow opens."""
    ship_code(spark)
    spark.dataSource.register(Tensors)
    return spark.read.format(Tensors.name()).option("slice", most).load(path)
