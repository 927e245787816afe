"""Shared plumbing: the shared scratch folder, stored intermediate tables, block iteration."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_code

#: Bytes of text that one numpy pass handles at a time.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and the master is local (as in tests), a
    folder of this machine. A cluster without the setting is an error: executors share no local folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lexiforge-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


#: While a table is written: delete the shuffle files of its query when that ends, and send texts to Python workers
#: in small batches, as a batch is held by the worker and, more than once, by its executor.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": f"{8 << 20}b",
}


#: All scratch folders of this process, in the order in which they were opened.
opened: list[Scratch] = []


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors. What a table was
    shuffled through is deleted as soon as it is written."""

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/lexiforge-{name}-{uuid.uuid4().hex}"
        self._n = itertools.count()
        opened.append(self)

    def store(self, df: DataFrame, name: str, *measures: Column) -> DataFrame:
        """Write df and return it as read back. Its attribute ``seen`` has the number of rows as ``n_rows``
        and the given aggregates, observed while it was written."""
        path = f"{self.root}/{next(self._n):03d}-{name}"
        seen = Observation()
        before = {name: self.spark.conf.get(name) for name in _WHILE_WRITING}
        try:
            for name, value in _WHILE_WRITING.items():
                self.spark.conf.set(name, value)
            df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *measures).write.option("compression", "zstd").parquet(path)
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored.scratch_path, stored.seen = path, seen.get
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables that nothing will read again."""
        for df in tables:
            self._delete(df.scratch_path)

    def close(self) -> None:
        """Delete all tables of this folder, which nothing will read again."""
        self._delete(self.root)
        opened.remove(self)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy() -> None:
    """Give memory that is free again back to the system, so that idle workers hold none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_blocks(ids: pd.Series, texts: pd.Series, limit: int = BLOCK_BYTES):
    """Yield (ids, utf-8 texts) whose bytes sum to about ``limit``; a longer text is a block of its own.

    Null texts become empty ones.
    """
    out_ids, out, size = [], [], 0
    for i, text in zip(ids, texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if out and size + len(raw) > limit:
            yield out_ids, out
            out_ids, out, size = [], [], 0
        out_ids.append(i)
        out.append(raw)
        size += len(raw)
    if out:
        yield out_ids, out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
