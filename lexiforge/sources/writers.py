"""Writers: JSON lines, text lines, CSV, metadata, LaTeX tables, append logs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def write_json_rows(rows: DataFrame, path: str, files: int | None = None, **constants: str) -> None:
    """JSON lines; null fields are left out, constants tag every row. Use ``files`` for small results only."""
    for name, value in constants.items():
        rows = rows.withColumn(name, F.lit(value))
    (rows.coalesce(files) if files else rows).write.json(path)


def write_lines(rows: DataFrame, text: str, order: str, path: str) -> None:
    """Lines in order, line feeds inside them as spaces."""
    rows.orderBy(order).select(F.regexp_replace(text, r"\r?\n", " ").alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def counts_metadata(rows: DataFrame, group: str, **parameters) -> str:
    """Row counts by group, in total, and parameters, as JSON."""
    counts = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count("*")).collect()}
    return json.dumps({"counts": dict(sorted(counts.items())), "total": sum(counts.values()), **parameters}, ensure_ascii=False, indent=2)


def check_count(rows: DataFrame, expected: int) -> DataFrame:
    found = rows.count()
    if found != expected:
        raise ValueError(f"{found} rows, expected {expected}")
    return rows


def write_counted(rows: DataFrame, path: str, counters: dict[str, Column], write: Callable[[DataFrame, str], None] | None = None, expected: int | None = None, **parameters) -> str:
    """Write rows and return their counts and the parameters as JSON, from one pass: what is counted is what is written.

    counters: conditions on the rows, besides their total. Another number than ``expected`` is an error; what was
    written stays then, for inspection.
    """
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(name) for name, c in counters.items()))
    if write is None:
        counted.write.parquet(path)
    else:
        write(counted, path)
    counts = seen.get
    if expected is not None and counts["total"] != expected:
        raise ValueError(f"{counts['total']} rows, expected {expected}")
    total = counts.pop("total")
    return json.dumps({"counts": counts, "total": total, **parameters}, ensure_ascii=False, indent=2)


def _logged(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def append_new(rows: DataFrame, key: str, path: str) -> int:
    """Append rows whose key the log at ``path`` does not have yet; how many there were. One commit a batch, so a
    stopped run goes on where it was. Rows are computed once, and counted while they are written."""
    done = _logged(rows.sparkSession, path)
    new = rows if done is None else rows.join(done.select(key), key, "left_anti")
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def append_batch(rows: DataFrame, key: str, path: str, batch: int) -> int:
    """Commit a numbered batch to the log at ``path``: rows whose key no other batch has, first of equal keys by their
    content; how many there were. A batch is a partition of the log: running it again overwrites it, whether it was
    stopped or not. Writers of different batches need not wait for one another; what both write, ``read_log`` counts to
    the batch with the smaller number."""
    done = _logged(rows.sparkSession, path)
    first = rows.groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("_row")).select(key, "_row.*").select(*rows.columns)
    new = first if done is None else first.join(done.filter(F.col("batch") != batch).select(key), key, "left_anti")
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return seen.get["n"]


def read_log(spark, path: str, key: str) -> DataFrame:
    """The rows of a log of batches, each key once: that of the smallest batch number."""
    log = spark.read.parquet(path)
    place = F.row_number().over(Window.partitionBy(key).orderBy("batch"))
    return log.withColumn("_place", place).filter("_place = 1").drop("_place", "batch")


def latex_table(rows: DataFrame, columns: list[str], form: Callable[[object], str] = str) -> str:
    """A small table; missing values are --."""
    lines = [" & ".join(columns) + r" \\"]
    for r in rows.select(*columns).collect():
        lines.append(" & ".join("--" if v is None else form(v) for v in r) + r" \\")
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", *lines, r"\end{tabular}"])


def rewrite(rows: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> str:
    """Replace what is at ``path`` and keep it as ``path.bak``, whose older content goes; returns that name.

    The new rows are written beside it first, so they may be read from the path itself, and a failed write
    leaves it as it was.
    """
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    here, new, backup = fs_path(path), fs_path(f"{path}.new"), fs_path(f"{path}.bak")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(new, True)
    write(rows, str(new))
    if fs.exists(here):
        fs.delete(backup, True)
        if not fs.rename(here, backup):
            raise OSError(f"no backup of {path}")
    if not fs.rename(new, here):
        raise OSError(f"{path} could not be replaced; the new rows are in {new}")
    return str(backup)
