"""Calls of an external model: the client is injected, so plans and tests need no network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERLOAD = ("429", "resource_exhausted", "overloaded")


def complete(client: Callable[[str], str], prompt: str, attempts: int = 5, delay: float = 2.0, overload_delay: float = 60.0, sleep=time.sleep) -> str | None:
    """The completion, if it is JSON; None after that many failures. Waits grow with each attempt."""
    for attempt in range(attempts):
        try:
            text = client(prompt)
            json.loads(text)
            return text
        except Exception as error:  # the client may raise anything
            busy = any(word in str(error).lower() for word in OVERLOAD)
            if attempt + 1 < attempts:
                sleep((overload_delay if busy else delay) * (attempt + 1))
    return None


def completions(prompts: DataFrame, key: str, prompt: str, make_client: Callable[[], Callable[[str], str]], **options) -> DataFrame:
    """(key, completion): one client per task; failed prompts keep their row with a null."""
    key_type = prompts.schema[key].dataType.simpleString()

    def run(batches):
        client = make_client()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "completion": [complete(client, p, **options) for p in batch[prompt]]})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {key_type}, completion string")


def batches(rows: DataFrame, order: str, value: str, size: int) -> DataFrame:
    """Rows of ``size`` values each, in order; ``order`` is a dense ordinal from 0."""
    grouped = rows.groupBy(F.floor(F.col(order) / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_v"))
    return grouped.select("batch", F.transform("_v", lambda x: x[value]).alias("values"))


def flattened(rows: DataFrame, column: str, item: str) -> DataFrame:
    """A JSON array of objects as rows; text that is no such array gives none."""
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.inline(F.from_json(column, f"array<struct<{item}>>")))
