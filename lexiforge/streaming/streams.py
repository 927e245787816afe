"""Streaming forms: stateless operators run unchanged on streams; keyed ones bound their state by a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.shipping import ship_code
from ..operators import cleaning, dedup


def cleaned(stream: DataFrame, **rules) -> DataFrame:
    return cleaning.clean_documents(stream, **rules)


def first_within(stream: DataFrame, time: str, delay: str, text: str) -> DataFrame:
    """The first row of equal texts (by normalised key) within the watermark."""
    keyed = stream.withColumn("_key", F.sha2(dedup.text_key(text), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def append_unseen(key: str, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows whose key the table does not have; running a batch again adds nothing."""
    from ..sources.writers import append_new

    def sink(batch: DataFrame, _: int) -> None:
        append_new(batch.dropDuplicates([key]), key, path)

    return sink


def session_counts(stream: DataFrame, time: str, delay: str, gap: str, *keys: str) -> DataFrame:
    """(start, end, keys, n): rows of a key that follow one another within ``gap`` are a session."""
    counted = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("_s"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), *keys, "n")


#: What is kept of a run between batches: losses seen last, the best one, how often it was not beaten, whether that was
#: too often. And its rows that the watermark has not passed.
_PROGRESS = "last_loss double, last_eval double, best double, stale int, stopped boolean"
_WAITING = "at long, step long, loss double, eval_loss double"
MONITORED = "run string, step long, last_loss double, last_eval double, gap double, stale int, stopped boolean"


class _Monitor(StatefulProcessor):
    """Rows wait until the watermark passes them, and are then read in the order of their steps."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _PROGRESS)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new, times = [], set()
        for batch in rows:
            for r in batch.itertuples(index=False):
                at = int(r.at.timestamp() * 1000)
                if at > passed:  # later ones than that are too late
                    new.append((at, int(r.step), _number(r.loss), _number(r.eval_loss)))
                    times.add(at)
        if new:
            self.waiting.appendList(new)
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] <= until), key=lambda r: r[1])
        if not due:
            return
        rest = [tuple(r) for r in held if r[0] > until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        loss, evaluated, best, stale, stopped = self.progress.get() if self.progress.exists() else (None, None, None, 0, False)
        out = []
        for _, step, now, now_eval in due:
            if stopped:
                break
            loss = now if now is not None else loss
            if now_eval is not None:
                evaluated = now_eval
                better = best is None or now_eval < best
                best, stale = (now_eval, 0) if better else (best, stale + 1)
                stopped = stale >= self.patience
            gap = None if loss is None or evaluated is None else evaluated - loss
            out.append((key[0], step, loss, evaluated, gap, stale, stopped))
        self.progress.update((loss, evaluated, best, stale, stopped))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MONITORED.split(", ")])

    def close(self) -> None:
        pass


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def monitored(stream: DataFrame, run: str, time: str, step: str, loss: str, eval_loss: str, delay: str, patience: int) -> DataFrame:
    """Training logs as they come: of each run and step the losses seen last, their gap, how many evaluations in a row have
    not been better than the best one, and whether that stops the run; nothing follows the row that stops it.

    Rows of a run are read in the order of their steps among those of one time, and in the order of time otherwise, once
    the watermark (``delay`` behind the newest row) has passed them; rows that come later than that are dropped. State
    is a few numbers a run, and its rows of the last ``delay``. Needs the RocksDB state store.
    """
    ship_code(stream.sparkSession)
    slim = stream.select(F.col(run).cast("string").alias("run"), F.col(time).alias("at"), F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss"), F.col(eval_loss).cast("double").alias("eval_loss"))
    keyed = slim.filter("run IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay).groupBy("run")
    return keyed.transformWithStateInPandas(_Monitor(patience), MONITORED, "append", "eventTime")
