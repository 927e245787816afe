"""Streams: late rows, restarts from a checkpoint, and batches that are run again."""

from datetime import datetime, timedelta

from lexiforge.streaming import streams

SCHEMA = "t timestamp, text string"
START = datetime(2024, 1, 1)


def put(spark, folder, name, rows):
    spark.createDataFrame([(START + timedelta(minutes=m), text) for m, text in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, folder, make, sink, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = make(stream).writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    query = (query.foreachBatch(sink) if callable(sink) else query.format("parquet").option("path", str(sink))).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_repeats_within_the_watermark_after_a_restart(spark, tmp_path):
    make = lambda s: streams.first_within(s, "t", "10 minutes", "text")
    put(spark, tmp_path / "in", "a", [(0, "Lo can"), (1, "lo  CAN"), (2, "gat")])
    run(spark, tmp_path / "in", make, tmp_path / "out", tmp_path / "state")
    put(spark, tmp_path / "in", "b", [(3, "LO can"), (4, "ostal")])
    run(spark, tmp_path / "in", make, tmp_path / "out", tmp_path / "state")
    assert sorted(r.text.lower() for r in spark.read.parquet(str(tmp_path / "out")).collect()) in (["gat", "lo  can", "ostal"], ["gat", "lo can", "ostal"])


def test_late_rows_are_not_counted(spark, tmp_path):
    make = lambda s: streams.windowed_counts(s, "t", "5 minutes", "10 minutes", "text").selectExpr("window.start AS start", "text", "n")
    put(spark, tmp_path / "in", "a", [(1, "x"), (2, "x"), (40, "y")])
    run(spark, tmp_path / "in", make, tmp_path / "out", tmp_path / "state")
    put(spark, tmp_path / "in", "b", [(3, "x"), (90, "z")])  # the window of minute 3 is closed
    run(spark, tmp_path / "in", make, tmp_path / "out", tmp_path / "state")
    put(spark, tmp_path / "in", "c", [(150, "w")])
    run(spark, tmp_path / "in", make, tmp_path / "out", tmp_path / "state")
    got = sorted((r.start, r.text, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [(START, "x", 2), (START + timedelta(minutes=40), "y", 1)]


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    sink = streams.append_unseen("text", str(tmp_path / "log"))
    batch = spark.createDataFrame([(START, "a"), (START, "a"), (START, "b")], SCHEMA)
    sink(batch, 0)
    sink(batch, 0)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["a", "b"]
    put(spark, tmp_path / "in", "a", [(0, "b"), (1, "c")])
    run(spark, tmp_path / "in", lambda s: s, sink, tmp_path / "state")
    run(spark, tmp_path / "in", lambda s: s, sink, tmp_path / "other")  # as if the checkpoint were lost
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["a", "b", "c"]


LOG = "at timestamp, run string, step long, loss double, eval_loss double"


def put_log(spark, folder, name, rows):
    spark.createDataFrame([(START + timedelta(minutes=m), *r) for m, *r in rows], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def monitor(spark, tmp_path, patience=2):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(LOG).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = streams.monitored(stream, "run", "at", "step", "loss", "eval_loss", "5 minutes", patience)
        query = found.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        query.awaitTermination(180)
        assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_monitored_run_equals_its_batch_form(spark, tmp_path):
    rows = [
        (0, "a", 0, 3.0, None), (1, "a", 1, None, 2.0), (1, "b", 0, 1.0, 1.5), (2, "a", 2, 2.5, None), (3, "a", 3, None, 1.8), (4, "b", 1, None, None), (5, "a", 4, 2.0, 1.9),
        (6, "a", 5, None, 1.85), (7, "a", 6, 1.0, 1.0), (8, "b", 2, 0.9, 1.2),
    ]
    put_log(spark, tmp_path / "in", "a", rows[:4][::-1])
    monitor(spark, tmp_path)
    put_log(spark, tmp_path / "in", "b", [rows[6], rows[4], rows[5]])  # out of order within the delay
    monitor(spark, tmp_path)
    put_log(spark, tmp_path / "in", "c", rows[7:])
    put_log(spark, tmp_path / "in", "d", [(60, "end", 0, None, None)])
    monitor(spark, tmp_path)
    put_log(spark, tmp_path / "in", "e", [(9, "b", 3, 0.1, 0.1), (61, "b", 4, 0.5, None)])  # the first is too late
    put_log(spark, tmp_path / "in", "f", [(120, "end", 1, None, None)])
    monitor(spark, tmp_path)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.run, []).append((r.step, r.last_loss, r.last_eval, None if r.gap is None else round(r.gap, 6), r.stale, r.stopped))
    expected = {}
    for run in ("a", "b"):
        loss = evaluated = best = None
        stale, stopped = 0, False
        for _, _, step, now, now_eval in sorted((r for r in rows + [(61, "b", 4, 0.5, None)] if r[1] == run), key=lambda r: r[2]):
            if stopped:
                break
            loss = now if now is not None else loss
            if now_eval is not None:
                evaluated = now_eval
                stale = 0 if best is None or now_eval < best else stale + 1
                best = now_eval if stale == 0 else best
                stopped = stale >= 2
            expected.setdefault(run, []).append((step, loss, evaluated, None if loss is None or evaluated is None else round(evaluated - loss, 6), stale, stopped))
    assert sorted(got["a"]) == expected["a"] and expected["a"][-1][0] == 5
    assert sorted(got["b"]) == expected["b"] and 3 not in [r[0] for r in got["b"]]


def test_sessions(spark, tmp_path):
    make = lambda s: streams.session_counts(s, "t", "5 minutes", "10 minutes", "text")
    put(spark, tmp_path / "in", "a", [(0, "x"), (8, "x"), (15, "x"), (2, "y")])
    run(spark, tmp_path / "in", make, tmp_path / "out", tmp_path / "state")
    put(spark, tmp_path / "in", "b", [(24, "x"), (50, "x"), (120, "z")])
    run(spark, tmp_path / "in", make, tmp_path / "out", tmp_path / "state")
    put(spark, tmp_path / "in", "c", [(300, "z")])
    run(spark, tmp_path / "in", make, tmp_path / "out", tmp_path / "state")
    minutes = lambda t: int((t - START).total_seconds() // 60)
    got = sorted((r.text, minutes(r.start), minutes(r.end), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:3] == [("x", 0, 34, 4), ("x", 50, 60, 1), ("y", 2, 12, 1)]
