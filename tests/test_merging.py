"""Merging of weights: exact selection against sorting, whole merges from files against numpy."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import merging
from lexiforge.sources import readers


def write_tensors(path, tensors):
    header, data = {}, b""
    for name, values in tensors.items():
        raw = values.astype("<f4").tobytes()
        header[name] = {"dtype": "F32", "shape": list(values.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)


@pytest.mark.parametrize("kind", ["wide", "ties", "near", "zeros"])
def test_kth_smallest_equals_sorting(spark, kind):
    rnd = random.Random(kind)
    draw = {
        "wide": lambda: rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300), "ties": lambda: float(rnd.randrange(-3, 4)),
        "near": lambda: 1.0 + rnd.randrange(50) * 2.0**-52, "zeros": lambda: rnd.choice([0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308]),
    }[kind]
    groups = {g: [draw() for _ in range(n)] for g, n in (("a", 1), ("b", 700), ("c", 333))}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").repartition(3)
    for share in (0.0, 0.2, 0.77, 1.0):
        ks = {g: max(1, round(share * len(xs))) for g, xs in groups.items()}
        got = merging.kth_smallest(rows, ["g"], F.col("x"), spark.createDataFrame(list(ks.items()), "g string, k long"))
        for r in got.collect():
            xs = sorted(groups[r.g])
            assert r.value == xs[ks[r.g] - 1] and r.below == sum(x < r.value for x in xs) and r.equal == sum(x == r.value for x in xs)
        assert got.count() == 3


def test_selection_without_window_over_tensors(spark):
    parts = spark.range(1000).selectExpr("'t' AS key", "'a' AS model", "id AS idx", "CAST(id % 7 AS DOUBLE) AS value")
    plan = merging.marked(parts, "key", "model", F.lit(0.2))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert {r.idx for r in merging.marked(parts, "key", "model", F.lit(0.2)).filter("stays").collect()} == set(sorted(range(1000), key=lambda i: (-(i % 7), i))[:200])


def numpy_merge(tensors, weights, density, scale):
    trimmed = []
    for t in tensors:
        flat = t.astype(np.float64).ravel()
        k = max(1, math.floor(len(flat) * density))
        order = np.lexsort((np.arange(len(flat)), -np.abs(flat)))
        kept = np.zeros_like(flat)
        kept[order[:k]] = flat[order[:k]]
        trimmed.append(kept)
    v = np.stack([w * t for w, t in zip(weights, trimmed)])
    sign = np.sign(v.sum(axis=0))
    mask = (np.sign(v) == sign) & (v != 0)
    held = (np.array(weights)[:, None] * mask).sum(axis=0)
    return (v * mask).sum(axis=0) / np.where(held == 0, 1, held) * scale


def test_files_to_merge(spark, tmp_path):
    rng = np.random.default_rng(3)
    one = {"layers.0.lora_A.weight": rng.normal(size=(16, 40)), "model.embed_tokens.modules_to_save.weight": rng.normal(size=(50, 8)), "model.embed_tokens.original_module.weight": rng.normal(size=(50, 8)), "lm_head.weight": rng.integers(-2, 3, size=(30, 8)).astype(float), "lm_head.lora_B.weight": rng.integers(-2, 3, size=(64, 9)).astype(float)}
    two = {name.replace(".modules_to_save", ""): rng.permutation(t.ravel()).reshape(t.shape) for name, t in one.items() if ".original_module" not in name}
    for name, tensors in (("one", one), ("two", two)):
        write_tensors(tmp_path / f"{name}.safetensors", tensors)
    models = {name: readers.tensor_rows(spark, str(tmp_path / f"{name}.safetensors")) for name in ("one", "two")}
    got = merging.merge_files(models, {"one": 0.3, "two": 0.7}, 0.2, scale=0.9).toPandas()
    one["model.embed_tokens.weight"] = one.pop("model.embed_tokens.modules_to_save.weight")
    del one["model.embed_tokens.original_module.weight"]
    assert set(got.key) == set(one)
    for key, mine in got.groupby("key"):
        density = 1.0 if key in ("model.embed_tokens.weight", "lm_head.weight") else 0.2
        expected = numpy_merge([one[key].astype("f4"), two[key].astype("f4")], [0.3, 0.7], density, 0.9)
        assert np.allclose(mine.sort_values("idx").value, expected) and len(mine) == len(expected)
    with pytest.raises(ValueError, match="lm_head.weight"):
        merging.merge_files({"one": models["one"], "two": models["two"].filter("key <> 'lm_head.weight'")}, {"one": 0.5, "two": 0.5}, 0.2)


def test_sum_without_normalising(spark):
    rows = [("k", 0, "a", 2.0), ("k", 0, "b", 4.0), ("k", 1, "a", 1.0), ("k", 1, "b", -1.0), ("k", 2, "a", -3.0)]
    parts = spark.createDataFrame(rows, "key string, idx long, model string, value double")
    got = {r.idx: r.value for r in merging.ties_merge(parts, "key", "model", F.lit(0.5), F.lit(1.0), normalise=False).collect()}
    assert got == {0: 3.0, 1: 0.0, 2: -1.5}


def test_a_file_in_slices_equals_the_whole(spark, tmp_path):
    rng = np.random.default_rng(9)
    data, header = b"", {"__metadata__": {"format": "x"}}
    kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
    expected = {}
    for kind, numpy_kind in kinds.items():
        values = (rng.normal(size=2500) * 50).astype(numpy_kind)
        header[f"t.{kind}"] = {"dtype": kind, "shape": [50, 50], "data_offsets": [len(data), len(data) + values.nbytes]}
        data += values.tobytes()
        expected[f"t.{kind}"] = values.astype(np.float64)
    halves = rng.normal(size=999).astype("<f4").view("<u4") >> 16
    header["t.BF16"] = {"dtype": "BF16", "shape": [999], "data_offsets": [len(data), len(data) + 1998]}
    data += halves.astype("<u2").tobytes()
    expected["t.BF16"] = (halves << 16).view("<f4").astype(np.float64)
    header["t.empty"] = {"dtype": "F32", "shape": [0], "data_offsets": [len(data), len(data)]}
    head = json.dumps(header).encode()
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "w.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + data)
    from lexiforge.sources import tensors

    for path in (tmp_path / "deep" / "w.safetensors", tmp_path / "deep"):
        found = tensors.sliced_tensors(spark, str(path), most=700)
        assert found.rdd.getNumPartitions() == 9 * 4 + 2
        got = found.toPandas()
        assert set(got.key) == set(expected)
        for key, own in got.groupby("key"):
            own = own.sort_values("idx")
            assert own.idx.tolist() == list(range(len(expected[key]))) and np.array_equal(own.value, expected[key])
    whole = readers.tensor_rows(spark, str(tmp_path / "deep" / "w.safetensors")).toPandas()
    assert sorted(map(tuple, whole.to_numpy().tolist())) == sorted(map(tuple, got.to_numpy().tolist()))
    (tmp_path / "deep" / "x.safetensors").write_bytes(struct.pack("<Q", 60) + json.dumps({"t": {"dtype": "Q4", "shape": [1], "data_offsets": [0, 1]}}).encode().ljust(60) + b"x")
    with pytest.raises(Exception, match="type Q4 of t"):
        tensors.sliced_tensors(spark, str(tmp_path / "deep")).count()
