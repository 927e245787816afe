"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams that both hold, of all lengths of a blended
spectrum, over the geometric mean of what each holds (a presence kernel). Landmark texts span a Nyström
space, in which one-versus-rest kernel ridge regression is fitted. Texts are scored in batches: a
presence matrix times the landmarks' presence matrix gives kernel values, and a second product scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix64, ship_code, tidy

#: Lengths of n-grams, and the columns that they are hashed to.
NGRAMS = (1, 2, 3)
COLUMNS = 1 << 13
#: Labelled texts of each language that a model is fitted on, at most; and landmarks, at most.
TRAIN_PER_LABEL = 400
LANDMARKS = 256
RIDGE = 1e-2
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ROWS = 256
_CHARS = 1 << 20


def mark_presence(text: str, row: np.ndarray) -> None:
    """Set the columns of all n-grams of the whole text; a long text is read in overlapping stretches."""
    text = f" {_NOT_LETTERS.sub(" ", text.lower()).strip()} "
    overlap = max(NGRAMS) - 1
    for start in range(0, max(len(text) - overlap, 1), _CHARS):
        codes = np.frombuffer(text[start : start + _CHARS + overlap].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gram = np.zeros(len(codes), np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            size = len(codes) - n + 1
            if size <= 0:
                break
            gram = (gram[:size] << np.uint64(21)) | codes[n - 1 :]
            if n in NGRAMS:
                row[(mix64(gram + np.uint64(n)) >> np.uint64(51)).astype(np.int64)] = 1


assert COLUMNS == 1 << (64 - 51)


def presence(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), COLUMNS), np.float32)
    for row, text in zip(out, texts):
        if text:
            mark_presence(text, row)
    return out


@dataclass
class Model:
    """landmarks: presence of each landmark, a column each; weights: from kernel values to labels."""

    labels: list[str]
    landmarks: np.ndarray
    landmark_norms: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        norms = np.sqrt(np.maximum(rows.sum(axis=1), 1))
        return (rows @ self.landmarks) / norms[:, None] / self.landmark_norms[None, :]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel(rows) @ self.weights + self.bias


def fit(rows: np.ndarray, labels: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression in the Nyström space of evenly spread landmarks."""
    names = sorted(set(labels))
    target = np.array([[1.0 if label == name else -1.0 for name in names] for label in labels])
    by_label = [np.flatnonzero(target[:, k] > 0) for k in range(len(names))]
    share = max(1, n_landmarks // max(len(names), 1))
    chosen = np.concatenate([members[:share] for members in by_label])
    landmarks = np.ascontiguousarray(rows[chosen].T)
    norms = np.sqrt(np.maximum(landmarks.sum(axis=0), 1)).astype(np.float64)
    model = Model(names, landmarks, norms, np.zeros((len(chosen), len(names))), np.zeros(len(names)))
    between = model.kernel(rows[chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    held = values > max(values.max(), 1e-12) * 1e-6
    whiten = vectors[:, held] / np.sqrt(values[held])
    features = model.kernel(rows).astype(np.float64) @ whiten
    # languages weigh alike, however many texts each has
    weight = np.zeros(len(labels))
    for members in by_label:
        weight[members] = 1.0 / len(members)
    weight /= weight.sum()
    mean_x, mean_y = weight @ features, weight @ target
    centred = (features - mean_x) * np.sqrt(weight)[:, None]
    aim = (target - mean_y) * np.sqrt(weight)[:, None]
    solved = np.linalg.solve(centred.T @ centred + ridge * np.eye(features.shape[1]) / len(labels), centred.T @ aim)
    model.weights = whiten @ solved
    model.bias = mean_y - mean_x @ solved
    return model


#: Rows of a label that a hash of the ids picks, for each one wanted, so that enough of them have letters.
_SPARE = 2.0
_WHOLE = (1 << 63) - 1


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_label: int = TRAIN_PER_LABEL, max_labels: int = 512) -> Model | None:
    """Fit on a bounded sample: of every label, the ``per_label`` texts with letters that come first by a hash of their id.

    Rows with a null label, a null id or a text without letters teach nothing. Labels are counted first, which reads no
    texts; then about twice the rows wanted are picked by hashes of their ids, in one scan, and reduced to presence bits
    on the executors, so the driver gets a kilobyte for each sampled text, however long it is. Where too few of them
    have letters, more are picked. Of rows that repeat an id one teaches. Returns None where there is nothing to
    learn from. Labels beyond ``max_labels`` raise an error. Other columns are not looked at.
    """
    ship_code(docs.sparkSession)
    rank = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(_WHOLE)).alias("rank")
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(label_col).alias("label"), rank, F.col(text_col).alias("text"))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")

    def reduce(batches):
        for batch in batches:
            batch = batch[[bool(t and _LETTER.search(t)) for t in batch["text"]]]
            bits = [np.packbits(presence([t])[0].astype(bool)).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "rank": batch["rank"], "bits": bits})

    bounds = {label: min(_WHOLE, int(_SPARE * (per_label + 64) / n * _WHOLE)) for label, n in counts.items()}
    found: dict = {}
    while bounds:
        bound = F.create_map(*(x for label, limit in bounds.items() for x in (F.lit(label), F.lit(limit))))[F.col("label")]
        reduced = labelled.filter(F.col("rank") <= bound).mapInPandas(reduce, StructType([labelled.schema["label"], *StructType.fromDDL("rank long, bits binary")]))
        once = reduced.groupBy("label", "rank").agg(F.first("bits").alias("bits"))
        first = once.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("rank"))).filter(F.col("place") <= per_label)
        got = first.toPandas()
        found |= {label: own.sort_values("rank") for label, own in got.groupby("label")}
        # where few rows have letters, or most are copies of few, the bound was too low
        bounds = {label: min(_WHOLE, limit * 8) for label, limit in bounds.items() if limit < _WHOLE and len(found.get(label, ())) < per_label}
    if not found:
        return None
    sample = pd.concat([found[label] for label in sorted(found)])
    rows = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in sample["bits"]]).astype(np.float32)
    return fit(rows, list(sample["label"]))


def _parts(batch: pa.RecordBatch):
    """A batch in parts that one matrix product scores."""
    for at in range(0, batch.num_rows, _ROWS):
        yield batch.slice(at, _ROWS)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add lang_pred and lang_score (0 to 1) to every row of docs.

    A null text, one without a letter, or a missing model gives ``und`` with score 0. The score is the
    share of the best label after a softmax of the regression values; of labels that score alike, the first by
    name is given. Whole texts are read, however long. Repeated rows get the same answer, an empty table gives
    no rows. Columns of docs that have the names of the results are replaced; all others pass through unchanged.
    """
    spark = docs.sparkSession
    ship_code(spark)
    held = spark.sparkContext.broadcast(model)  # bounded: landmarks x columns, labels x landmarks
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]

    def run(batches):
        model = held.value
        for batch in (part for whole in batches for part in _parts(whole)):
            labels, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(text_col).to_pylist()
            known = [i for i, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
            if known:
                values = model.scores(presence([texts[i] for i in known])).astype(np.float64)
                best = values.argmax(axis=1)
                share = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
                share = share.max(axis=1) / share.sum(axis=1)
                for i, b, s in zip(known, best, share):
                    labels[i], scores[i] = model.labels[b], s
            arrays = [batch.column(c) for c in kept] + [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "lang_pred", "lang_score"])
        tidy()

    schema = StructType([*docs.select(*kept).schema, *StructType().add("lang_pred", "string").add("lang_score", "double")])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
