"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators. Its words are reduced to shapes (runs of upper case, lower case, digits and each
other character, with a mark where a word equals the one before; a word of over eight runs gives several shapes, so
that all of it takes part); n-grams of one to three shapes are present if they
occur at all, and present again for each of some shares of all n-grams that they reach, so that junk in a part of a
text shows. Indicators are scaled by the classes' log-count ratios, and a linear hinge-loss model is fitted to them by
dual coordinate descent; a logistic curve, fitted on rows set apart, turns margins into scores from 0 to 1.

The model is fitted on at most ``MAX_TRAIN`` labelled rows, the first by a hash of the id; this bound is a parameter.
Rows with crc32(id as text) mod 5 = 0 are held out and never learned from. Scoring reads every whole text.

Defined cases: a null or empty text has one indicator of its own and gets a score; rows without a label are scored
only; a null id counts as not held out and has no label; rows that repeat are scored each; very long texts are read
whole; of ids that repeat among the labels the larger label counts; with labels of one class only (or none) every text
gets the share of that class (or 0.5); an empty table gives an empty table. Only the id and the text are read of the
documents, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

MAX_TRAIN = 6000
DIMENSIONS = 1 << 18
SHARES = (0.01, 0.03, 0.1, 0.3, 0.6)
THRESHOLD = 0.3
FOLDS = 5

_RUNS = re.compile(r"([A-Z]+)|([a-z]+)|([0-9]+)|(.)", re.S)
_shapes: dict[str, list[str]] = {}
#: Runs in one part of a word, and characters of the longest word whose shapes are kept.
PART, KNOWN = 8, 64


def shapes_of(word: str) -> list[str]:
    """Runs of upper case as X, of lower case as x, of digits as 9, and other characters once a run, of the whole word;
    consecutive parts of eight runs."""
    found = _shapes.get(word)
    if found is None:
        out: list[str] = []
        for m in _RUNS.finditer(word):
            c = "Xx9"[m.lastindex - 1] if m.lastindex < 4 else ("X" if m[4].isupper() else "x" if m[4].isalpha() else m[4])
            if not out or out[-1] != c:
                out.append(c)
        found = ["".join(out[k : k + PART]) for k in range(0, len(out), PART)]
        if len(word) <= KNOWN:
            if len(_shapes) > 100_000:
                _shapes.clear()
            _shapes[word] = found
    return found


def indicators(text: str) -> np.ndarray:
    """Numbers of the indicators that hold for a text."""
    words = text.split()
    if not words:
        return np.array([0], dtype=np.int32)
    shapes = list(shapes_of(words[0]))
    for a, b in zip(words[1:], words, strict=False):
        shapes += [s + "=" for s in shapes_of(a)] if a == b else shapes_of(a)
    present = set()
    for run in (shapes, list(zip(shapes, shapes[1:])), list(zip(shapes, shapes[1:], shapes[2:]))):
        total = len(run)
        for gram, n in Counter(run).items():
            name = " ".join(gram) if isinstance(gram, tuple) else gram
            code = zlib.crc32(name.encode("utf-8", "replace"))
            present.add(1 + code % (DIMENSIONS - 1))
            share = n / total
            for k, least in enumerate(SHARES):
                if share < least:
                    break
                present.add(1 + (code * 31 + 7919 * (k + 1)) % (DIMENSIONS - 1))
    return np.array(sorted(present), dtype=np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, present: np.ndarray) -> float:
        return float(self.weights[present].sum()) / math.sqrt(len(present)) + self.bias

    def score(self, present: np.ndarray) -> float:
        z = max(-30.0, min(30.0, self.slope * self.margin(present) + self.shift))
        return 1 / (1 + math.exp(-z))


def descend(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on scaled indicators (rows of unit scale, a bias as one more)."""
    scaled = [ratios[r] / math.sqrt(len(r)) for r in rows]
    diagonal = np.array([s @ s + 1 for s in scaled])
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    upper = np.where(signs > 0, cost, cost * (signs > 0).sum() / max(1, (signs < 0).sum()))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (w[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), upper[i])
            if (step := new - alpha[i]) != 0:
                np.add.at(w, rows[i], step * signs[i] * scaled[i])
                bias += step * signs[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * ratios, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margins to shares of label 1, by Newton steps on smoothed labels."""
    ones = labels.sum()
    wanted = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x, at = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - wanted) + 1e-3 * at)
        at = at - step
        if abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 15) -> Model:
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        odds = math.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(np.zeros(DIMENSIONS), 0.0, 0.0, odds)

    def model(some: np.ndarray) -> tuple[np.ndarray, float]:
        counts = {y: np.ones(DIMENSIONS) for y in (0, 1)}
        for i in some:
            counts[int(labels[i])][rows[i]] += 1
        ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        return descend([rows[i] for i in some], np.where(labels[some] == 1, 1.0, -1.0), ratios, cost, epochs)

    apart = np.zeros(len(rows), dtype=bool)
    for y in (0, 1):
        apart[np.flatnonzero(labels == y)[::4]] = True
    w, bias = model(np.flatnonzero(~apart)) if len(set(labels[~apart].tolist())) == 2 else model(np.arange(len(rows)))
    draft = Model(w, bias, 1.0, 0.0)
    slope, shift = logistic(np.array([draft.margin(rows[i]) for i in np.flatnonzero(apart)]), labels[apart])
    return Model(*((w, bias) if slope > 0 else model(np.arange(len(rows)))), max(slope, 1e-3), shift)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int, id_col: str, text_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of at most ``max_train`` labelled rows that are not held out."""
    learned = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .filter("_id is not null and _label in (0, 1)")
        .filter(F.crc32(F.col("_id").cast("string").cast("binary")) % FOLDS != 0)
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_train)
    )
    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(learned), "_id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            present = [indicators(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(present, pa.list_(pa.int32()))], names=["id", "label", "present"])

    rows = found.select("_id", "_text", "_label").mapInArrow(tidied(run), "id long, label int, present array<int>").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["present"]))
    return [np.array(r["present"], dtype=np.int32) for r in rows], np.array([r["label"] for r in rows], dtype=np.int64)


def score_quality(
    docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on)."""
    model = fit(*training_rows(docs, labels, max_train, id_col, text_col))
    used = np.flatnonzero(model.weights).astype(np.int32)
    values = model.weights[used]
    bias, slope, shift = model.bias, model.slope, model.shift

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(DIMENSIONS)
        weights[used] = values
        own = Model(weights, bias, slope, shift)
        for part in parts:
            ids = part.column(0).to_pylist()
            scores = np.array([own.score(indicators(t or "")) for t in part.column(1).to_pylist()], dtype=np.float64)
            held = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids]
            predicted = (scores >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.bool_()), pa.array(scores), pa.array(predicted)], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")
