"""Quality classifier: n-gram indicators scaled by class log-count ratios, a linear hinge-loss model on top.

A text becomes a set of indicators. Tokens are reduced to their shape (``Word,``, ``WORD!!``, ``word***``) because
quality shows in form, not in vocabulary; an indicator says that a shape, a pair of shapes or a repeated word makes
up a certain share of the text. Indicators are hashed to ``2**FEATURE_BITS`` columns. Each column is scaled by
``log(p / q)``, the ratio of its smoothed shares in the two classes, and a support vector machine with squared hinge
loss is fitted by dual coordinate descent. A logistic curve over the margin, fitted on the same rows, gives the score.

Null and empty texts have the one indicator "no words" and so a defined score. Labelled rows with a null label or
id are not learned from; with one class only, every score is that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from talkmetry.llm.common import arrow_map, texts, under_plain_names, words

FEATURE_BITS = 18
#: Labelled rows the model is fitted on, at most: those smallest by a hash of their id. The fit, one sequential
#: pass after another over them, is the only work that does not grow with the corpus.
FIT_ROWS = 12_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 30
THRESHOLD = 0.3
_SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9, 1.01])
#: Remembered word shapes: so many words of so many bytes at most, some 40 MB.
_MEMO, _MEMO_BYTES = 200_000, 64


def _shape(word: bytes) -> int:
    """Hash of the word's form: letters by case, digits, and other characters as they are, runs of one kind once."""
    text = word.decode("utf-8", "replace")
    out, last = [], ""
    for ch in text:
        kind = ("A" if ch.isupper() else "a") if ch.isalpha() else "0" if ch.isdigit() else ch
        if kind != last:
            out.append(kind)
            last = kind
    return xxhash.xxh3_64_intdigest("".join(out))


class Indicators:
    """Columns of a text, ascending; remembers the shapes of a fixed number of words of bounded length."""

    def __init__(self, bits: int = FEATURE_BITS):
        self._mask = np.uint64((1 << bits) - 1)
        self._known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        tokens = words(text)
        if not tokens:
            return np.zeros(1, dtype=np.int32)
        known = self._known
        if len(known) > _MEMO:
            known.clear()
        form = []
        for w in tokens:
            h = known.get(w)
            if h is None:
                h = _shape(w)
                if len(w) <= _MEMO_BYTES:
                    known[w] = h
            form.append(h)
        shape = np.array(form, dtype=np.uint64)
        again = sum(map(bytes.__eq__, tokens, tokens[1:]))
        grams = [shape, shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:]]
        found = []
        for width, gram in enumerate(grams):
            if len(gram):
                kind, count = np.unique(gram, return_counts=True)
                share = np.searchsorted(_SHARES, count / len(gram), side="left").astype(np.uint64)
                found += [_columns(kind, np.full(1, width, dtype=np.uint64)), _columns(kind, share + np.uint64(16 * (width + 1)))]
        extra = np.array([
            np.searchsorted(_SHARES, again / len(tokens), side="left"),
            64 + np.searchsorted(_SHARES, len(set(tokens)) / len(tokens), side="left"),
            128 + min(len(tokens), 1 << 20).bit_length(),
        ], dtype=np.uint64)
        found.append(_columns(extra, np.full(1, 99, dtype=np.uint64)))
        return np.unique(np.concatenate(found) & self._mask).astype(np.int32)


def _columns(kind: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = (kind ^ (salt * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int = FEATURE_BITS

    def margin(self, columns: np.ndarray) -> float:
        """Weighted mean of the indicators, so that a long text has no larger margin than a short one."""
        return float(self.weight[columns].sum() / np.sqrt(len(columns)) + self.bias)

    def score(self, columns: np.ndarray) -> float:
        z = self.slope * self.margin(columns) + self.shift
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray, bits: int, smoothing: float = SMOOTHING) -> np.ndarray:
    count = np.full((2, 1 << bits), smoothing)
    for columns, y in zip(rows, label):
        count[int(y > 0), columns] += 1.0
    share = count / count.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(rows: list[np.ndarray], value: list[np.ndarray], label: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + cost * sum(hinge^2) in its dual: one coordinate (a row's multiplier) at a time.

    The last weight is the bias, of a column that is 1 in every row. Each class counts for half of the cost.
    """
    n = len(rows)
    positive = max(1, int((label > 0).sum()))
    negative = max(1, n - int((label > 0).sum()))
    row_cost = np.where(label > 0, cost * n / (2 * positive), cost * n / (2 * negative))
    diagonal = 1.0 / (2.0 * row_cost)
    square = np.array([float(v @ v) + 1.0 for v in value]) + diagonal
    alpha, weight, bias = np.zeros(n), np.zeros(size), 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(n):
            gradient = label[i] * (float(weight[rows[i]] @ value[i]) + bias) - 1.0 + diagonal[i] * alpha[i]
            step = gradient if alpha[i] > 0 else min(gradient, 0.0)
            if step != 0.0:
                worst = max(worst, abs(step))
                new = max(alpha[i] - gradient / square[i], 0.0)
                move = (new - alpha[i]) * label[i]
                alpha[i] = new
                weight[rows[i]] += move * value[i]
                bias += move
        if worst < 1e-3:
            break
    return weight, bias


def calibrate(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (margin, label), by Newton steps with a small ridge."""
    good = int((label > 0).sum())
    bad = len(label) - good
    target = np.where(label > 0, (good + 1.0) / (good + 2.0), 1.0 / (bad + 2.0))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -40, 40)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(curve, x.T @ (target - p))
        at = at + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], label: np.ndarray, bits: int = FEATURE_BITS) -> Model:
    label = np.where(np.asarray(label) > 0, 1.0, -1.0)
    if len(rows) == 0 or abs(label.sum()) == len(rows):
        return Model(np.zeros(1 << bits), 0.0, 0.0, 40.0 * (float(np.sign(label.sum())) if len(rows) else 0.0), bits)
    ratio = log_count_ratio(rows, label, bits)
    value = [ratio[r] / np.sqrt(len(r)) for r in rows]
    weight, bias = dual_descent(rows, value, label, 1 << bits)
    model = Model(weight * ratio, bias, 1.0, 0.0, bits)
    # Margins of rows the machine has not seen are less extreme: calibrate on a second machine's unseen half.
    half = np.arange(len(rows)) % 2 == 0
    margins, labels = [], []
    for part in (half, ~half):
        seen = np.flatnonzero(part)
        if abs(label[seen].sum()) == len(seen) or not len(seen):
            continue
        r = log_count_ratio([rows[i] for i in seen], label[seen], bits)
        w, b = dual_descent([rows[i] for i in seen], [r[rows[i]] / np.sqrt(len(rows[i])) for i in seen], label[seen], 1 << bits)
        other = Model(w * r, b, 1.0, 0.0, bits)
        rest = np.flatnonzero(~part)
        margins.append(np.array([other.margin(rows[i]) for i in rest]))
        labels.append(label[rest])
    if margins:
        model.slope, model.shift = calibrate(np.concatenate(margins), np.concatenate(labels))
    return model


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fifth.

    Texts become indicator columns on the executors; the driver gets those of the bounded sample, not the texts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(fit_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows rows of two numbers

    def columns(batch: pa.RecordBatch) -> dict:
        indicators = Indicators()
        return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "columns": [indicators(t).tobytes() for t in texts(batch.column("text"))]}

    got = arrow_map(sample, columns, "doc_id long, quality int, columns binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    packed = got.column("columns").to_pylist()
    return fit([np.frombuffer(packed[i], dtype=np.int32) for i in order], got.column("quality").to_numpy()[order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the columns quality_score and quality_ok added; every row and column stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**FEATURE_BITS numbers, whatever the corpus
    names = docs.columns
    schema = docs.select("*").schema.add("quality_score", "double").add("quality_ok", "integer")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, fitted = Indicators(), shared.value
        for batch in batches:
            got = [fitted.score(indicators(t)) for t in texts(batch.column("text"))]
            value = pa.array(got, type=pa.float64())
            ok = pa.array([int(s >= threshold) for s in got], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).cast(arrow.field(n).type) for n in names), value, ok], schema=arrow)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_ok").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier accepts, with the columns of ``docs``, whatever their names."""
    return under_plain_names(docs, ("doc_id", "text"), lambda d: score(d, train(d, labels)).where("quality_ok = 1"))
