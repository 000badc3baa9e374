"""Quality rules: document statistics, fixed limits, and gradient-boosted trees with monotonic constraints.

One pass per text gives the statistics. The fixed rules fail a text with fewer than ``LEAST_WORDS`` words or with more than a fifth of
its words in repeated ``WINDOW``-word windows. What passes is judged by boosted regression trees on the
logistic loss, fitted on at most ``FIT_ROWS`` labelled documents (the smallest by a hash of the id, outside the held-out fifth).
Features in ``FALLING`` may only lower the verdict as they grow. The trees are flattened into node arrays, so that scoring
walks all rows down one level per step.

Null and empty texts have no words and fail. With one class among the labels every verdict is that class. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from talkmetry.llm.common import arrow_map, texts, words
from talkmetry.llm.quality import held_out

LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
FIT_ROWS = 12_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 80, 3, 0.2, 48, 20, 1.0
THRESHOLD = 0.3
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "distinct_share", "words_per_line", "stop_share", "bang_share", "same_next_share")
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "bang_share", "same_next_share")
_KIND = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _KIND[_b] = (
        1 if 0x80 <= _b < 0xC0 else 2 if _b == 0x20 or 0x09 <= _b <= 0x0D else 3 if _b in SYMBOLS else 4 if 65 <= _b <= 90
        else 5 if 48 <= _b <= 57 else 6 if _b == 33 else 7 if _b in b".,;" else 0
    )


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rolling = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    if len(np.unique(rolling)) == n:  # different hashes: different windows
        return 0
    code = ids[:n].astype(np.int64)
    for k in range(1, window):  # exact: renumber the windows so far, then add a word
        code = np.unique(code, return_inverse=True)[1] * (int(ids.max()) + 1) + ids[k : k + n]
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    hit = np.zeros(len(ids) + 1, dtype=np.int64)
    start = np.flatnonzero(count[back] > 1)
    np.add.at(hit, start, 1)
    np.add.at(hit, start + window, -1)
    return int((np.cumsum(hit) > 0).sum())


def statistics(text: bytes | None) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the features."""
    text = text or b""
    tokens = words(text)
    n = len(tokens)
    count = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=8) if text else np.zeros(8, dtype=np.int64)
    chars = len(text) - int(count[1] + count[2])
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = filled = 0
    for x in lines:
        if x in seen:
            dup += bool(x.strip())
        seen.add(x)
        filled += bool(x.strip())
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in tokens], dtype=np.int64)
    repeats = repeated_words(ids)
    total, some = max(chars, 1), max(n, 1)
    again = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    features = np.array([np.log1p(n), chars / some, count[3] / total, dup / max(filled, 1), repeats / some, count[4] / total, count[5] / total,
                         len(index) / some, n / max(filled, 1), count[7] / some, count[6] / some, again / some])
    return (n, chars, int(count[3]), dup, repeats), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


@dataclass
class Forest:
    """Trees one behind the other in arrays; a leaf points at itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, label: np.ndarray, falling: tuple[int, ...] = tuple(FEATURES.index(f) for f in FALLING)) -> Forest:
    """Boosted trees on binned features. A split on a constrained feature must not give its upper side the larger value,
    and the middle of the two values bounds everything below either side."""
    y = (np.asarray(label) > 0).astype(float)
    nodes: list[list[float]] = []
    roots: list[int] = []
    good = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    start = float(np.log(good / (1 - good)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if len(x) else x.astype(int)
    margin = np.full(len(y), start)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + RIDGE), low, high))

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = gradient[rows], curve[rows]
        me = len(nodes)
        value = leaf(g.sum(), h.sum(), low, high)
        nodes.append([0, 0.0, me, me, RATE * value])
        best = None
        if depth and len(rows) >= 2 * LEAST_LEAF:
            gain_at = lambda gs, hs, v: -(gs * v + 0.5 * (hs + RIDGE) * v * v)
            base = gain_at(g.sum(), h.sum(), value)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(c) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                lv = np.clip(-gs / (hs + RIDGE), low, high)
                rv = np.clip(-(g.sum() - gs) / (h.sum() - hs + RIDGE), low, high)
                gain = gain_at(gs, hs, lv) + gain_at(g.sum() - gs, h.sum() - hs, rv) - base
                bad = (ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)
                if f in falling:
                    bad |= rv > lv
                gain[bad] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (float(gain[k]), f, k, float(lv[k]), float(rv[k]))
        if best is None:
            margin[rows] += RATE * value
            return me
        _, f, k, lv, rv = best
        middle = (lv + rv) / 2
        side = binned[rows, f] <= k
        bounds = ((max(low, middle), high), (low, min(high, middle))) if f in falling else ((low, high), (low, high))
        nodes[me][:2] = [f, float(cuts[f][k])]
        nodes[me][2] = grow(rows[side], depth - 1, *bounds[0])
        nodes[me][3] = grow(rows[~side], depth - 1, *bounds[1])
        return me

    if 0 < y.sum() < len(y):
        for _ in range(TREES):
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))
            gradient, curve = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(grow(np.arange(len(y)), DEPTH, -np.inf, np.inf))
    flat = np.array(nodes, dtype=float).reshape(-1, 5)
    return Forest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, dtype=int), DEPTH, start)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(fit_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows rows of two numbers

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": [statistics(t)[1].tobytes() for t in texts(batch.column("text"))]}

    got = arrow_map(sample, rows, "doc_id long, quality int, x binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=float).reshape(-1, len(FEATURES))[order]
    return fit(x, got.column("quality").to_numpy()[order])


def judge(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five statistics, base_failed, verdict (the trees' score) and kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES * 2 ** (DEPTH + 1) nodes at most
    schema = StructType.fromDDL("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, verdict double, kept boolean")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [statistics(t) for t in texts(batch.column("text"))]
            base = np.array([g[0] for g in got], dtype=np.int64)
            failed = np.array([base_failed(int(r[0]), int(r[4])) for r in base])
            score = shared.value.score(np.stack([g[1] for g in got]))
            columns = [batch.column("doc_id"), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def rule_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, labels))
