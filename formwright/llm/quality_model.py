"""A quality classifier: histogram gradient-boosted trees over statistics of a text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import utf8

#: Byte classes that are counted.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#*$%&<>",
    "bracket": b"()[]{}\"'=_/\\@",
}
_ONE_HOT = np.zeros((256, len(_CLASSES) + 1))
for _i, _c in enumerate(_CLASSES.values()):
    _ONE_HOT[list(_c), _i] = 1
_ONE_HOT[128:, len(_CLASSES)] = 1
FEATURES = (*_CLASSES, "other", "bytes", "words", "lines", "word_length", "distinct", "longest", "same_as_before", "distinct_lines", "capital_words", "commonest", "line_words")


def features(text: bytes) -> list[float]:
    """Statistics of a whole text; an empty one gives zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _ONE_HOT / n
    words = text.split()
    lines = text.split(b"\n")
    k = len(words)
    seen: dict[bytes, int] = {}
    before, same = b"", 0
    for w in words:
        seen[w] = seen.get(w, 0) + 1
        same += w == before
        before = w
    longest = max(map(len, seen), default=0)
    capital = sum(c for w, c in seen.items() if w.isupper())
    return [*counts.tolist(), math.log1p(n), math.log1p(k), math.log1p(len(lines)), sum(map(len, words)) / max(k, 1), len(seen) / max(k, 1), longest, same / max(k, 1), len(set(lines)) / len(lines), capital / max(k, 1), max(seen.values(), default=0) / max(k, 1), k / len(lines)]


@dataclass
class Trees:
    """All trees in flat arrays: a node's feature (-1: leaf), threshold, and left child; the right one follows it."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Every row walks every tree, one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while len(x):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(inner, self.child[at] + right, at)
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, least_rows: int = 10, damp: float = 1.0) -> Trees:
    """Log-loss boosting; splits come from histograms of gradients over quantile bins, level by level."""
    n, d = x.shape
    p = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    base = math.log(p / (1 - p))
    feature, threshold, child, value, roots = [], [], [], [], []
    if not n or y.min() == y.max():
        return Trees(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    width = max(map(len, cuts)) + 1
    raw = np.full(n, base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), child.append(0), value.append(0.0)
        node = np.full(n, roots[-1])
        level = [roots[-1]]
        for deep in range(depth + 1):
            local = np.full(len(feature), -1)
            local[level] = np.arange(len(level))
            of = local[node]
            rows = np.flatnonzero(of >= 0)
            k = len(level)
            sums = np.zeros((3, k, d, width))
            for j in range(d):
                key = of[rows] * width + binned[rows, j]
                for s, w in enumerate((g[rows], h[rows], None)):
                    sums[s, :, j] = np.bincount(key, w, minlength=k * width).reshape(k, width)
            total = sums[:, :, 0].sum(-1)
            for i, name in enumerate(level):
                value[name] = -rate * total[0, i] / (total[1, i] + damp)
            if deep == depth:
                break
            left = sums.cumsum(-1)
            right = total[:, :, None, None] - left
            gain = left[0] ** 2 / (left[1] + damp) + right[0] ** 2 / (right[1] + damp) - (total[0] ** 2 / (total[1] + damp))[:, None, None]
            gain = np.where((left[2] >= least_rows) & (right[2] >= least_rows), gain, -1)
            new = []
            for i, name in enumerate(level):
                j, b = divmod(int(gain[i].argmax()), width)
                if gain[i, j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                feature[name], threshold[name], child[name] = j, float(cuts[j][b]), len(feature)
                for _side in range(2):
                    new.append(len(feature))
                    feature.append(-1), threshold.append(0.0), child.append(0), value.append(0.0)
                here = node == name
                node[here] = child[name] + (binned[here, j] > b)
            if not new:
                break
            level = new
        raw += np.array(value)[node]
    return Trees(np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(roots), base)


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    start, end, data = utf8(batch.column(column))
    return np.array([features(bytes(data[s:e])) for s, e in zip(start.tolist(), end.tolist(), strict=True)]).reshape(-1, len(FEATURES))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most_rows: int = 8000, **settings) -> Trees:
    """Fit on at most ``most_rows`` labelled documents (those with the smallest hash of the id; ids labelled twice count
    twice, and of more rows with these ids than that, ``most_rows`` are used). labels may be restricted before the call; null labels and ids are left out. Only this bounded list of
    ids is broadcast, and only its documents' statistics reach the driver."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("label"))
    picked = usable.orderBy(F.xxhash64("_id"), "_id", "label").limit(most_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "_id").select("label", "text").mapInArrow(_features, "label double, x binary").orderBy(F.xxhash64("label", "x"), "label", "x").limit(most_rows).collect()
    rows.sort(key=lambda r: (r.label, bytes(r.x)))  # the same model whatever the order of the tasks
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label for r in rows]), **settings)


def scored(docs: DataFrame, model: Trees, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) per row of docs; null and empty texts are scored on zeros."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                p = model.probability(_matrix(batch, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, score double, predicted int")
