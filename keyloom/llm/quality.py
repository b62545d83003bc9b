"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text (``STATS``); ids, sources, languages and labels are never among them. The trees are
grown in numpy on at most ``SAMPLE`` labelled rows (those with the least hashes of their ids, a documented bound), level
by level: statistics are put in ``BINS`` quantile bins, one histogram of gradients and one of curvatures hold all
(node, statistic, bin) cells, and the best cut of each node maximises the usual second-order gain. All trees are then
flattened into five arrays, and a batch of rows walks all trees at once.

Defined cases: null text is empty and gets a score like any other; labels of one id that differ are averaged, null labels
are ignored; without labelled rows every score is 0.5; a null id is not held out; repeated rows give repeated results;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import texts

SAMPLE = 20_000
BINS = 48
TREES, DEPTH = 80, 4
RATE, L2, LEAST_ROWS = 0.15, 1.0, 8
THRESHOLD = 0.3
FOLDS = 5
#: Rows whose texts are scored at once.
SLICE = 2048

STATS = "log_chars log_words word_length upper digits symbols stops marks non_latin spaces same_next distinct top_word line_length same_lines short_words long_words ends_odd".split()

_CHAR = [chr(i) for i in range(256)]
_CLASS = np.array(
    [
        [c.isupper() for c in _CHAR] + [False],
        [c.isalpha() for c in _CHAR] + [True],
        [c.isdigit() for c in _CHAR] + [False],
        [not (c.isalnum() or c.isspace() or c in ".,") for c in _CHAR] + [False],
        [c in ".," for c in _CHAR] + [False],
        [c in "!?" for c in _CHAR] + [False],
        [c.isspace() for c in _CHAR] + [False],
        [False] * 256 + [True],
    ],
    np.float64,
)


def statistics(text: str) -> list[float]:
    """The values of ``STATS`` for one text."""
    n = len(text)
    words = text.split()
    m = len(words)
    kinds = np.zeros(257)
    for i in range(0, n, 1 << 20):
        kinds += np.bincount(np.minimum(np.frombuffer(text[i : i + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32), 256), minlength=257)
    upper, letters, digits, symbols, stops, marks, spaces, beyond = _CLASS @ kinds
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    chars, total = max(n, 1), max(m, 1)
    sizes = Counter(map(len, words))
    return [
        math.log1p(n),
        math.log1p(m),
        (n - spaces) / total,
        upper / max(letters, 1),
        digits / chars,
        symbols / chars,
        stops / chars,
        marks / chars,
        beyond / chars,
        spaces / chars,
        sum(map(operator.eq, words, words[1:])) / total,
        len(counts) / total,
        max(counts.values(), default=0) / total,
        math.log1p(n / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(c for k, c in sizes.items() if k <= 3) / total,
        sum(c for k, c in sizes.items() if k > 12) / total,
        sum(c for w, c in counts.items() if not (w[-1].isalnum() or w[-1] in ".,")) / total,
    ]


class Trees:
    """Boosted trees as flat arrays: a node's statistic (-1: leaf), cut, left child (the right one follows) and value."""

    def __init__(self, base: float) -> None:
        self.base = base
        self.roots: list[int] = []
        self.stat, self.cut, self.left, self.value = (np.empty(0, k) for k in (np.int32, np.float64, np.int32, np.float64))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.roots or not len(x):
            return out
        at = np.repeat(np.array(self.roots, np.int32)[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            stat = self.stat[at]
            inner = stat >= 0
            right = x[row, np.maximum(stat, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return out + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Fit boosted trees with logistic loss to statistics ``x`` and labels ``y`` (0 to 1)."""
    if not len(y):
        return Trees(0.0)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(math.log(mean / (1 - mean)))
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1)  # x <= cut goes left
    cell = binned + np.arange(k) * BINS
    margin = np.full(n, model.base)
    nodes: list[list[float]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root = len(nodes)
        nodes.append([-1, 0.0, -1, 0.0])
        level, where = [root], np.zeros(n, np.int64)  # each row's place in the level, -1 once in a leaf
        for depth in range(DEPTH + 1):
            live = where >= 0
            width = len(level)
            if not width:
                break
            idx = (where[live, None] * (k * BINS) + cell[live]).ravel()
            shape = (width, k, BINS)
            sums = [np.bincount(idx, weights=np.repeat(v[live], k), minlength=width * k * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            G, H, N = (s[:, :1, -1:] for s in sums)
            gl, hl, nl = (s[:, :, :-1] for s in sums)
            gain = gl**2 / (hl + L2) + (G - gl) ** 2 / (H - hl + L2) - G**2 / (H + L2)
            gain[(nl < LEAST_ROWS) | (N - nl < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            following, moved = [], np.full(n, -1)
            for i, node in enumerate(level):
                j, b = divmod(int(best[i]), BINS - 1)
                mine = where == i
                if depth == DEPTH or gain[i, j, b] <= 1e-6 or b >= len(cuts[j]):
                    nodes[node][3] = value = float(-RATE * G[i, 0, 0] / (H[i, 0, 0] + L2))
                    margin[mine] += value
                    continue
                nodes[node][:3] = [j, float(cuts[j][b]), len(nodes)]
                moved[mine] = len(following) + (binned[mine, j] > b)
                following += [len(nodes), len(nodes) + 1]
                nodes += [[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]]
            level, where = following, moved
        model.roots.append(root)
    model.stat, model.cut, model.left, model.value = (np.array([v[i] for v in nodes], t) for i, t in enumerate((np.int32, np.float64, np.int32, np.float64)))
    return model


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([statistics(t) for t in texts(b)], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted to at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(fold() != 0).groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")  # at most ``sample`` ids and labels
    got = rows.mapInArrow(_measure, "doc_id long, y double, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toPandas()
    return grow(np.array(got["x"].tolist(), np.float64).reshape(len(got), len(STATS)), got["y"].to_numpy(np.float64))


def _statistics(some: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in some], np.float64).reshape(len(some), len(STATS))


def scored(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(_statistics(texts(part))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""

    @F.pandas_udf("double")
    def score(text):
        parts = (text.iloc[i : i + SLICE] for i in range(0, len(text), SLICE))
        return _series(np.concatenate([np.empty(0), *(model.score(_statistics([t or "" for t in part])) for part in parts)]))

    return docs.where(score(F.col("text")) >= threshold)


def _series(x: np.ndarray):
    import pandas as pd

    return pd.Series(x)
