"""Quality scores by histogram gradient-boosted trees over statistics of a document's text.

Fitting sees at most ``MOST_ROWS`` labelled rows (those with the smallest hash of
their id), reduced to statistics of their texts by Spark. The trees are grown on
binned statistics level by level and flattened into arrays of fixed stride, which
numpy walks for all rows and trees at once inside the scoring tasks.

* Missing and empty texts have the statistics of an empty text and a score of
  their own; every row of the documents gets a score, repeated rows the same one.
* Several labels of one document count by their mean; missing labels are left out.
* Without labels, or with labels of one kind, the score is their smoothed share.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import crc_remainder, slices, text_of

MOST_ROWS = 20_000   # labelled rows used for fitting
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.15, 20, 1.0
ACCEPT = 0.3
STATISTICS = (
    "log_chars", "log_words", "mean_word", "symbols", "upper", "digits", "stops", "bangs", "bars", "distinct",
    "top_word", "same_as_last", "repeated_lines", "line_words", "last_line_words", "capital_words", "upper_words",
    "marked_words", "new_pairs", "entropy", "wide_bytes", "longest_word", "symbol_words", "bar_lines", "bang_lines",
)
SYMBOLS = b"#*$%&|<>"


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all are 0 for an empty one."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = Counter(words)
    size = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist[hist > 0] / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = int(hist[list(SYMBOLS)].sum())
    upper = int(hist[65:91].sum())
    letters = upper + int(hist[97:123].sum())
    ends = Counter(w[-1] for w in words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    same = sum(map(bytes.__eq__, words, words[1:]))
    upper_words = sum(map(bytes.isupper, words))
    line_words = n / len(lines)
    return [
        np.log1p(len(text)), np.log1p(n), size / n, symbols / size, upper / max(letters, 1), int(hist[48:58].sum()) / size,
        int(hist[46]) / n, int(hist[33]) / n, int(hist[124]) / n, len(counts) / n, counts.most_common(1)[0][1] / n,
        same / n, 1 - len(set(lines)) / len(lines), np.log1p(line_words), np.log1p(len(lines[-1].split())),
        sum(map(bytes.istitle, words)) / n, upper_words / n, sum(ends[c] for c in b".,!?;:") / n,
        pairs / n, float(-(share * np.log2(share)).sum()), int(hist[128:].sum()) / size, np.log1p(max(map(len, words))),
        sum(ends[c] for c in SYMBOLS) / n, sum(b"|" in x for x in lines) / len(lines), sum(b"!" in x for x in lines) / len(lines),
    ]


def described(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(STATISTICS))


@dataclass
class Trees:
    """Full binary trees of equal depth as arrays: node k of a tree has children 2k+1 and 2k+2."""
    edges: list[np.ndarray]      # borders of the bins of each statistic
    feature: np.ndarray          # trees x inner nodes
    border: np.ndarray           # trees x inner nodes: bins above go right
    value: np.ndarray            # trees x leaves
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all trees are walked together, one level a step."""
        bins, rows = self.binned(x), np.arange(len(x))[:, None]
        n_trees, inner = self.feature.shape
        tree, node = np.arange(n_trees)[None, :], np.zeros((len(x), n_trees), np.int64)
        for _ in range(DEPTH):
            right = bins[rows, self.feature[tree, node]] > self.border[tree, node]
            node = 2 * node + 1 + right
        total = self.value[tree, node - inner].sum(1) + self.base
        return 1 / (1 + np.exp(-total))


def fitted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the log loss on bins of equal counts."""
    n, m = len(y), len(STATISTICS)
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) if n else
             np.zeros(0, np.float32) for j in range(m)]
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    made = Trees(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)), base)
    if n == 0 or y.min() == y.max():
        made.feature, made.border, made.value = np.zeros((1, inner), np.int64), np.full((1, inner), 255), np.zeros((1, leaves))
        return made
    bins = made.binned(x).astype(np.int64)
    total = np.full(n, base)
    features, borders, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, border = np.zeros(inner, np.int64), np.full(inner, 255)
        for level in range(DEPTH):
            width = 2 ** level
            first = width - 1
            own = node - first
            best = np.full(width, 1e-6)
            for j in range(m):
                cell = own * BINS + bins[:, j]
                g, h, c = (np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g ** 2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt ** 2 / (ht + RIDGE)
                gain[(c < LEAST) | (ct - c < LEAST)] = -1
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first:first + width][better] = j
                border[first:first + width][better] = at[better]
            node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > border[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + RIDGE)
        total += value[leaf]
        features.append(feature), borders.append(border), values.append(value)
    made.feature, made.border, made.value = np.array(features), np.array(borders), np.array(values)
    return made


def training_rows(docs: DataFrame, labels: DataFrame, target: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the rows used for fitting: no more than MOST_ROWS labels and rows."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder() != 0))
    known = known.groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("_label"))
    known = known.orderBy(*order).limit(MOST_ROWS)
    rows = docs.select("doc_id", text_of().alias("_text")).join(F.broadcast(known), "doc_id").select("doc_id", "_label", "_text")

    def describe(batches):
        for b in slices(batches):
            x = described(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_label"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(describe, f"doc_id {kind}, y int, x array<float>").orderBy(*order, "x").limit(MOST_ROWS).collect()
    return np.array([r.x for r in got], np.float32).reshape(-1, len(STATISTICS)), np.array([r.y for r in got], float)


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    return fitted(*training_rows(docs, labels))


def _scored(docs: DataFrame, trees: Trees, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns of every row, under numbers so that no name clashes, and ``score``."""
    own = [F.col(c).alias(f"_c{k}") for k, c in enumerate(keep)]

    def score(batches):
        for b in slices(batches):
            x = described(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(trees.score(x), pa.float64())],
                                             names=[*b.schema.names[:-1], "score"])

    rows = docs.select(*own, text_of().alias("_text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"])
    return rows.mapInArrow(score, schema)


def scored(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row and ``score``."""
    return _scored(docs, trees, keep).withColumnsRenamed({f"_c{k}": c for k, c in enumerate(keep)})


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, with their own columns."""
    made = _scored(docs, train(docs, labels), tuple(docs.columns)).where(F.col("score") >= ACCEPT)
    return made.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    made = scored(docs, train(docs, labels))
    return made.select("doc_id", (crc_remainder() == 0).alias("held_out"), "score",
                       (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
