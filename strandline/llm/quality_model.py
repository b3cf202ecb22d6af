"""A quality classifier: gradient-boosted trees on histograms of document statistics, flattened into arrays.

The trees are complete and of one depth: node k has the children 2k+1 and 2k+2, so that a batch of documents walks all
trees by index arithmetic on arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh, materialize

FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digits", "blanks", "symbols", "marks", "exclamations", "bars", "high_bytes", "entropy",
    "distinct_words", "top_word", "distinct_pairs", "same_neighbours", "symbol_words", "capital_words", "log_lines", "mean_line", "repeated_lines", "closed_lines",
)
SYMBOLS = b"#*$%&|<>"


def features(text: str) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 1)
    n, size, k = len(words), len(raw), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = k[k > 0] / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = max(1, n - 1)
    letters = max(1, size - int(k[9:14].sum()) - int(k[32]))
    return [
        float(np.log1p(size)), float(np.log1p(n)), letters / n, float(np.log1p(max(map(len, words)))),
        k[65:91].sum() / letters, k[48:58].sum() / letters, (k[9:14].sum() + k[32]) / size, k[list(SYMBOLS)].sum() / n,
        k[list(b".,;:?")].sum() / n, k[33] / n, k[124] / n, k[128:].sum() / letters, float(-(share * np.log2(share)).sum()),
        len(counts) / n ** 0.9, max(counts.values()) / n, len(set(zip(words, words[1:]))) / pairs if n > 1 else 1.0, sum(map(eq, words, words[1:])) / pairs,
        sum(w[-1] in SYMBOLS for w in words) / n, sum(65 <= w[0] <= 90 for w in words) / n,
        float(np.log1p(len(lines))), n / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]


@dataclass
class Trees:
    """feature and threshold by tree and inner node; value by tree and leaf; a row's score is the logistic of bias and leaf values."""

    bias: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.bias), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, ridge: float = 1.0) -> Trees:
    """Boosts logistic loss. Without rows, or with one class only, the trees say the (smoothed) share of ones."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias, inner = float(np.log(share / (1 - share))), 2**depth - 1
    out = Trees(bias, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return out
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(width) * bins
    cuts = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    margin, grown = np.full(n, bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, width), here * width * bins).reshape(here, width, bins).cumsum(2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1.0) | (ht - hl < 1.0) | np.isinf(cuts)[None]] = 0
            best = gain.reshape(here, -1).argmax(1)
            f, b = best // bins, best % bins
            good = gain.reshape(here, -1)[np.arange(here), best] > 1e-6
            feature[first : first + here] = np.where(good, f, 0)
            threshold[first : first + here] = np.where(good, cuts[f, b], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(bias, depth, *(np.stack(part) for part in zip(*grown)))


def _measured(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns and ``features`` (array of double)."""
    (hidden,) = fresh(df, "model_text")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(hidden)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(rows, pa.list_(pa.float64()))], names=[*columns, "features"])

    return df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(hidden)).mapInArrow(run, f"{kinds}, features array<double>")


def fit(df: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Trees:
    """Trains on labelled rows that are usable.

    max_rows bounds the sample, in expectation: rows whose hashed key falls below max_rows over the number of usable labels.
    A key with several labels counts as 1 if their mean is at least one half; null keys and labels are left out. Of rows that share a key the
    one with the least text counts (a null text is empty), so that repeated keys don't enlarge the sample. The sample's
    keys, of bounded number, are broadcast to the scan of the texts.
    """
    one = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).dropna().groupBy("key").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    one = materialize(one.filter(usable), "labels")
    share = max_rows / max(1, one.count())
    if share < 1:
        one = one.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(one), "key")
    texts = texts.groupBy("key", "y").agg(F.min("text").alias("text"))
    rows = _measured(texts, ["key", "y"], "text").select("key", "y", "features").toArrow().sort_by("key")
    x = np.array(rows["features"].to_pylist(), np.float64).reshape(rows.num_rows, len(FEATURES))
    return train(x, rows["y"].to_numpy().astype(np.float64))


def score(df: DataFrame, model: Trees, text: str = "text", keep: tuple[str, ...] | None = None, threshold: float = 0.7) -> DataFrame:
    """The columns kept (all but the text by default), ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    A null text counts as empty and is scored as such; equal texts score alike; an empty table gives no rows. Input columns
    named like the new ones are replaced.
    """
    columns = [c for c in (keep or df.columns) if c != text and c.lower() not in {"score", "predicted"}]
    (hidden,) = fresh(df, "model_text")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(x.as_py()) for x in batch.column(hidden)], np.float64).reshape(batch.num_rows, len(FEATURES))
            got = model.score(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    return df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(hidden)).mapInArrow(run, f"{kinds}, score double, predicted int")
