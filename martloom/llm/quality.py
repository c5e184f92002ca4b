"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts, the trees are grown on a bounded sample of labelled documents, and the
finished trees are flat arrays that numpy walks for a whole batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import packed

KEEP_AT = 0.7
MOST_LABELLED = 10_000  # labelled documents of each class the trees are grown on at most
FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "immediate_repeats", "distinct_pairs",
    "symbols", "bars", "exclamations", "capitals", "digits", "sentence_ends", "repeated_lines", "words_per_line",
)


def features(text: str | None) -> list[float]:
    """Statistics of one whole text; null and empty texts have all zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    size = len(raw)
    flat = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(flat, minlength=256)
    return [
        float(np.log1p(n)),
        float(sizes.mean()),
        float((sizes > 12).mean()),
        float((sizes <= 3).mean()),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        pairs / n,
        float(kinds[[ord(c) for c in "#*$%&<>"]].sum()) / size,
        float(kinds[ord("|")]) / size,
        float(kinds[ord("!")]) / size,
        float(kinds[65:91].sum()) / size,
        float(kinds[48:58].sum()) / size,
        float(kinds[ord(".")]) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in arrays: node ``i`` has children ``2i+1`` and ``2i+2``; the last level is in ``leaf``."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        if self.feature.size and len(x):
            trees = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            while node[0, 0] < inner:
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total += self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Boosted trees for the log loss. Features are cut into at most ``bins`` bins at their quantiles, and every
    level of a tree takes its splits from histograms of gradients and hessians. Without rows, or with one
    class only, there are no trees and the score is the smoothed share of label 1."""
    share = (float(y.sum()) + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    at = binned + np.arange(width) * bins
    feature, threshold, leaf = [], [], []
    total = np.full(n, start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        tree_f, tree_t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            flat = ((node - first)[:, None] * (width * bins) + at).ravel()
            shape = (many, width, bins)
            sg = np.bincount(flat, np.repeat(g, width), many * width * bins).reshape(shape).cumsum(axis=2)
            sh = np.bincount(flat, np.repeat(h, width), many * width * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h = sg[:, :, -1:], sh[:, :, -1:]
            gain = sg**2 / (sh + ridge) + (all_g - sg) ** 2 / (all_h - sh + ridge) - all_g**2 / (all_h + ridge)
            gain[(sh < 1) | (all_h - sh < 1)] = 0
            for k in range(many):
                f, b = divmod(int(gain[k].argmax()), bins)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    tree_f[first + k], tree_t[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), tree_f[node]] > tree_t[node])
        place = node - inner
        value = -rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + ridge)
        total += value[place]
        feature.append(tree_f)
        threshold.append(tree_t)
        leaf.append(value)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), start)


def held_out(doc_id: Column) -> Column:
    """Null ids are never in the training rows either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees:
    """Trees from at most ``most`` labelled documents of each class, chosen by the hash of their id.

    An id on several rows counts once, by the text with the smallest hash. Ids labelled more than once count as 1 if most of their labels are 1; null ids and null labels are left out.
    ``most`` bounds what is broadcast, what is brought to the driver and the time to grow the trees.
    """
    known = (
        labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("__label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [known.filter(F.col("__label") == v).orderBy(*order).limit(most) for v in (0, 1)]
    chosen = F.broadcast(few[0].union(few[1]))  # at most 2 * most pairs of numbers
    columns = F.pandas_udf(_features, "array<double>")
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "__label", F.xxhash64("text").alias("__h"), columns("text").alias("__x"))
    rows = rows.groupBy("doc_id", "__label").agg(F.min(F.struct("__h", "__x")).alias("__first")).select("doc_id", "__label", "__first.__x")
    got = sorted((r["doc_id"], tuple(r["__x"]), r["__label"]) for r in rows.collect())
    x = np.array([r[1] for r in got], float).reshape(len(got), len(FEATURES))
    return grow(x, np.array([r[2] for r in got], float))


def _features(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def scorer(trees: Trees):
    """A column function from text to score."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(trees.score(x))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """Rows of ``docs`` as ``__row`` with ``__score``: higher means label 1 is likelier. Every row gets one, empty texts too."""
    return packed(docs, scorer(trees)("text").alias("__score"))


def accepted(docs: DataFrame, trees: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that score ``keep_at`` or more, in its columns."""
    return scored(docs, trees).filter(F.col("__score") >= keep_at).select("__row.*")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(
        "__row.doc_id", held_out(F.col("__row.doc_id")).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= KEEP_AT).cast("int").alias("predicted"),
    )
