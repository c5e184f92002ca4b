"""Quality rules: fixed base rules, and robust multivariate outliers per language and source.

The centre and scatter of a group of documents come from the half of it whose covariance
determinant is smallest. Such halves are found by concentration steps from two fixed robust starts: measure every document by the
present centre and scatter, keep the nearest share, estimate again, which never raises the determinant. The start that ends with the lowest one
gives the estimates. All documents take part in every step; a step is one aggregation of sums for all starts together,
and the share's limit is a mergeable quantile sketch, so no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import written

LEAST_WORDS, MOST_REPEATED = 10, 20  # base rules: words, and per cent of words in repeated windows
WINDOW = 5
SHARE = 0.5  # of a group, kept by a concentration step: estimates hold while less than half of a group is bad
STEPS = 5
LEAST_GROUP = 70  # smaller groups are judged by all documents of the language, smaller languages by all documents
CUT = 80.0  # squared distance beyond which a document is an outlier
FEW_WORDS = 30  # shares of a short text are noisy: distances are scaled by n / (n + this)

# Statistics and their resolution: differences below it are no evidence, so its square is added to the variance.
STATISTICS = {"log_words": 0.5, "log_mean_word": 0.05, "symbols": 0.15, "dup_lines": 0.15, "repeats": 0.15, "capitals": 0.1, "stops": 0.15}
P = len(STATISTICS)


def _repeat_words(words: list[bytes]) -> int:
    n = len(words)
    if n < WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    run = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    window = run[: n - WINDOW + 1]
    for k in range(1, WINDOW):
        # Pairs of (window so far, next word) get new numbers, so numbers stay below n and equality stays exact.
        window = np.unique(window * len(ids) + run[k : n - WINDOW + 1 + k], return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: n - WINDOW + 1] += again
    edge[WINDOW : n + 1] -= again
    return int((edge.cumsum()[:n] > 0).sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the transformed statistics of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    blank = int(kinds[[9, 10, 11, 12, 13, 32]].sum())
    chars = len(text) - blank
    symbols = int(kinds[[ord(c) for c in "#*$%&|<>"]].sum())
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeats = _repeat_words(words)
    many = max(n, 1)
    x = [
        float(np.log1p(n)), float(np.log(max(chars, 1) / many)), float(np.sqrt(symbols / many)), float(np.sqrt(dup / max(len(lines), 1))),
        float(np.sqrt(repeats / many)), float(np.sqrt(kinds[65:91].sum() / max(chars, 1))), float(np.sqrt(kinds[[33, 46, 63]].sum() / many)),
    ]
    return n, chars, symbols, dup, repeats, *x


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
X = [f"x{i}" for i in range(P)]
SCHEMA = ", ".join([f"{c} long" for c in COUNTS] + [f"{x} double" for x in X])


def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=[*COUNTS, *X])


def _chi2(p: int, quantile: float) -> float:
    """Quantile of the chi-square distribution with p degrees of freedom, by the cube-root normal approximation."""
    from statistics import NormalDist

    a = 2 / (9 * p)
    return p * (1 - a + NormalDist().inv_cdf(quantile) * a**0.5) ** 3


def _key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *(F.when(F.isnull(p), F.lit("n")).otherwise(F.concat(F.lit("s"), p.cast("string"))) for p in parts))


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds ``__group``, which judges a document, and ``__fits``, the groups whose estimates it takes part in.

    A document is judged by its language and source; by all documents of its language where these are too few; and by
    all documents where the language has too few.
    """
    fine, coarse, whole = F.concat(F.lit("f"), _key(F.col("lang"), F.col("source"))), F.concat(F.lit("l"), _key(F.col("lang"))), F.lit("a")
    sizes = rows.filter("n_words > 0").groupBy(fine.alias("__fine"), coarse.alias("__coarse")).agg(F.count(F.lit(1)).alias("__n"))
    languages = sizes.groupBy("__coarse").agg((F.sum("__n") >= LEAST_GROUP).alias("__many"), (F.min("__n") < LEAST_GROUP).alias("__asked"))
    tables = languages.agg(F.coalesce(F.max(~F.col("__many")), F.lit(False)).alias("__all"))
    large = F.col("__n") >= LEAST_GROUP
    fits = F.array(F.when(large, F.col("__fine")), F.when(F.col("__many") & F.col("__asked"), F.col("__coarse")), F.when(F.col("__all"), whole))
    plan = sizes.join(languages, "__coarse").crossJoin(tables).select(
        "__fine", F.when(large, F.col("__fine")).when(F.col("__many"), F.col("__coarse")).otherwise(whole).alias("__group"), F.array_compact(fits).alias("__fits"),
    )
    return rows.withColumn("__fine", fine).join(written(plan), "__fine", "left").drop("__fine")


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)]
    squares = [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}_{j}") for i, j in PAIRS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *squares)


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre, inverse scatter and the scatter's log-determinant from sums, one row per group and start."""
    floor = np.square(list(STATISTICS.values()))
    for rows in batches:
        out = []
        for r in rows.to_dict("records"):
            centre = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
            cov = np.zeros((P, P))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - centre[i] * centre[j]
            scatter = cov + np.diag(floor)
            out.append((r["__group"], r["__start"], centre.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
        yield pd.DataFrame(out, columns=["__group", "__start", "centre", "inverse", "logdet"])


ESTIMATE = "__group string, __start string, centre array<double>, inverse array<double>, logdet double"


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The start of spatial signs: medians, and the scatter of unit vectors from there, scaled by the median deviations."""
    floor = np.square(list(STATISTICS.values()))
    for rows in batches:
        out = []
        for r in rows.to_dict("records"):
            signs = np.zeros((P, P))
            for i, j in PAIRS:
                signs[i, j] = signs[j, i] = r[f"q{i}_{j}"] / max(r["n"], 1)
            scale = np.array([r[f"d{i}"] for i in range(P)])
            # Unit vectors spread 1 / P in each direction where nothing is correlated.
            scatter = P * signs * np.outer(scale, scale) + np.diag(floor)
            out.append((r["__group"], "signs", [r[f"m{i}"] for i in range(P)], np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
        yield pd.DataFrame(out, columns=["__group", "__start", "centre", "inverse", "logdet"])


def _distance() -> Column:
    gap = [F.col(x) - F.element_at("centre", i + 1) for i, x in enumerate(X)]
    terms = [gap[i] * gap[j] * F.element_at("inverse", i * P + j + 1) * (1 if i == j else 2) for i, j in PAIRS]
    return reduce(lambda a, b: a + b, terms)


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts a group: medians with median deviations and no correlations, and the same with the correlations of spatial signs.

    Both hold while less than half of a group is bad. Others, such as the mean and covariance of all, are left out on purpose: where a third of
    a group are copies of one bad document, a half around these has a smaller determinant than any half of good ones, and such starts lead there.
    """
    median = [F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(X)]
    centres = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), *median).filter(F.col("n") >= LEAST_GROUP).drop("n")
    apart = [F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, x in enumerate(X)]
    spread = written(rows.join(centres, "__group").groupBy("__group", *(f"m{i}" for i in range(P))).agg(*apart))
    floor = list(STATISTICS.values())
    variance = lambda i: F.pow(1.4826 * F.col(f"d{i}"), 2) + floor[i] ** 2
    inverse = [1 / variance(i) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]
    plain = spread.select(
        "__group", F.lit("medians").alias("__start"), F.array(*(F.col(f"m{i}") for i in range(P))).alias("centre"), F.array(*inverse).alias("inverse"),
        reduce(lambda a, b: a + b, [F.log(variance(i)) for i in range(P)]).alias("logdet"),
    )
    scaled = spread.select("__group", *(f"m{i}" for i in range(P)), *(F.sqrt(variance(i)).alias(f"d{i}") for i in range(P)))
    gaps = rows.join(scaled, "__group").select("__group", *((F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}") for i, x in enumerate(X))).toDF("__group", *X)
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col(x) * F.col(x) for x in X]))
    unit = gaps.withColumn("__l", F.greatest(length, F.lit(1e-9))).select("__group", *((F.col(x) / F.col("__l")).alias(x) for x in X))
    signs = _moments(unit, "__group").join(scaled, "__group").mapInPandas(_signed, ESTIMATE)
    return plain.unionByName(signs)


def _nearest(rows: DataFrame, now: DataFrame, share: float, times: float = 1.0) -> DataFrame:
    """The rows within ``times`` the distance that covers a share of their group, for each start."""
    placed = rows.join(now.select("__group", "__start", "centre", "inverse"), "__group").withColumn("__d", _distance())
    limit = placed.groupBy("__group", "__start").agg((F.percentile_approx("__d", F.lit(share), F.lit(2000)) * times).alias("__limit"))
    return placed.join(limit, ["__group", "__start"]).filter("__d <= __limit")


def fit(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """One row per group: ``centre``, ``inverse`` scatter, ``scale``, which brings the median distance to
    its expected value, and ``raw_logdet``, the lesser log-determinant of the starts' last halves. Groups below ``LEAST_GROUP`` documents have no row.
    Each step's estimates are written down: they are a few numbers a group, and the next step reads them twice."""
    rows = rows.select("__group", *X)
    now = written(_starts(rows))
    for _ in range(steps):
        near = _nearest(rows, now, share)
        now = written(_moments(near, "__group", "__start").mapInPandas(_estimates, ESTIMATE))
    # Of starts with one determinant, the first by name.
    least = F.min(F.struct("logdet", "__start", "centre", "inverse")).alias("__least")
    best = written(now.groupBy("__group").agg(least).select("__group", "__least.*"))
    # The last step takes every document that is no outlier by the scaled distances.
    near = _nearest(rows, best, 0.5, _chi2(P, 0.975) / _chi2(P, 0.5))
    now = written(_moments(near, "__group", "__start").mapInPandas(_estimates, ESTIMATE))
    placed = rows.join(now, "__group").withColumn("__d", _distance())
    scale = placed.groupBy("__group").agg(F.percentile_approx("__d", F.lit(0.5), F.lit(2000)).alias("__median"))
    found = now.select("__group", "centre", "inverse").join(best.select("__group", F.col("logdet").alias("raw_logdet")), "__group")
    return found.join(scale.select("__group", F.greatest(F.col("__median") / _chi2(P, 0.5), F.lit(0.1)).alias("scale")), "__group")


def judged(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``distance`` per row. Null and empty texts have no words and fail the base rules.

    Null languages and sources are groups of their own. Every document with words has a distance, but where the whole table has
    fewer than ``LEAST_GROUP`` of them: there it is null and documents are kept unless a base rule fails. The statistics are measured once and written down.
    """
    stats = F.pandas_udf(_measured, SCHEMA)
    rows = written(docs.select("doc_id", "lang", "source", stats("text").alias("__s")).select("doc_id", "lang", "source", "__s.*"))
    rows = _grouped(rows)
    model = fit(rows.filter("n_words > 0").withColumn("__group", F.explode("__fits")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    sure = F.col("n_words") / (F.col("n_words") + FEW_WORDS)
    distance = F.when(F.col("n_words") > 0, _distance() / F.col("scale") * sure)
    placed = rows.join(model, "__group", "left").withColumn("__distance", distance)
    near = F.coalesce(F.col("__distance") <= cut, F.lit(True))
    return placed.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & near).alias("kept"), F.col("__distance").alias("distance"))
