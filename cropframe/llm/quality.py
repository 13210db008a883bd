"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

1. Every text becomes a short vector of statistics (lengths, shares of letter
   cases, digits, punctuation and symbols, repetition of words and lines).
2. Random Fourier features cos(W x + b), seeded, approximate a Gaussian kernel
   over the standardised statistics.
3. Each task sums its part of the normal equations (one per fold); Spark adds the
   parts entry by entry, and the driver solves the ridge system of ``features``
   unknowns, whatever the number of rows.
4. Ridge scores of rows left out of the solved folds fit an isotonic curve to 0..1.

Learning takes at most ``sample_rows`` labelled rows (those with the smallest
hash of doc_id; the documented bound of the fit), held-out fold excluded.
Scoring covers every row and whole texts.

Defined cases: null, empty and blank texts get the share of good rows in the
sample. Null labels teach nothing; a doc_id labelled twice counts under each
label. Without labels of both classes every score is that share (0 without any).
Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.llm.calibrate import applied, isotonic
from cropframe.llm.common import doc_rows, label_bucket, stored
from cropframe.llm.toxicity import text_column

FOLDS = 5
N_STATS = 16
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_STOPS = np.isin(_BYTES, list(b".,;:?"))
_SYMBOL = np.isin(_BYTES, list(b"#$%&*|!@<>{}[]=+~^_\\/"))


def statistics(text: str | None) -> np.ndarray | None:
    """``N_STATS`` statistics of a whole text; None if it has no words."""
    words = text.split() if text else []
    if not words:
        return None
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n, n_words = len(raw), len(words)
    share = counts[counts > 0] / n
    lines = [line for line in text.split("\n") if line]
    tally = Counter(words)
    return np.array([
        np.log1p(n), np.log1p(n_words), n / n_words, counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n,
        counts[_STOPS].sum() / n_words, counts[_SYMBOL].sum() / n_words, counts[124] / n_words, counts[33] / n_words,
        len(lines) / n_words, len(tally) / n_words, max(tally.values()) / n_words,
        sum(map(str.__eq__, words, words[1:])) / n_words, 1.0 - len(set(lines)) / len(lines) if lines else 0.0,
        -(share * np.log(share)).sum(), text.count(". ") / n_words])


@dataclass
class Features:
    """Standardisation and the random directions."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -5, 5)
        waves = np.cos(scaled @ self.weights + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.concatenate([waves, np.ones((len(waves), 1))], axis=1)


@dataclass
class Model:
    features: Features | None
    beta: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def scores(self, texts) -> np.ndarray:
        stats = [statistics(t) for t in texts]
        out = np.full(len(stats), self.base)
        there = [i for i, s in enumerate(stats) if s is not None]
        if there and self.beta is not None:
            out[there] = applied(self.knots, self.features(np.stack([stats[i] for i in there])) @ self.beta)
        return out


def _partial_sums(features: Features):
    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for frame in batches:
            z = features(np.stack(frame["stats"].to_numpy()))
            z = np.concatenate([z, frame["quality"].to_numpy(float)[:, None]], axis=1)
            for fold in np.unique(frame["fold"]):
                part = z[(frame["fold"] == fold).to_numpy()]
                held[fold] = held.get(fold, 0.0) + part.T @ part
        for fold, matrix in held.items():
            i, j = np.triu_indices(len(matrix))
            yield pd.DataFrame({"fold": np.full(len(i), fold), "i": i, "j": j, "v": matrix[i, j]})

    return sums


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 16384, features: int = 160, width: float = 3.0,
          ridge: float = 1e-2, seed: int = 7) -> Model:
    """Fit on the labelled rows outside the held-out fold (crc32 mod 5 = 0)."""
    spark = docs.sparkSession
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (label_bucket(F.col("doc_id"), 5) != 0))
              .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows))

    def measured(batches):
        for frame in batches:
            stats = [statistics(t) for t in frame["text"]]
            yield pd.DataFrame({"fold": frame["fold"], "quality": frame["quality"], "stats": stats})

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = (doc_rows(docs).join(F.broadcast(chosen), "doc_id").select(fold.alias("fold"), "quality", "text")
            .mapInPandas(measured, "fold int, quality int, stats array<double>"))
    rows = stored(rows, "quality-sample")
    seen = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = seen.get(1, 0) / max(1, sum(seen.values()))
    rows = rows.where("stats is not null").coalesce(16)
    moments = rows.agg(*[f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(N_STATS)
                         for f, name in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    if len(seen) < 2 or moments["m0"] is None:
        return Model(None, None, None, base)
    random = np.random.default_rng(seed)
    mapped = Features(np.array([moments[f"m{i}"] for i in range(N_STATS)]),
                      np.array([moments[f"s{i}"] or 1.0 for i in range(N_STATS)]),
                      random.normal(0.0, 1.0 / width, (N_STATS, features)), random.uniform(0, 2 * np.pi, features))
    sums = (rows.mapInPandas(_partial_sums(mapped), "fold int, i int, j int, v double")
            .groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))).toPandas()
    size = features + 2
    parts = np.zeros((FOLDS, size, size))
    parts[sums["fold"], sums["i"], sums["j"]] = sums["v"]
    parts = parts + np.triu(parts, 1).transpose(0, 2, 1)

    def solved(matrix: np.ndarray) -> np.ndarray:
        gram, target = matrix[:-1, :-1], matrix[:-1, -1]
        return np.linalg.solve(gram + ridge * np.eye(size - 1), target)

    total = parts.sum(axis=0)
    crossed = [solved(total - parts[f]) for f in range(FOLDS)]

    def held_scores(batches):
        for frame in batches:
            z = mapped(np.stack(frame["stats"].to_numpy()))
            score = np.einsum("ij,ij->i", z, np.stack([crossed[f] for f in frame["fold"]]))
            yield pd.DataFrame({"quality": frame["quality"], "score": score})

    pairs = rows.mapInPandas(held_scores, "quality int, score double").toPandas()
    return Model(mapped, solved(total), isotonic(pairs["score"].to_numpy(), pairs["quality"].to_numpy()), base)


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score in 0..1, the model broadcast once."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.scores(texts))

    return score


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = scorer(docs, learn(docs, labels, **options))
    return doc_rows(docs).select(
        "doc_id", (label_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    score = scorer(docs, learn(docs, labels, **options))
    return docs.where(score(text_column(docs)) >= threshold)
