"""Toxicity by class-conditional Kneser-Ney models of words and word pairs with shared backoff counts.

One model per class (toxic, ordinary) gives P(word | word before). A pair's counts
back off to the word's, a word's to the counts of both classes together. Counts are
documents, not occurrences, so repeated lines carry no weight. A class's count of an
expression departs from what the backoff expects of it; the departure is discounted
by ``deviations`` standard deviations of a count of that size, and the freed mass goes
to the backoff. So rare expressions, of which a class cannot have many, and those
that both classes share score by the backoff alone, which cancels out at the word
level; an expression of mild but well attested difference keeps most of it.

A text's score compares its toxic and ordinary log-likelihood per word; an isotonic
curve, fitted on cross-fitted ratios, maps it to 0..1.

Words are runs of letters and digits; in scripts written without spaces every sign is
one. Learning counts in Spark over at most ``sample_rows`` labelled rows (of the
doc_ids with the smallest hashes, one row each; the documented bound of the fit) and
fits the ratios there; the driver gets the expressions that keep a departure. Scoring
covers every row and whole texts.

Defined cases: null, empty and word-free texts get the share of toxic rows in the
sample. Null labels teach nothing; a doc_id labelled twice counts under each label;
of several rows of one doc_id the smallest text teaches. Without labels of both
classes every score is the share of toxic rows (0 without any). Repeated rows score
alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.llm.calibrate import applied, isotonic
from cropframe.llm.common import doc_rows, label_bucket, stored

# Blocks of scripts written without spaces (Thai and Lao, Myanmar, Khmer, kana, Han and its extensions).
UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
            "\U00020000-\U000323af")
WORD = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+")
#: Expressions a counting task holds before it hands them on.
HELD = 500_000
FOLDS = 5
CLASSES = ("o", "t")  # ordinary, toxic
#: What the driver fits: model f leaves fold f out, the last one takes all.
MODELS = range(FOLDS + 1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Ratios:
    """log P(toxic) - log P(ordinary) of words, and how far that of a pair departs from its word's."""

    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)

    def text(self, text: str | None) -> float | None:
        """The log-likelihood ratio per word; None without words."""
        words = words_of(text)
        if not words:
            return None
        total = sum(self.words[w] for w in words if w in self.words)
        if self.pairs:
            total += sum(self.pairs[p] for p in zip(["", *words], words) if p in self.pairs)
        return total / len(words)


@dataclass
class Model:
    ratios: Ratios
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def score(self, text: str | None) -> float:
        ratio = self.ratios.text(text)
        if ratio is None or self.knots is None:
            return self.base
        return float(applied(self.knots, ratio))


def departure(toxic: Column, ordinary: Column, all_toxic: Column, all_ordinary: Column, backoff: Column,
              min_count: int, deviations: float, prior: float) -> Column:
    """What an expression's class counts add to its ``backoff`` ratio after the discount; 0.0 if nothing is left.

    ``all_toxic``, ``all_ordinary``: the counts of its history in each class.
    """
    n = toxic + ordinary
    weight = all_toxic * F.exp(backoff)
    share = weight / (weight + all_ordinary)
    beyond = toxic - n * share
    left = F.abs(beyond) - deviations * F.sqrt(n * share * (1 - share))
    kept = n * share + F.signum(beyond) * left
    ratio = F.log((kept + prior * share) / (n - kept + prior * (1 - share))) - F.log(all_toxic / all_ordinary)
    enough = (n >= min_count) & (all_toxic > 0) & (all_ordinary > 0)
    return F.when(enough, F.when(left > 0, ratio - backoff)).otherwise(F.lit(None))


def _expression_counts(batches):
    """Per task: (fold, toxic, before, word) -> documents, in bounded batches; before is null for words alone."""
    held: Counter = Counter()

    def flush():
        keys = list(held)
        return pd.DataFrame({"fold": [k[0] for k in keys], "toxic": [k[1] for k in keys],
                             "before": pd.Series([k[2] for k in keys], dtype=object),
                             "word": pd.Series([k[3] for k in keys], dtype=object), "n": [held[k] for k in keys]})

    for frame in batches:
        for fold, toxic, text in zip(frame["fold"], frame["toxic"], frame["text"]):
            words = words_of(text)
            for expression in {*((None, w) for w in words), *zip(["", *words], words)}:
                held[(fold, toxic, *expression)] += 1
                if len(held) >= HELD:
                    yield flush()
                    held.clear()
    if held:
        yield flush()


def counts_of(rows: DataFrame) -> DataFrame:
    """before, word and documents by fold and class (``t0``, ``o0``, ...) of ``rows`` (fold, toxic, text)."""
    parts = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == k), F.col("n")).otherwise(0)).alias(f"{c}{f}")
             for f in range(FOLDS) for k, c in enumerate(CLASSES)]
    return (rows.mapInPandas(_expression_counts, "fold int, toxic int, before string, word string, n long")
            .groupBy("before", "word").agg(*parts))


def _summed(side: str = "") -> list[Column]:
    return [F.sum(f"{c}{f}").alias(f"{side}{c}{f}") for f in range(FOLDS) for c in CLASSES]


def _by_model(counts: DataFrame, *sides: str) -> DataFrame:
    """One row per model instead of the folds' columns: model and, for every side, the counts of all folds but its own."""
    def of(side, c, model):
        return sum(F.col(f"{side}{c}{f}") for f in range(FOLDS) if f != model).cast("double").alias(f"{side}{c}")

    models = F.array(*(F.struct(F.lit(m).alias("model"), *(of(s, c, m) for s in sides for c in CLASSES)) for m in MODELS))
    kept = [c for c in ("before", "word") if c in counts.columns]
    return counts.select(*kept, F.explode(models).alias("of")).select(*kept, "of.*")


def fitted(counts: DataFrame, min_count: int, deviations: float, prior: float) -> tuple[DataFrame, DataFrame]:
    """(words, pairs) that keep a departure: model, word or before and word, ratio."""
    often = sum(F.col(f"{c}{f}") for f in range(FOLDS) for c in CLASSES) >= min_count
    alone, paired = counts.where("before is null").drop("before"), counts.where("before is not null")
    everything = _by_model(alone.agg(*_summed("all_")), "all_")  # one row a model

    def ratio(backoff: Column) -> Column:
        return departure(*(F.col(c) for c in ("t", "o", "all_t", "all_o")), backoff, min_count, deviations, prior).alias("ratio")

    words = _by_model(alone.where(often), "").join(F.broadcast(everything), "model")
    words = stored(words.select("model", "word", ratio(F.lit(0.0))).where("ratio is not null"), "toxicity-words")
    pairs = paired.where(often).join(paired.groupBy("before").agg(*_summed("all_")), "before")
    pairs = _by_model(pairs, "", "all_").join(words.withColumnRenamed("ratio", "of_word"), ["model", "word"], "left")
    pairs = pairs.select("model", "before", "word", ratio(F.coalesce("of_word", F.lit(0.0))))
    return words, pairs.where("ratio is not null")


def ratios_of(words: DataFrame, pairs: DataFrame) -> list[Ratios]:
    """The fitted models, in the order of ``MODELS``."""
    found = [Ratios() for _ in MODELS]
    for r in words.toArrow().to_pylist():
        found[r["model"]].words[r["word"]] = r["ratio"]
    for r in pairs.toArrow().to_pylist():
        found[r["model"]].pairs[r["before"], r["word"]] = r["ratio"]
    return found


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, min_count: int = 3, deviations: float = 4.0,
          prior: float = 1.0) -> Model:
    """Fit the class models on the labelled rows outside the held-out fold (crc32 mod 3 = 1)."""
    spark = docs.sparkSession
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (label_bucket(F.col("doc_id"), 3) != 1))
              .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = stored(doc_rows(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic")
                  .agg(F.min("text").alias("text")).select(fold.alias("fold"), "toxic", "text").repartition(32),
                  "toxicity-sample")
    seen = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = seen.get(1, 0) / max(1, sum(seen.values()))
    if len(seen) < 2:
        return Model(Ratios(), None, base)
    *crossed, whole = ratios_of(*fitted(stored(counts_of(rows), "toxicity-counts"), min_count, deviations, prior))
    shipped = spark.sparkContext.broadcast(crossed)

    def held_ratios(batches):
        for frame in batches:
            found = [shipped.value[f].text(t) for f, t in zip(frame["fold"], frame["text"])]
            yield pd.DataFrame({"toxic": frame["toxic"], "ratio": pd.Series(found, dtype="float64")})

    pairs = rows.mapInPandas(held_ratios, "toxic int, ratio double").where("ratio is not null").toPandas()
    shipped.destroy()
    if pairs.empty:
        return Model(Ratios(), None, base)
    return Model(whole, isotonic(pairs["ratio"].to_numpy(), pairs["toxic"].to_numpy()), base)


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score in 0..1, the model broadcast once."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shipped.value.score(t) for t in texts], dtype="float64")

    return score


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = scorer(docs, learn(docs, labels, **options))
    return doc_rows(docs).select(
        "doc_id", (label_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def text_column(docs: DataFrame) -> Column:
    return F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")


def civil_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    score = scorer(docs, learn(docs, labels, **options))
    return docs.where(score(text_column(docs)) < threshold)
