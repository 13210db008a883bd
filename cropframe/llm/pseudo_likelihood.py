"""Language-model scores by masked pseudo-likelihood.

Every token is predicted from the token before and the token after it, and the
log-probabilities of a document's tokens are summed. Tokens fall into ``classes``
classes: the text's edge, the most frequent words of the corpus one by one, and
all other words by their ending. The probability of a token is that of its class
given both neighbours' classes, times that of its word cell inside the class.

1. Word counts over all documents give the frequent words.
2. Counts of class triples (before, token, after) and of word cells over all
   documents: at most classes^3 + cells numbers, whatever the input, and all the
   network needs, since equal windows have equal predictions.
3. The window network, tanh(before + after) into a softmax, is trained in numpy
   by full-batch gradient steps on these counts: the exact likelihood of the
   whole corpus at a cost that does not grow with it.
4. Scoring looks up log-probabilities of triples and cells, in tasks.

Defined cases: null, empty and word-free texts have 0 tokens, log_prob 0.0 and a
null mean. A corpus without tokens scores nothing. Repeated rows score alike (and
count as often as they occur); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import doc_rows

TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_WORDS = 500_000
#: Distinct words and tokens a counting task holds before it hands them on.
HELD_WORDS, HELD_TOKENS = 400_000, 400_000


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Classes:
    """Class 0 is the edge, 1..len(frequent) the frequent words, then ``endings`` classes of ``cells`` cells each."""

    frequent: tuple[str, ...]
    endings: int
    cells: int

    @property
    def size(self) -> int:
        return 1 + len(self.frequent) + self.endings

    def of(self, codes: np.ndarray) -> np.ndarray:
        first = 1 + len(self.frequent)
        return np.where(codes < first, codes, first + (codes - first) // self.cells)


class Codes(dict):
    """word -> its class if frequent, else the number of classes before the endings plus its cell."""

    def __init__(self, classes: Classes):
        super().__init__()
        self.classes = classes
        self.top = {w: i + 1 for i, w in enumerate(classes.frequent)}

    def __missing__(self, word: str) -> int:
        found = self.top.get(word)
        if found is None:
            c = self.classes
            ending = xxhash.xxh32_intdigest(word[-2:]) % c.endings
            found = 1 + len(c.frequent) + ending * c.cells + xxhash.xxh32_intdigest(word) % c.cells
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found

    def document(self, text: str | None) -> np.ndarray:
        words = tokens_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def triples(codes: np.ndarray, classes: Classes) -> np.ndarray:
    """Number of the class triple around every token; the edge stands beyond both ends."""
    around = np.zeros(len(codes) + 2, np.int64)
    around[1:-1] = classes.of(codes)
    return (around[:-2] * classes.size + around[1:-1]) * classes.size + around[2:]


@dataclass
class Model:
    classes: Classes
    triple_log_p: np.ndarray
    cell_log_p: np.ndarray

    def score(self, codes: np.ndarray) -> float:
        if not len(codes):
            return 0.0
        total = self.triple_log_p[triples(codes, self.classes)].sum(dtype=np.float64)
        cells = codes[codes > len(self.classes.frequent)] - 1 - len(self.classes.frequent)
        return float(total + self.cell_log_p[cells].sum(dtype=np.float64))


def train(counts: np.ndarray, size: int, hidden: int = 32, steps: int = 150, rate: float = 0.05,
          seed: int = 3) -> np.ndarray:
    """log P(token | before, after) of all triples, from their counts (flat, in order before, token, after)."""
    n = counts.reshape(size, size, size).transpose(0, 2, 1).reshape(size * size, size).astype(np.float32)
    total, share = float(n.sum()), n.sum(axis=0)
    random = np.random.default_rng(seed)
    weights = [random.normal(0, 0.3, (size, hidden)), random.normal(0, 0.3, (size, hidden)),
               random.normal(0, 0.1, (hidden, size)), np.log((share + 0.5) / (share.sum() + 0.5 * size))]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    context = n.sum(axis=1, keepdims=True)

    def forward():
        h = np.tanh(weights[0][:, None, :] + weights[1][None, :, :]).reshape(size * size, hidden)
        z = h @ weights[2] + weights[3]
        z -= z.max(axis=1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    for t in range(1, steps + 1 if total else 1):
        h, log_p = forward()
        wrong = (np.exp(log_p) * context - n) / total
        back = ((wrong @ weights[2].T) * (1 - h * h)).reshape(size, size, hidden)
        slopes = [back.sum(axis=1), back.sum(axis=0), h.T @ wrong, wrong.sum(axis=0)]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-9)
    _, log_p = forward()
    return np.ascontiguousarray(log_p.reshape(size, size, size).transpose(0, 2, 1)).reshape(-1)


def frequent_words(docs: DataFrame, top: int) -> list[str]:
    """The ``top`` most frequent tokens of all documents (ties: the smaller word)."""

    def counted(batches):
        held: Counter = Counter()
        for frame in batches:
            for text in frame["text"]:
                held.update(tokens_of(text))
                if len(held) > HELD_WORDS:
                    yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": list(held.values())})

    words = docs.select("text").mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(top).collect()]


def window_counts(docs: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(counts of class triples, counts of word cells) over all documents."""
    size, first = classes.size**3, 1 + len(classes.frequent)

    def counted(batches):
        codes, total, held, n = Codes(classes), np.zeros(size + classes.endings * classes.cells, np.int64), [], 0

        def add():
            flat = np.concatenate(held)
            total[:] += np.bincount(flat, minlength=len(total))

        for frame in batches:
            for text in frame["text"]:
                found = codes.document(text)
                held += [triples(found, classes), size + found[found >= first] - first]
                n += len(found)
                if n > HELD_TOKENS:
                    add()
                    held, n = [], 0
        if held:
            add()
        at = np.flatnonzero(total)
        for i in range(0, len(at), 200_000):
            yield pd.DataFrame({"at": at[i:i + 200_000], "n": total[at[i:i + 200_000]]})

    sums = docs.select("text").mapInPandas(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size + classes.endings * classes.cells)
    total[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return total[:size], total[size:]


def learn(docs: DataFrame, classes: int = 128, endings: int = 27, cells: int = 2048, **training) -> Model:
    docs = doc_rows(docs)
    known = Classes(tuple(frequent_words(docs, classes - 1 - endings)), endings, cells)
    windows, words = window_counts(docs, known)
    words = words.reshape(endings, cells) + 1.0
    cell_log_p = np.log(words / words.sum(axis=1, keepdims=True)).reshape(-1)
    return Model(known, train(windows, known.size, **training), cell_log_p)


def scored(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of every row."""
    model = model or learn(docs, **options)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        codes = Codes(shipped.value.classes)
        for frame in batches:
            found = [codes.document(t) for t in frame["text"]]
            sums = [shipped.value.score(c) for c in found]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "n_tokens": [len(c) for c in found], "log_prob": sums,
                "mean_log_prob": [s / len(c) if len(c) else None for s, c in zip(sums, found)]})

    return doc_rows(docs).mapInPandas(score, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
