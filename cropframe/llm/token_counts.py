"""Token counts by a linear longest-match automaton.

Words are the runs between white space, each with a space mark in front; greedy
longest match splits a word into pieces, left to right. The vocabulary is a trie
whose nodes carry a failure link and the number of pieces that following it
gives out, so a word's length is read in one pass without building pieces.
A character that no piece starts with counts its UTF-8 bytes.

Each task keeps the lengths of up to ``CACHE_WORDS`` distinct words.

Defined cases: null, empty and blank texts have 0 words and 0 tokens. Repeated
rows repeat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm import vocabulary
from cropframe.llm.common import doc_rows

CACHE_WORDS = 500_000
CACHE_LETTERS = 64


class Automaton:
    """Greedy longest-match lengths over a set of pieces (texts)."""

    def __init__(self, pieces):
        self.next: dict[tuple[int, str], int] = {}
        self.fail, self.pops = [0], [0]
        ends = {}
        letters = {c for p in pieces for c in p}
        cost = {c: len(c.encode()) for c in letters}
        cost |= {c: 1 for c in letters if c in set(p for p in pieces if len(p) == 1)}
        for piece in [*pieces, *letters]:
            node = 0
            for c in piece:
                key = (node, c)
                if key not in self.next:
                    self.next[key] = len(self.fail)
                    self.fail.append(0)
                    self.pops.append(0)
                node = self.next[key]
            ends[node] = cost[piece] if len(piece) == 1 else 1
        below: dict[int, list[tuple[str, int]]] = {}
        for (node, c), child in self.next.items():
            below.setdefault(node, []).append((c, child))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in below.get(node, ()):
                queue.append(child)
                if child in ends:
                    self.pops[child] = ends[child]
                    continue
                at, popped = self.fail[node], self.pops[node]
                while (at, c) not in self.next:
                    popped += self.pops[at]
                    at = self.fail[at]
                self.fail[child], self.pops[child] = self.next[at, c], popped

    def length(self, word: str) -> int:
        node, total, step, fail, pops = 0, 0, self.next, self.fail, self.pops
        for c in word:
            while (node, c) not in step:
                if not node:
                    total += len(c.encode())
                    break
                total += pops[node]
                node = fail[node]
            else:
                node = step[node, c]
        while node:
            total += pops[node]
            node = fail[node]
        return total


class WordLengths(dict):
    """word -> pieces of the marked word, filled on demand."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.length(" " + word)
        if len(word) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, model_path: str = vocabulary.MODEL_PATH) -> DataFrame:
    """doc_id, n_words, n_tokens of every row."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(list(vocabulary.read(model_path).pieces))

    def counted(batches):
        lengths = WordLengths(Automaton(shipped.value))
        for frame in batches:
            words, tokens = [], []
            for text in frame["text"]:
                found = text.split() if text else []
                words.append(len(found))
                tokens.append(sum(map(lengths.__getitem__, found)))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_words": words, "n_tokens": tokens})

    return doc_rows(docs).mapInPandas(counted, "doc_id long, n_words long, n_tokens long")
