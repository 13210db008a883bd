"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text gets one space in front and is cut into marked words: a run of spaces
with the characters after it, or a line end. No piece reaches over such a cut,
so the best split of a text is the best splits of its words, joined.

Per batch, the distinct words are sorted: neighbours share the longest prefixes,
as in a depth-first walk of their trie. A word keeps the forward scores (best
log-probability of a split ending at each position) of the prefix it shares with
the word before and computes only the rest. The pieces that end at a character are
found in one step of a trie with failure links. Short words of frequent letters take
these steps side by side, a column of letters at a time; others one by one. Characters without a
piece are encoded as their UTF-8 bytes. Equal scores: the longer last piece wins.

Decoding joins the pieces' bytes and drops the first space; it restores every
text exactly (a space mark in a text is encoded as bytes).

Defined cases: null gives null pieces and null text; the empty text gives no
pieces. Repeated rows repeat; an empty table gives no rows; extra columns are
ignored. Memory per task: an Arrow batch, the words of one slice, twice ``CACHE_WORDS``
encoded words, the trie and its table (states times ``LETTERS``).
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cropframe.llm import vocabulary
from cropframe.llm.common import doc_rows

WORDS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Words whose ids are kept, twice.
CACHE_WORDS = 100_000
CACHE_LETTERS = 64
#: Characters of text whose distinct words are encoded together.
SLICE_CHARS = 1_000_000
#: Frequent letters of pieces; words of at most ``SHORT`` of them are encoded side by side, of ``BLOCK`` words at a time.
LETTERS, SHORT, BLOCK = 128, 32, 1 << 14


class Trie:
    """Pieces as a trie with failure links: one step a character finds every piece that ends there.

    A state is the longest suffix of the characters read that begins a piece. ``hits[state]`` are the
    pieces that end in it, longest first, then the bytes of its last character if that is no piece:
    each as (minus its length, log-probability, (length, ids)).
    """

    def __init__(self, vocab: vocabulary.Vocabulary):
        self.vocab = vocab
        leaf: dict[str, int] = {}  # shared by the states without a next character
        self.steps, self.fail, self.hits = [{}], [0], [()]
        level = {"": 0}
        for length, ends in enumerate(_beginnings(vocab.pieces), 1):
            found = {}
            for prefix in ends:
                parent, letter, piece = level[prefix[:-1]], prefix[-1], vocab.pieces.get(prefix)
                if self.steps[parent] is leaf:
                    self.steps[parent] = {}
                self.steps[parent][letter] = found[prefix] = len(self.steps)
                back = self._after(self.fail[parent], letter) if parent else 0
                shorter = self.hits[back] or (() if letter in vocab.pieces else self.spelled(letter))
                self.steps.append(leaf)
                self.fail.append(back)
                self.hits.append(shorter if piece is None else ((-length, vocab.log_p[piece], (length, (piece,))), *shorter))
            level = found
        self._lay_out()

    def _lay_out(self) -> None:
        """The trie as arrays for words of ``letters``: a table of next states, and the hits of all states in a row."""
        uses = Counter(chain.from_iterable(x for x in self.steps if x))
        common = sorted((x for x in uses if x in self.vocab.pieces), key=lambda x: (-uses[x], x))[:LETTERS]
        self.letters = frozenset(common)
        self.column = np.zeros(max(map(ord, common), default=0) + 1, np.int64)
        self.column[[ord(x) for x in common]] = range(len(common))
        self.table = np.zeros((len(self.steps), len(common)), np.uint16 if len(self.steps) <= 1 << 16 else np.int32)
        for at, (steps, back) in enumerate(zip(self.steps, self.fail)):  # a failure link leads to an earlier state
            if at:
                self.table[at] = self.table[back]
            for letter, after in steps.items():
                if letter in self.letters:
                    self.table[at, self.column[ord(letter)]] = after
        self.counts = np.array([len(x) for x in self.hits], np.int32)
        self.firsts = np.cumsum(self.counts, dtype=np.int32) - self.counts
        flat = list(chain.from_iterable(self.hits))
        self.lengths = np.array([-x[0] for x in flat], np.int32)
        self.worth = np.array([x[1] for x in flat], np.float64)
        self.ids = np.array([x[2][1][0] for x in flat], np.int32)

    def spelled(self, letter: str) -> tuple:
        """``letter`` as bytes, like an entry of ``hits``."""
        ids = tuple(self.vocab.byte_ids[x] for x in letter.encode())
        return ((-1, sum(self.vocab.log_p[i] for i in ids), (1, ids)),)

    def _after(self, state: int, letter: str) -> int:
        """The state after ``letter``; 0 if no piece begins with it."""
        steps = self.steps
        while state and letter not in steps[state]:
            state = self.fail[state]
        return steps[state].get(letter, 0)


def _beginnings(pieces: Iterable[str]) -> list[list[str]]:
    """All beginnings of ``pieces`` of length 1, 2, ..."""
    out = [set() for _ in range(max(map(len, pieces), default=0))]
    for p in pieces:
        for n in range(len(p), 0, -1):
            if p[:n] in out[n - 1]:
                break
            out[n - 1].add(p[:n])
    return [list(x) for x in out]


class Encoder:
    def __init__(self, vocab: vocabulary.Vocabulary):
        self.vocab = vocab
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}
        self.trie = Trie(vocab)

    def encode_words(self, words) -> dict[str, array]:
        """Best pieces of every distinct word, prefixes shared between neighbours in sorted order."""
        words = sorted(words)
        short = [w for w in words if 0 < len(w) <= SHORT and self.trie.letters.issuperset(w)]
        out = dict(self._together(short)) if short else {}
        if len(short) < len(words):
            out.update(self._one_by_one([w for w in words if w not in out]))
        return out

    def _together(self, words: list[str]) -> Iterator[tuple[str, array]]:
        """``encode_words`` for sorted words of the trie's ``letters``, a column of letters at a time."""
        trie, n = self.trie, len(words)
        sizes = np.fromiter(map(len, words), np.int32, n)
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        codes = np.full((n, width), -1, np.int32)
        codes[inside] = trie.column[np.frombuffer("".join(words).encode("utf-32-le"), np.int32)]
        shared = np.zeros(n, np.int32)
        shared[1:] = np.logical_and.accumulate((codes[1:] == codes[:-1]) & inside[1:], axis=1).sum(axis=1)
        best, back = np.zeros((width + 1, n)), np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, trie.table.dtype)
        for end in range(1, width + 1):
            rows = np.flatnonzero(sizes >= end)
            own = shared[rows] < end  # the others have the prefix of the row before
            nodes = rows[own]
            after = trie.table[state[nodes], codes[nodes, end - 1]]
            first, count = trie.firsts[after], trie.counts[after]
            top, how = np.full(len(nodes), -1e300), np.zeros(len(nodes), np.int32)
            some = np.arange(len(nodes))
            for k in range(int(count.max(initial=0))):
                some = some[count[some] > k]
                hit = first[some] + k
                score = best[end - trie.lengths[hit], nodes[some]] + trie.worth[hit]
                better = score > top[some]
                top[some[better]], how[some[better]] = score[better], hit[better]
            of = np.cumsum(own) - 1
            best[end, rows], back[end, rows], state[rows] = top[of], how[of], after[of]
        at, rows, columns = sizes.copy(), np.arange(n), []
        pieces = np.zeros(n, np.int64)
        while len(rows := rows[at[rows] > 0]):
            hit = back[at[rows], rows]
            columns.append(np.zeros(n, np.int32))
            columns[-1][rows] = trie.ids[hit]
            pieces[rows] += 1
            at[rows] -= trie.lengths[hit]
        flat = np.stack(columns[::-1], axis=1)[np.arange(len(columns))[::-1] < pieces[:, None]].tobytes()
        cuts = [0, *(4 * np.cumsum(pieces)).tolist()]
        return zip(words, [array("i", flat[a:b]) for a, b in zip(cuts, cuts[1:])])

    def _one_by_one(self, words: list[str]) -> dict[str, array]:
        """``encode_words`` for any sorted words."""
        steps, fail, hits, spelled = self.trie.steps, self.trie.fail, self.trie.hits, self.trie.spelled
        best, back, states = [0.0], [(0, ())], [0]
        out, before = {}, ""
        for word in words:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], back[shared + 1:], states[shared + 1:]
            state = states[shared]
            for letter in word[shared:]:
                found = steps[state].get(letter)
                while found is None and state:
                    state = fail[state]
                    found = steps[state].get(letter)
                state = found or 0
                top = -1e300
                for start, log_p, step in hits[state] or spelled(letter):
                    score = best[start] + log_p
                    if score > top:
                        top, how = score, step
                best.append(top)
                back.append(how)
                states.append(state)
            parts, at = [], len(word)
            while at:
                length, ids = back[at]
                parts.append(ids)
                at -= length
            out[word] = array("i", chain.from_iterable(parts[::-1]))
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[array | None]:
        """Ids of whole texts."""
        cut = [WORDS.findall(" " + t) if t else [] for t in texts]
        words = list(chain.from_iterable(cut))
        ends = [0, *accumulate(map(len, cut))]
        del cut
        ids = list(map(self.known.get, words))
        places = [i for i, x in enumerate(ids) if x is None]
        new = dict.fromkeys(map(words.__getitem__, places))
        for w in new:
            new[w] = self.older.get(w)
        unknown = sorted(w for w, x in new.items() if x is None)
        for at in range(0, len(unknown), BLOCK):
            new.update((w, x.tobytes()) for w, x in self.encode_words(unknown[at:at + BLOCK]).items())
        for i in places:
            ids[i] = new[words[i]]
        self.known.update((w, x) for w, x in new.items() if len(w) <= CACHE_LETTERS)
        if len(self.known) > CACHE_WORDS:  # words not met again until the next change go
            self.known, self.older = {}, self.known
        return [None if t is None else array("i", b"".join(ids[a:b])) for t, a, b in zip(texts, ends, ends[1:])]

    def decode(self, ids) -> str | None:
        return None if ids is None else b"".join(map(self.vocab.as_bytes.__getitem__, ids))[1:].decode()


@lru_cache(maxsize=1)
def _encoder(vocab: vocabulary.Vocabulary) -> Encoder:
    """One encoder a worker: later tasks find its trie and words."""
    return Encoder(vocab)


def _slices(texts: pa.StringArray):
    """(first row, texts) of at most ``SLICE_CHARS`` characters, a longer text alone."""
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        t = text.as_py()
        n = len(t) if t else 0
        if held and size + n > SLICE_CHARS:
            yield start, held
            start, size, held = i, 0, []
        size += n
        held.append(t)
    if held:
        yield start, held


def encode_documents(docs: DataFrame, model_path: str = vocabulary.MODEL_PATH) -> DataFrame:
    """doc_id, n_pieces, pieces, round_trip (decoding gives back the text) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary.read(model_path))

    def encoded(batches):
        encoder = _encoder(shipped.value)
        for batch in batches:
            for a, texts in _slices(batch.column(1)):
                ids = encoder.encode(texts)
                counts = [0 if x is None else len(x) for x in ids]
                flat = np.frombuffer(b"".join(x.tobytes() for x in ids if x is not None), np.int32)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                missing = pa.array([x is None for x in ids])
                pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=missing)
                same = [None if x is None else encoder.decode(x) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(ids)),
                     pa.array([None if x is None else n for x, n in zip(ids, counts)], pa.int64()),
                     pieces, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "pieces", "round_trip"])

    return doc_rows(docs).mapInArrow(encoded, "doc_id long, n_pieces long, pieces array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str = vocabulary.MODEL_PATH) -> DataFrame:
    """doc_id, text from ``pieces``."""
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary.read(model_path))

    def decoded(batches):
        encoder = _encoder(shipped.value)
        for batch in batches:
            texts = [encoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(decoded, "doc_id long, text string")
