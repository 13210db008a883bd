"""Packing of documents into sequences by first-fit decreasing on a tournament tree.

1. ``tokenised`` writes every row's ids once (with ``end_id`` behind them), with a
   row number; the rows' numbers deal them at random over groups of about
   ``group_tokens`` ids and ``group_rows`` rows, so equal rows spread as well.
2. In a group, a document longer than a sequence fills whole sequences from its
   start; the rest is one item. Items are put, longest first, into the first bin
   with room for them: a tournament tree holds at each node the largest room below,
   so the first fitting bin is one walk down from the root.
3. Padding left by first fit is filled by cutting: of all bins of a group, as many
   of the fullest as its ids fill to the brim are kept, the others are dissolved, and
   their pieces, in order, are cut into the gaps. What remains is less than one
   sequence; it is cut into sequences whose lengths are powers of two, which need no
   padding. So no sequence is padded, and most documents stay whole.

Defined cases: null and empty texts are the one id ``end_id``. Repeated rows are packed
each for itself. An empty table gives no rows; extra columns are ignored; a null doc_id
stays null. A very long text is encoded in parts of about ``SLICE_CHARS``
characters, cut only before a white space, where the tokenizer never joins; its ids are
one row. Memory per task: one batch, the words of one slice of it and two times
``CACHE_WORDS`` words, or one group.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters, punctuation
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import doc_rows, stored

LENGTH, END_ID = 2048, 1
#: Characters of a part of a long text, and bytes of the texts whose distinct words are looked up together.
SLICE_CHARS = 4_000_000
#: Words whose ids are kept, twice.
CACHE_WORDS = 800_000
CACHE_BYTES = 64
#: Words given to the tokenizer in one text.
TOGETHER = 200
#: Words of these letters (Latin but U+0130, whose small form has a mark) are looked up in small ASCII letters,
#: without the signs behind them.
LETTERS = ascii_letters + "".join(chr(x) for x in range(0xc0, 0x250) if x not in (0xd7, 0xf7, 0x130))
SIGNS = punctuation
PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_parts(text: str, most: int = SLICE_CHARS) -> Iterator[str]:
    """``text`` in parts of at least ``most`` characters, each but the first beginning with a space or line end."""
    at = 0
    while len(text) - at > most:
        places = [p for p in (text.find(" ", at + most), text.find("\n", at + most)) if p >= 0]
        if not places:
            break
        yield text[at:min(places)]
        at = min(places)
    yield text[at:]


class Encoder:
    """Ids of texts as bytes, two a piece if the vocabulary allows it, else four.

    Where white space only separates (probed), every distinct word is given to the
    tokenizer once and its ids are kept; other tokenizers get whole texts. Where ASCII case
    does not count and signs behind letters are pieces of their own (probed), a word is
    looked up without both.
    """

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.known, self.older = Tokenizer.from_str(vocabulary), {b"": b""}, {}
        self.kind = id_type(self.model)
        self.code = {"<u2": "H", "<u4": "I"}[self.kind]
        self.end = np.array([end_id], self.kind).tobytes()
        self.apart = self._white_space_separates()
        self.letters = self._letters() if self.apart else None
        self.plain = self.apart and self._plain_words()

    def _white_space_separates(self) -> bool:
        probes, gaps = ["a", "it's", "12", "-)", "e\u0301", "\u039f\u03a3", "\u65e5"], [" ", "\n", "\t ", "\r\n", "\x0b\x0c"]
        alone = {p: self.model.encode(p, add_special_tokens=False).ids for p in probes}
        return not any(" " in t.content for t in self.model.get_added_tokens_decoder().values()) and all(
            self.model.encode(g + x + g + y + g, add_special_tokens=False).ids == alone[x] + alone[y]
            for g in gaps for x in probes for y in probes)

    def _plain_words(self) -> bool:
        """Whether ids of ``LETTERS`` with ``SIGNS`` behind them are those of both, whatever the ASCII letters' case."""
        if any(not t.content.lstrip(LETTERS).lstrip(SIGNS) for t in self.model.get_added_tokens_decoder().values()):
            return False

        def ids(x: str) -> list[int]:
            return self.model.encode(x, add_special_tokens=False).ids

        pairs = [(x, y) for x in ["The", "MAIZE", "\u00c9t\u00e9"] for y in ["", *SIGNS, "...", ".,", "$$$", "-)", "''"]]
        pairs += [(x, y) for x in LETTERS for y in ("", ",")] + [("b" + x + "D", "'") for x in LETTERS]
        return all(ids(x + y) == ids(x.encode().lower().decode()) + ids(y) for x, y in pairs)

    def _encoded(self, text: str) -> bytes:
        return array(self.code, self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _letters(self) -> np.ndarray:
        """Bytes that each id stands for, where the vocabulary has one letter a byte (``_apart`` checks what it finds)."""
        added = self.model.get_added_tokens_decoder()
        suffix = getattr(self.model.model, "end_of_word_suffix", None) or ""
        out = np.zeros(self.model.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            if i < len(out):
                out[i] = len(token if i in added or not suffix else token.removesuffix(suffix))
        return out

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of each word: ``TOGETHER`` words are one text; the bytes of its ids tell words apart, else offsets."""
        out, size = [], array(self.code).itemsize
        for at in range(0, len(words), TOGETHER):
            part = words[at:at + TOGETHER]
            ids = array(self.code, self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids)
            read = np.cumsum(self.letters[np.frombuffer(ids, self.kind)])
            ends = np.cumsum([len(w) if w.isascii() else len(normalize("NFC", w).lower().encode()) for w in part])
            last = np.searchsorted(read, ends)
            if len(read) and read[-1] == ends[-1] and (read[last] == ends).all():  # an id ends where each word ends
                cuts, ids = [0, *((last + 1) * size).tolist()], ids.tobytes()
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += self._apart_by_offsets(part)
        return out

    def _apart_by_offsets(self, words: list[str]) -> list[bytes]:
        """Ids of each word: the words are one text, whose ids' offsets tell the words apart."""
        size, found = array(self.code).itemsize, self.model.encode(" ".join(words), add_special_tokens=False)
        ids = array(self.code, found.ids).tobytes()
        ends = np.cumsum([len(w) + 1 for w in words])
        places = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids) // size)
        cuts = [0, *(np.searchsorted(places, ends) * size).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, ``end_id`` last."""
        return [x for ids in self.slices(pa.array(texts, pa.string())) for x in ids.to_pylist()]

    def slices(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Ids of each text, ``end_id`` last, as binary columns; each holds the next rows of ``SLICE_CHARS`` bytes."""
        texts = texts.fill_null("")
        read, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(texts):
            before = read[at - 1] if at else 0
            rows = max(1, int(np.searchsorted(read, before + SLICE_CHARS, side="right")) - at)
            part = texts.slice(at, rows)
            if not self.apart:
                yield pa.array([self._encoded(t) + self.end for t in part.to_pylist()], pa.binary())
            elif read[at + rows - 1] - before > SLICE_CHARS:  # one long text
                parts = [self._words(pa.array([p], texts.type))[0].as_py() for p in text_parts(part[0].as_py(), SLICE_CHARS)]
                yield pa.array([b"".join(x[:-len(self.end)] for x in parts) + self.end], pa.binary())
            else:
                yield self._words(part)
            at += rows

    def _words(self, texts: pa.Array) -> pa.Array:
        """Ids of each text from those of its words, ``end_id`` last."""
        split = pc.ascii_split_whitespace(texts)
        words, stops = split.values.dictionary_encode(), split.offsets.to_numpy()[1:]
        places = np.insert(words.indices.to_numpy(), stops, len(words.dictionary))  # the end id behind each text
        ids = pa.concat_arrays([self._distinct(words.dictionary), pa.array([self.end], pa.binary())])
        _, offsets, held = ids.take(pa.array(places)).buffers()
        ends = np.frombuffer(offsets, np.int32)[[0, *(stops + np.arange(1, len(stops) + 1))]]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), held])

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of each word; plain words (``_plain_words``) share what is looked up."""
        if not self.plain:
            return pa.array(self._looked_up(words), pa.binary())
        stems = pc.ascii_rtrim(words, SIGNS)
        plain = pc.equal(pc.binary_length(pc.utf8_ltrim(stems, LETTERS)), 0)
        stems = pc.if_else(plain, pc.ascii_lower(stems), words)
        signs = pc.if_else(plain, pc.utf8_ltrim(words, LETTERS), "")
        parts = pa.concat_arrays([stems, signs]).dictionary_encode()
        ids = pa.array(self._looked_up(parts.dictionary), pa.binary()).take(parts.indices)
        return pc.binary_join_element_wise(ids[:len(words)], ids[len(words):], b"")

    def _looked_up(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words."""
        words = words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        places = [i for i, x in enumerate(ids) if x is None]
        if places:
            met = [words[i] for i in places]
            new = dict(zip(met, map(self.older.get, met)))
            unknown = [w for w, x in new.items() if x is None]
            new.update(zip(unknown, self._apart([w.decode() for w in unknown])))
            for i in places:
                ids[i] = new[words[i]]
            self.known.update((w, x) for w, x in new.items() if len(w) <= CACHE_BYTES)
            if len(self.known) > CACHE_WORDS:  # words not met again until the next change go
                self.known, self.older = {b"": b""}, self.known
        return ids


def id_type(model) -> str:
    """Little-endian unsigned integers that hold every id of the vocabulary."""
    return "<u2" if model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def _encoder(vocabulary: str, end_id: int) -> Encoder:
    """One encoder a worker: later tasks find its words."""
    return Encoder(vocabulary, end_id)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids binary, n long) of every row: the ids (``id_type``), ``end_id`` last."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def encoded(batches):
        encoder = _encoder(shipped.value, end_id)
        size = len(encoder.end)
        for batch in batches:
            at = 0
            for ids in encoder.slices(batch.column(1)):
                n = pc.binary_length(ids).to_numpy() // size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ids)), ids, pa.array(n, pa.int64())], ["doc_id", "ids", "n"])
                at += len(ids)

    return doc_rows(docs).mapInArrow(encoded, "doc_id long, ids binary, n long")


class Rooms:
    """Tournament tree over bins 0, 1, 2, ...: each node knows the largest room of the bins below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for ``size``, which then has that much less."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        found = at - self.leaves
        most[at] -= size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], room: int = LENGTH) -> list[list[int]]:
    """Bins as lists of places in ``sizes``; longest first, ties in order."""
    rooms, bins = Rooms(len(sizes), room), []
    for place in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = rooms.take(sizes[place])
        if at == len(bins):
            bins.append([])
        bins[at].append(place)
    return bins


def powers(size: int) -> list[int]:
    """The powers of two that add up to ``size``, largest first."""
    return [1 << b for b in reversed(range(size.bit_length())) if size >> b & 1]


def packed(lengths: list[int], room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id of documents of ``lengths`` once."""
    out = [[(d, s, room)] for d, n in enumerate(lengths) for s in range(0, n - room + 1, room)]
    rest = [(d, n - n % room, n % room) for d, n in enumerate(lengths) if n % room]
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([x[2] for x in rest], room)]
    held = [sum(x[2] for x in b) for b in bins]
    fullest = sorted(range(len(bins)), key=lambda i: -held[i])
    whole = sum(held) // room
    loose = [x for i in fullest[whole:] for x in bins[i]][::-1]

    def cut(size: int) -> list[tuple[int, int, int]]:
        pieces = []
        while size:
            d, s, n = loose.pop()
            if n > size:
                loose.append((d, s + size, n - size))
                n = size
            pieces.append((d, s, n))
            size -= n
        return pieces

    out += [bins[i] + cut(room - held[i]) for i in fullest[:whole]]
    return out + [cut(size) for size in powers(sum(x[2] for x in loose))]


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID,
         group_tokens: int = 1 << 20, group_rows: int = 1 << 15) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids of every piece.

    ``ids``: the piece's ids as little-endian unsigned 32-bit integers.
    """
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        vocabulary = f.read()
    kind = _encoder(vocabulary, end_id).kind
    size_of = int(kind[-1])
    rows = stored(tokenised(docs, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    size = rows.agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, -(-(size["ids"] or 0) // group_tokens), -(-size["rows"] // group_rows))

    def filled(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        counts, ids = frame["n"].tolist(), frame["ids"].tolist()
        pieces = [(d, s, n, sequence, i) for sequence, held in enumerate(packed(counts, length))
                  for i, (d, s, n) in enumerate(held)]
        out = pd.DataFrame(pieces, columns=["d", "start", "length", "sequence", "i"])
        return pd.DataFrame({
            "doc_id": frame["doc_id"].astype("Int64").take(out["d"]).to_numpy(), "start": out["start"], "length": out["length"],
            "doc_tokens": frame["n"].to_numpy()[out["d"]], "sequence_id": (int(key[0]) << 32) + out["sequence"],
            "offset": out.groupby("sequence")["length"].cumsum() - out["length"],
            "ids": [np.frombuffer(ids[d], kind, n, size_of * s).astype("<u4").tobytes() for d, s, n, _, _ in pieces]})

    group = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")
    return rows.select(group, "row", "doc_id", "ids", "n").groupBy("group").applyInPandas(filled, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the checksum of a piece's ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def checksum(ids: list[int]) -> int:
    """``ids_crc32`` of a list of ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
