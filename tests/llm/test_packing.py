"""Packing: first fit against a plain scan, exact cover of every document's ids, no padding."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cropframe.llm import packing as M


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(M.tokenizer_path())


def plain_first_fit(sizes, room):
    bins = []
    for place in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b in bins:
            if sum(sizes[i] for i in b) + sizes[place] <= room:
                b.append(place)
                break
        else:
            bins.append([place])
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_tree_equals_plain_first_fit(seed):
    random.seed(seed)
    sizes = [random.randint(1, random.choice([5, 50, 100])) for _ in range(random.randint(0, 200))]
    assert M.first_fit_decreasing(sizes, 100) == plain_first_fit(sizes, 100)


@pytest.mark.parametrize("seed", range(20))
def test_every_id_once_and_no_padding(seed):
    random.seed(seed)
    lengths = [random.randint(1, random.choice([3, 40, 700])) for _ in range(random.randint(0, 120))]
    seen = defaultdict(list)
    sequences = M.packed(lengths, 64)
    for held in sequences:
        total = sum(n for _, _, n in held)
        assert all(n > 0 for _, _, n in held) and (total == 64 or total & (total - 1) == 0)
        for d, s, n in held:
            seen[d] += range(s, s + n)
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}
    assert sum(sum(x[2] for x in held) < 64 for held in sequences) <= 6


def test_documents_that_fit_stay_whole():
    assert sorted(map(len, M.packed([32] * 10 + [16, 48], 64))) == [2] * 6


def check(pieces, docs, model, length):
    """docs: (doc_id, text) with distinct ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = [*model.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == M.checksum(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or (at < length and at & (at - 1) == 0)


def test_whole_operator(spark, documents, model):
    random.seed(4)
    words = "the crop yield of Maize 2020, it's über 日本 don't <|endoftext|> x\n".split(" ")
    docs = [(i, " ".join(random.choices(words, k=random.randint(1, 120)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, " \n "), (903, "word " * 5000), (None, "no id")]
    for options in ({}, {"group_tokens": 500, "length": 64}, {"group_rows": 7, "length": 128}):
        check(M.digest(M.pack(documents(docs), **options)).collect(), docs, model, options.get("length", M.LENGTH))


def test_repeated_rows_are_packed_each(spark, documents, model):
    pieces = M.digest(M.pack(documents([(7, "the same row again")] * 40), group_tokens=30)).collect()
    n = len(model.encode("the same row again", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in pieces) == 40 * n
    assert len({r.sequence_id >> 32 for r in pieces}) > 1  # equal rows lie in several groups


def test_empty_table(spark, documents):
    assert M.digest(M.pack(documents([]))).count() == 0


def test_long_texts_in_parts_have_the_same_ids(model):
    text = "It's a long\n\ttext,  with odd spaces é ́x and <|endoftext|> in it's middle ΟΔΟΣ " * 300
    for most in (1, 17, 400):
        parts = list(M.text_parts(text, most))
        assert "".join(parts) == text and len(parts) > 10
        got = [i for p in parts for i in model.encode(p, add_special_tokens=False).ids]
        assert got == model.encode(text, add_special_tokens=False).ids
    assert list(M.text_parts("x" * 50, 10)) == ["x" * 50]


def test_encoder_equals_the_tokenizer_on_whole_texts(model, monkeypatch):
    monkeypatch.setattr(M, "CACHE_WORDS", 20)
    random.seed(2)
    letters = "ab'stDé́ΣσИ日\xa0\u2003\x1c\x85 \n\t\r1<|>endoftext.,😀"
    texts = ["", " ", "x" * 500, "<|endoftext|>", "a<|endoftext|> b", "don't it's we'll"]
    texts += ["".join(random.choices(letters, k=random.randint(1, 300))) for _ in range(300)]
    encoder = M.Encoder(open(M.tokenizer_path(), encoding="utf-8").read(), 1)
    assert encoder.apart and encoder.kind == "<u2"
    for t, ids in zip(texts, encoder.of(texts)):
        assert list(np.frombuffer(ids, "<u2")) == [*model.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_words_are_told_apart_by_bytes_of_ids_else_by_offsets(model, monkeypatch):
    monkeypatch.setattr(M, "TOGETHER", 30)
    rnd = random.Random(7)
    words = ["".join(rnd.choices("thenrasioTHE.,'0é&ñßΣ日", [9] * 9 + [1] * 13, k=rnd.randint(1, 14))) for _ in range(3000)]
    words += ["e\u0301", "<|endoftext|>", "\u0130", "ΟΔΟΣ", "\u00a0", "\u2003x", "\x1c", "don't"]
    encoder = M.Encoder(open(M.tokenizer_path(), encoding="utf-8").read(), 1)
    apart, real = [], encoder._apart_by_offsets
    encoder._apart_by_offsets = lambda part: apart.extend(part) or real(part)
    for w, ids in zip(words, encoder._apart(words), strict=True):
        assert list(np.frombuffer(ids, "<u2")) == model.encode(w, add_special_tokens=False).ids, repr(w)
    assert len(apart) < 100
    encoder.letters = np.ones_like(encoder.letters)  # not what ids stand for: all by offsets
    assert encoder._apart(words) == [y for i in range(0, len(words), 30) for y in real(words[i:i + 30])]


def test_plain_words_share_one_look_up(model):
    encoder = M.Encoder(open(M.tokenizer_path(), encoding="utf-8").read(), 1)
    assert encoder.plain
    given, real = [], encoder._apart
    encoder._apart = lambda words: given.extend(words) or real(words)
    texts = ["The crop, THE CROP. the crop", "(the) crop... the, été été,", "Crop's the; it's It's, \u0130x, j\u030c, J\u030c,", "$$$ the$$$"]
    for t, ids in zip(texts * 2, encoder.of(texts * 2), strict=True):
        assert list(np.frombuffer(ids, "<u2")) == [*model.encode(t, add_special_tokens=False).ids, 1], t
    assert len(given) == len(set(given)) and {w for w in given if w.strip(M.SIGNS).isalpha() and w != "(the)"} == {
        "the", "crop", "été", "\u0130x,"}
    random.seed(11)
    kinds = [M.LETTERS, M.SIGNS, "ABCxyz", "'st", "<|endoftext|>", "1٣", "\u0301\u030c\u0130\u1e9eΣσИ日ª", ".,", " \n"]
    texts = ["".join(random.choice(random.choice(kinds)) for _ in range(random.randint(1, 60))) for _ in range(3000)]
    texts += [f"{x}<|endoftext|>{y} {x}<|ENDOFTEXT|>{y}," for x in ("a", "Ab,") for y in ("", "b", ".")]
    for t, ids in zip(texts, encoder.of(texts), strict=True):
        assert list(np.frombuffer(ids, "<u2")) == [*model.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_added_tokens_of_letters_and_signs_leave_words_whole():
    changed = Tokenizer.from_file(M.tokenizer_path())
    changed.add_tokens(["Crop,"])
    encoder = M.Encoder(changed.to_str(), 1)
    assert encoder.apart and not encoder.plain
    for t, ids in zip(["Crop, crop, crop", "a Crop,x"], encoder.of(["Crop, crop, crop", "a Crop,x"]), strict=True):
        assert list(np.frombuffer(ids, "<u2")) == [*changed.encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_hold_every_row_in_order(model, monkeypatch, kind):
    monkeypatch.setattr(M, "SLICE_CHARS", 60)
    monkeypatch.setattr(M, "CACHE_WORDS", 9)
    random.seed(5)
    texts = [None, "", " \n ", "it's über, 日本. " * 40, None]
    texts += [" ".join(random.choices("a The the, über. Yield yield x1 日".split(), k=random.randint(0, 30))) for _ in range(80)]
    encoder = M.Encoder(open(M.tokenizer_path(), encoding="utf-8").read(), 1)
    slices = list(encoder.slices(pa.array(["left out", *texts], kind)[1:]))
    assert len(slices) > 30
    for t, ids in zip(texts, [x for s in slices for x in s.to_pylist()], strict=True):
        assert list(np.frombuffer(ids, "<u2")) == [*model.encode(t or "", add_special_tokens=False).ids, 1], repr(t)


def test_tokenizer_whose_pieces_hold_spaces_gets_whole_texts(spark, documents):
    path = M.tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    other = Tokenizer.from_file(path)
    assert not M.Encoder(open(path, encoding="utf-8").read(), 1).apart
    docs = [(i, f"some text  with {i} spaces\n here") for i in range(20)]
    check(M.digest(M.pack(documents(docs), path=path)).collect(), docs, other, M.LENGTH)
