import itertools
import random

import pyarrow as pa
import pytest

from cropframe.llm import pieces, token_counts, vocabulary

TEXTS = ["Hello world", "a  b   ", " lead", "\n\n x\t▁ y", "漢字 🙂 the the", "été déjà\r\nvu", "x" * 5000, "▁▁ ▁", "\x00\x01 z",
         " ", "\n", "the theme then them there"]


@pytest.fixture(scope="module")
def vocab():
    return vocabulary.read()


def test_round_trip(vocab):
    encoder = pieces.Encoder(vocab)
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("abt he\n▁é漢🙂.#") for _ in range(rnd.randrange(60))) for _ in range(500)]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert encoder.decode(ids) == t


def test_viterbi_matches_all_splits(vocab):
    encoder = pieces.Encoder(vocab)

    def best(word):
        top = -1e300
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at, score = 0, 0.0
            for end in [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]:
                part = word[at:end]
                if part in vocab.pieces:
                    score += vocab.log_p[vocab.pieces[part]]
                elif len(part) == 1:
                    score += sum(vocab.log_p[vocab.byte_ids[x]] for x in part.encode())
                else:
                    score = -1e300
                    break
                at = end
            top = max(top, score)
        return top

    rnd = random.Random(4)
    words = {" " + "".join(rnd.choice("thenrasio漢é") for _ in range(rnd.randrange(1, 10))) for _ in range(150)}
    for word, ids in encoder.encode_words(words).items():
        assert abs(sum(vocab.log_p[i] for i in ids) - best(word)) < 1e-9


def test_shared_prefixes_do_not_change_results(vocab):
    words = [" the", " them", " then", " theme", " a", " thesis", "th"]
    together = pieces.Encoder(vocab).encode_words(words)
    assert together == {w: pieces.Encoder(vocab).encode_words([w])[w] for w in words}


def test_pieces_that_end_at_a_character_are_found_in_one_step(vocab):
    trie = pieces.Trie(vocab)
    text = " the thenation shear 漢字 é déjà 🙂\x00xx" + "".join(random.Random(6).choices("thenrasiod ", k=400))
    state, longest = 0, max(map(len, vocab.pieces))
    for end in range(1, len(text) + 1):
        state = trie._after(state, text[end - 1])
        found = [(n, vocab.pieces[p]) for n in range(min(longest, end), 0, -1) if (p := text[end - n:end]) in vocab.pieces]
        hits = trie.hits[state] or trie.spelled(text[end - 1])
        assert [(step[0], step[1][0]) for _, _, step in hits if len(step[1]) == 1 and step[1][0] not in vocab.byte_ids] == found
        assert text[end - 1] in vocab.pieces or hits[-1] == trie.spelled(text[end - 1])[0]


def test_words_side_by_side_have_the_pieces_of_words_one_by_one(vocab, monkeypatch):
    rnd = random.Random(8)
    words = {" " + "".join(rnd.choices("thenrasio.,TH-0é漢\x00", [9] * 9 + [1] * 9, k=rnd.randrange(50))) for _ in range(4000)}
    words |= {"", " ", "\n", "a", " a", "x" * 32, "x" * 33, "the" * 400}
    encoder = pieces.Encoder(vocab)
    apart = encoder._one_by_one(sorted(words))
    assert encoder.encode_words(words) == apart
    side = [w for w in words if 0 < len(w) <= pieces.SHORT and encoder.trie.letters.issuperset(w)]
    assert 1000 < len(side) < len(words) and dict(encoder._together(sorted(side))) == {w: apart[w] for w in side}
    few = vocabulary.Vocabulary({"ab": 300, "c": 301}, vocab.byte_ids, [*vocab.log_p], [])
    assert [*pieces.Encoder(few).encode_words(["abc"])["abc"]] == [300, 301]
    assert [*pieces.Encoder(vocabulary.Vocabulary({}, vocab.byte_ids, vocab.log_p, [])).encode_words(["é"])["é"]] == [
        vocab.byte_ids[x] for x in "é".encode()]
    monkeypatch.setattr(pieces, "BLOCK", 7)
    texts = ["".join(rnd.choices(sorted(words), k=30)) for _ in range(20)]
    assert pieces.Encoder(vocab).encode(texts) == encoder.encode(texts)


def test_tasks_of_a_worker_share_one_encoder(vocab):
    assert pieces._encoder(vocab) is pieces._encoder(vocab)


def test_an_encoder_holds_little_and_keeps_frequent_words(vocab, monkeypatch):
    held = list(pieces._slices(pa.array(["x" * 400_000, None, ""] * 6 + ["y" * 3_000_000, "z"])))
    assert [a for a, _ in held] == [0, 6, 12, 18, 19] and sum(len(t) for _, t in held) == 20
    assert all(sum(len(x or "") for x in t) <= 1_000_000 for a, t in held if a != 18)

    monkeypatch.setattr(pieces, "CACHE_WORDS", 3000)
    rnd = random.Random(3)
    texts = [" the the " + " ".join("".join(rnd.choice("thenrasio") for _ in range(9)) for _ in range(1000)) for _ in range(12)]
    encoder = pieces.Encoder(vocab)
    got = [encoder.encode([t])[0] for t in texts]
    assert got == [pieces.Encoder(vocab).encode([t])[0] for t in texts]
    assert len(encoder.known) + len(encoder.older) <= 2 * 4001


def test_words_met_again_are_not_encoded_again(vocab, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    encoder, met = pieces.Encoder(vocab), []
    real = encoder.encode_words
    encoder.encode_words = lambda words: met.extend(words) or real(words)
    for i in range(40):
        encoder.encode(["the " + " ".join(f"w{i}x{j}" for j in range(20))])
    assert met.count(" the") == 1 and len(met) == 1 + 40 * 20


def test_encode_and_decode_documents(spark, documents):
    rows = list(enumerate(TEXTS)) + [(50, None), (51, ""), (None, "null id"), (0, TEXTS[0])]
    encoded = pieces.encode_documents(documents(rows))
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got if r.pieces is not None)
    assert {(r.doc_id, r.n_pieces) for r in got if r.doc_id in (50, 51)} == {(50, None), (51, 0)}
    back = sorted(((r.doc_id, r.text) for r in pieces.decode_documents(encoded).collect()), key=str)
    assert back == sorted(rows, key=str)
    assert pieces.encode_documents(documents([])).count() == 0


def naive(word, known, longest):
    n = i = 0
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in known:
                n, i = n + 1, j
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_automaton_matches_naive(vocab):
    rnd = random.Random(1)
    for known in (set(vocab.pieces), {"abcd", "b", "bc", "bcx", " a", "cé"}):
        automaton = token_counts.Automaton(sorted(known))
        for _ in range(4000):
            word = " " + "".join(rnd.choice("abcdetxé漢 ") for _ in range(rnd.randrange(14)))
            assert automaton.length(word) == naive(word, known, max(map(len, known)))


def test_token_counts(spark, documents, vocab):
    rows = list(enumerate(TEXTS)) + [(50, None), (51, ""), (52, " \n "), (None, "a b"), (0, TEXTS[0])]
    known, longest = set(vocab.pieces), max(map(len, vocab.pieces))
    want = [(i, len((t or "").split()), sum(naive(" " + w, known, longest) for w in (t or "").split())) for i, t in rows]
    got = [tuple(r) for r in token_counts.token_counts(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(documents([])).count() == 0
