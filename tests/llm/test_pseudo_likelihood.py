import math

import numpy as np

from cropframe.llm import pseudo_likelihood as P

TEXTS = ["the cat sat on the mat", "The cat, the dog", None, "", "  ", "dog " * 300, "!!! ???", "zebra quux été"]


def test_counts_and_scores_match_brute_force(spark, documents):
    docs = documents(list(enumerate(TEXTS)) + [(1, TEXTS[1])])
    model = P.learn(docs, classes=16, endings=5, cells=8, steps=40)
    assert model.classes.frequent[:2] == ("dog", "the")
    size = model.classes.size
    table = model.triple_log_p.reshape(size, size, size)
    assert np.allclose(np.exp(table).sum(axis=1), 1.0, atol=1e-4)  # over the token, given both sides
    assert np.allclose(np.exp(model.cell_log_p.reshape(5, 8)).sum(axis=1), 1.0)
    codes = P.Codes(model.classes)
    for r in P.scored(docs, model).collect():
        words = P.tokens_of(TEXTS[r.doc_id])
        c = codes.document(TEXTS[r.doc_id])
        around = [0, *model.classes.of(c), 0]
        want = sum(table[around[i], around[i + 1], around[i + 2]] for i in range(len(words)))
        want += sum(model.cell_log_p[x - 1 - len(model.classes.frequent)] for x in c if x > len(model.classes.frequent))
        assert r.n_tokens == len(words) and math.isclose(r.log_prob, want, rel_tol=1e-5, abs_tol=1e-6)
        assert r.mean_log_prob is None if not words else math.isclose(r.mean_log_prob, want / len(words), rel_tol=1e-5)


def test_window_counts_cover_all_documents(spark, documents):
    rows = [(i, "a b c" if i % 2 else "c b a b") for i in range(500)]
    classes = P.Classes(("a", "b", "c"), 2, 4)
    windows, cells = P.window_counts(P.doc_rows(documents(rows)), classes)
    n = windows.reshape(6, 6, 6)
    assert windows.sum() == 250 * 3 + 250 * 4 and cells.sum() == 0
    assert n[0, 1, 2] == 250 and n[2, 1, 2] == 250 and n[1, 2, 3] == 250 and n[1, 2, 0] == 250


def test_training_learns_the_context():
    size = 4
    counts = np.zeros((size, size, size))
    counts[1, 2, 1], counts[2, 3, 2], counts[1, 3, 2] = 50, 50, 50
    log_p = P.train(counts.reshape(-1), size).reshape(size, size, size)
    assert log_p[1, 2, 1] > math.log(0.9) and log_p[2, 3, 2] > math.log(0.9)


def test_empty(spark, documents):
    assert P.scored(documents([]), classes=8, endings=2, cells=4, steps=2).count() == 0
    got = P.scored(documents([(1, None)]), classes=8, endings=2, cells=4, steps=2).collect()
    assert [(r.n_tokens, r.log_prob, r.mean_log_prob) for r in got] == [(0, 0.0, None)]
