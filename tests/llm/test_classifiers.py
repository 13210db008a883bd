import math
import random
import zlib

import numpy as np
import pytest

from cropframe.llm import calibrate, quality, toxicity

RND = random.Random(9)
ORDINARY = ["".join(RND.choice("abcdefgh") for _ in range(6)) for _ in range(60)]


def prose(n):
    return " ".join(RND.choice(ORDINARY) for _ in range(n))


def test_isotonic_is_least_squares():
    x, y = np.array([1, 2, 2, 3, 4, 5.0]), np.array([0, 1, 0, 0, 1, 1.0])
    fit = calibrate.applied(calibrate.isotonic(x, y), x)
    assert np.all(np.diff(fit) >= 0)
    assert np.allclose(fit, [0, 1 / 3, 1 / 3, 1 / 3, 1, 1], atol=2e-3)


@pytest.fixture(scope="module")
def toxic_rows():
    rows = []
    for i in range(400):
        words = prose(60).split()
        if i % 4 == 0:
            for _ in range(3):
                words[RND.randrange(60)] = RND.choice(["vilex", "grotz"])
        rows.append((i, " ".join(words)))
    return rows


def test_toxicity_finds_held_out(spark, documents, toxic_rows):
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i, _ in toxic_rows] + [(None, 1, "x"), (5, None, "x")],
                                   "doc_id long, toxic int, text string")
    extra = [(900, None), (901, ""), (902, "--- !"), (0, toxic_rows[0][1]), (903, "vilex " + prose(5)), (None, "vilex")]
    got = toxicity.scored(documents(toxic_rows + extra), labels).collect()
    assert len(got) == len(toxic_rows) + len(extra)
    by_id = {r.doc_id: r for r in got}
    for i, _ in toxic_rows:
        assert by_id[i].predicted == int(i % 4 == 0)
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(0 <= r.score <= 1 for r in got)
    assert by_id[900].score == by_id[901].score == by_id[902].score < 0.5
    kept = toxicity.civil_documents(documents(toxic_rows), labels)
    assert kept.count() == 300 and kept.columns == documents([]).columns


def test_toxicity_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(documents([(1, "a"), (2, None)]), labels).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.scored(documents([(0, "a"), (2, "b")]), one).collect())
    assert toxicity.scored(documents([]), labels).count() == 0


def brute_force_ratios(rows, min_count, deviations, prior):
    """words, pairs of (text, toxic) rows, from the formulas."""
    alone, paired = [{}, {}], [{}, {}]
    for text, toxic in rows:
        words = toxicity.words_of(text)
        for counts, found in ((alone, set(words)), (paired, set(zip(["", *words], words)))):
            for e in found:
                counts[toxic][e] = counts[toxic].get(e, 0) + 1

    def departed(n_t, n_o, all_t, all_o, backoff):
        n = n_t + n_o
        if n < min_count or not all_t or not all_o:
            return None
        share = all_t * math.exp(backoff) / (all_t * math.exp(backoff) + all_o)
        left = abs(n_t - n * share) - deviations * math.sqrt(n * share * (1 - share))
        if left <= 0:
            return None
        kept = n * share + math.copysign(left, n_t - n * share)
        return math.log((kept + prior * share) / (n - kept + prior * (1 - share))) - math.log(all_t / all_o)

    every = [sum(c.values()) for c in alone]
    words = {w: departed(alone[1].get(w, 0), alone[0].get(w, 0), every[1], every[0], 0.0) for w in {*alone[0], *alone[1]}}
    words = {w: r for w, r in words.items() if r is not None}
    pairs = {}
    for before, word in {*paired[0], *paired[1]}:
        of = [sum(n for e, n in c.items() if e[0] == before) for c in paired]
        backoff = words.get(word, 0.0)
        r = departed(paired[1].get((before, word), 0), paired[0].get((before, word), 0), of[1], of[0], backoff)
        if r is not None:
            pairs[before, word] = r - backoff
    return words, pairs


def test_toxicity_ratios_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        toxic = int(i % 3 == 0)
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 25))]
        for at in range(0, len(words) - 2, 5):
            words[at:at + 2] = rnd.choice(["xy", "yx"] if rnd.random() < 0.3 else ["xy"] if toxic else ["yx"])
        if toxic and words:
            words[rnd.randrange(len(words))] = "vilex"
        rows.append((i % toxicity.FOLDS, toxic, " ".join(words)))
    counts = toxicity.counts_of(spark.createDataFrame(rows, "fold int, toxic int, text string"))
    *crossed, whole = toxicity.ratios_of(*toxicity.fitted(counts.cache(), 3, 2.0, 1.0))
    for model, left_out in [*zip(crossed, range(toxicity.FOLDS)), (whole, None)]:
        words, pairs = brute_force_ratios([(t, k) for f, k, t in rows if f != left_out], 3, 2.0, 1.0)
        assert "vilex" in words and ("x", "y") in pairs
        assert model.words == pytest.approx(words) and model.pairs == pytest.approx(pairs)


def held_out_accuracy(spark, documents, rows):
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    got = [r for r in toxicity.scored(documents([r[:2] for r in rows]), labels, 0.5).collect() if r.held_out]
    truth = {i: k for i, _, k in rows}
    return sum(r.predicted == truth[r.doc_id] for r in got) / len(got)


def test_toxicity_of_many_mild_words(spark, documents):
    """Every word is at most four times likelier in one of the classes."""
    rnd = random.Random(5)
    halves = [[f"{c}{i}q" for i in range(40)] for c in "ab"]
    rows = [(i, " ".join(rnd.choice(halves[rnd.random() < (0.8 if i % 2 else 0.2)]) for _ in range(40)), i % 2)
            for i in range(900)]
    assert held_out_accuracy(spark, documents, rows) > 0.9


def test_toxicity_of_word_order(spark, documents):
    """Both classes hold the same words equally often; only their order tells."""
    rnd = random.Random(6)

    def text(toxic):
        words = [f"w{rnd.randrange(30)}" for _ in range(30)]
        for at in (3, 13, 23):
            a, b = rnd.choice([("red", "dog"), ("old", "cat"), ("big", "hen")])
            words[at:at + 2] = (b, a) if toxic else (a, b)
        return " ".join(words)

    assert held_out_accuracy(spark, documents, [(i, text(i % 2), i % 2) for i in range(600)]) > 0.9


def test_toxicity_sample_holds_one_row_of_a_doc_id(spark, documents, toxic_rows):
    """A labelled row repeated over more than half of all rows teaches once."""
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in toxic_rows], "doc_id long, toxic int")
    once = {r.doc_id: r.score for r in toxicity.scored(documents(toxic_rows), labels).collect()}
    many = toxicity.scored(documents(toxic_rows + [toxic_rows[4]] * 600), labels).collect()
    assert len(many) == len(toxic_rows) + 600 and all(r.score == once[r.doc_id] for r in many)


def test_toxicity_short_and_very_long_texts(spark, documents, toxic_rows):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in toxic_rows], "doc_id long, toxic int")
    clean, rude = prose(100_000), " ".join(["vilex", "grotz"] * 50_000)
    model = toxicity.learn(documents(toxic_rows), labels)
    assert model.score("vilex") >= 0.7 and model.score(rude) >= 0.7
    assert all(model.score(w) < 0.7 for w in ORDINARY) and model.score(clean) < 0.7
    assert model.score("never seen words " + "z" * 50_000) < 0.7


def test_quality_finds_held_out(spark, documents):
    rows = [(i, prose(80) + ". " + prose(30) if i % 5 else " ".join(w.upper() + "!!" for w in prose(90).split()))
            for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, _ in rows] + [(None, 1), (3, None)],
                                   "doc_id long, quality int")
    extra = [(900, None), (901, ""), (902, " \n "), (0, rows[0][1])]
    got = {r.doc_id: r for r in quality.scored(documents(rows + extra), labels).collect()}
    for i, _ in rows:
        assert got[i].predicted == int(i % 5 > 0)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[900].score == got[901].score == got[902].score
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = quality.good_documents(documents(rows), labels)
    assert kept.count() == 320 and kept.columns == documents([]).columns


def test_quality_normal_equations_match_direct_solution(spark, documents):
    rows = [(i, prose(10 + i % 50) + "#" * (i % 7)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 7 < 4)) for i, _ in rows], "doc_id long, quality int")
    model = quality.learn(documents(rows), labels, features=20)
    used = [(t, int(i % 7 < 4)) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    z = model.features(np.stack([quality.statistics(t) for t, _ in used]))
    beta = np.linalg.solve(z.T @ z + 1e-2 * np.eye(21), z.T @ np.array([y for _, y in used], float))
    assert np.allclose(beta, model.beta, rtol=1e-5, atol=1e-6)


def test_quality_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.scored(documents([(1, "a")]), labels).collect()] == [0.0]
    assert quality.scored(documents([]), labels).count() == 0


def test_toxicity_reads_whole_words_and_runs(spark, documents):
    """The telling part stands behind letter 12 of a word, or anywhere in text without spaces."""
    rnd = random.Random(12)
    signs = [chr(0x4E00 + i) for i in range(40)]

    def unspaced(toxic):
        run = [rnd.choice(signs) for _ in range(60)]
        if toxic:
            for at in (20, 33, 47):
                run[at:at + 3] = "\u7000\u7001\u7002"
        return "".join(run)

    def spaced(toxic):
        words = [rnd.choice(ORDINARY) for _ in range(40)]
        for at in (5, 18, 31):
            words[at] = "gemeinschaftsz" + ("vilex" if toxic else "grund")
        return " ".join(words)

    for text in (unspaced, spaced):
        rows = [(i, text(i % 4 == 0)) for i in range(300)]
        labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
        got = toxicity.scored(documents(rows), labels).collect()
        assert [r.doc_id for r in got if r.predicted != int(r.doc_id % 4 == 0)] == []


def test_toxicity_counts_stay_bounded(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(toxicity, "HELD", 1000)
    rnd = random.Random(13)
    words = [f"w{rnd.randrange(2000)}" for _ in range(5000)]
    frame = pd.DataFrame({"fold": [0], "toxic": [1], "text": [" ".join(words)]})
    parts = list(toxicity._expression_counts([frame]))
    assert len(parts) > 5 and max(map(len, parts)) <= 1000
    got = pd.concat(parts)
    assert set(got["word"][got["before"].isna()]) == set(words) and len(got) == got["n"].sum()
    assert len(got) == len(set(words)) + len(set(zip(["", *words], words)))
