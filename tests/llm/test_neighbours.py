import numpy as np

from cropframe.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5, every=50):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            score = N.cosines(v, x)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(spark, rows, **options):
    got = N.search(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), **options).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.6 * random.normal(size=16)]) for i in range(3000)]
    want, got = brute(rows), found(spark, rows, leaf_rows=32, block_rows=200)
    assert set(got) == set(want)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.9
    scores = {q: dict(N_) for q, N_ in want.items()}
    assert all(abs(s - scores[q][v]) < 1e-12 for q in got for v, s in got[q] if v in scores[q])


def test_all_leaves_equal_brute_force_with_hot_vector(spark):
    random = np.random.default_rng(6)
    hot = [float(x) for x in random.normal(size=8)]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in random.normal(size=8)]) for i in range(900)]
    assert found(spark, rows, recall=1.0, calibration_queries=900, block_rows=100) == brute(rows)


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [2.0, 0.1]), (50, [0.0, 3.0]),
            (6, [1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [])]
    assert found(spark, rows) == brute([r for r in rows if r[0] != 6])
    assert found(spark, []) == {}
    only = found(spark, [(0, [1.0, 2.0])])
    assert only == {}


def test_repeated_rows_equal_brute_force(spark):
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.normal(size=8)]) for i in range(400)]
    rows += [r for r in rows if r[0] % 100 == 0] * 2 + [r for r in rows if r[0] % 7 == 0]
    assert found(spark, rows, recall=1.0, calibration_queries=len(rows), block_rows=50) == brute(rows)


def test_repeated_rows_in_queries_searched_in_all(spark):
    random = np.random.default_rng(9)
    rows = [(i, [float(x) for x in random.normal(size=4)]) for i in range(60)]
    rows += [r for r in rows if r[0] % 3 == 2] * 2 + [r for r in rows if r[0] == 0]
    assert found(spark, rows, recall=0.01, leaf_rows=1) == brute(rows)


def test_id_with_several_vectors_asks_with_the_smallest(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(1, 30)]
    one, other = [-1.0, 0.5], [1.0, 0.2]
    want = brute([*rows, (50, one)])
    assert found(spark, [*rows, (50, other), (50, one), (50, other)], recall=1.0, calibration_queries=60) == want


def test_cosines_of_huge_and_tiny_components_are_finite():
    rnd = np.random.default_rng(5)
    x, q = rnd.normal(size=(40, 6)), rnd.normal(size=6)
    plain = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    assert (N.cosines(q, x) == plain).all()  # a power of two changes no bit
    for factor in (2.0**700, 2.0**-700):
        assert (N.cosines(q * factor, x * factor) == plain).all()
