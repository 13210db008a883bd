"""Hard-negative mining against integer sums in plain Python and its SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from cropframe.llm import hard_negatives as M

SCHEMA = "vec_id long, embedding array<float>, label int, score double, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.5, "x") for i, v, l in rows], SCHEMA)


def brute(rows, positives=5, negatives=10):
    """Rows take part once per vec_id."""
    use = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        assert i not in use
        use[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for a in sorted(i for i in use if i % 100 == 0):
        label, q = use[a]
        near = sorted((-sum(x * y for x, y in zip(q, w)), i, l) for i, (l, w) in use.items() if i != a)
        for s, p, _ in [x for x in near if x[2] == label][:positives]:
            fit = [(n, i) for n, i, l in near if l != label and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(map(tuple, M.mine(table(spark, rows), **options).collect()))


def vectors(n, dims, seed, spread=1.0):
    random.seed(seed)
    return [(i, [random.gauss(0.2, 1) * spread for _ in range(dims)], random.randrange(10)) for i in range(n)]


def test_planes_and_tables_give_exact_products():
    random_ = np.random.default_rng(3)
    for bits in (1, 2, 9, 20):
        low, high = -(1 << (bits - 1)), 1 << (bits - 1)
        a, c = random_.integers(low, high, (7, 24)), random_.integers(low, high, (30, 24))
        assert (M.integers_of(M.planes_of(c, bits)) == c).all()
        assert (M.scores(M.subset_sums(a), M.planes_of(c, bits)) == c @ a.T).all()


@pytest.mark.parametrize("dims,spread", [(5, 1.0), (16, 0.05), (11, 900.0)])
def test_matches_brute_force(spark, dims, spread):
    rows = vectors(420, dims, dims, spread)
    assert mined(spark, rows, block_rows=64, anchor_rows=2) == brute(rows) != []


def test_defined_cases(spark):
    rows = vectors(210, 4, 5)
    rows += [(300, None, 1), (301, [1.0, None, 2.0, 3.0], 1), (302, [1.0, float("nan"), 0.0, 0.0], 1), (303, [float("inf")] * 4, 1),
             (304, [1.0] * 4, None), (None, [9.0] * 4, 1), (400, [0.0] * 4, 3), (500, [], 3), (600, [2.0], 3), (601, [2.0, 1.0], 2)]
    assert mined(spark, rows) == brute(rows)


def test_ties_go_to_smaller_ids(spark):
    rows = [(100, [1.0, 0.0], 1)] + [(i, [1.0, 0.0], 1) for i in range(1, 9) if i != 7] + [(i, [0.5, 0.0], 2 - (i % 7 == 0)) for i in range(15, 40)]
    got = mined(spark, rows, block_rows=4)
    assert got == brute(rows)
    assert {r[1] for r in got} == {1, 2, 3, 4, 5}
    assert [r[3] for r in got if r[1] == 1] == list(range(15, 25))


def test_repeated_rows_count_once(spark):
    rows = vectors(210, 4, 6)
    again = rows + [rows[0]] * 3 + [rows[9]] * 40 + [(9, [50.0] * 4, 11)]
    assert mined(spark, again) == brute(rows)


def test_scores_beyond_a_long_take_no_part(spark):
    rows = vectors(120, 3, 8)
    assert mined(spark, rows + [(200, [1e30, 1.0, 1.0], 1), (201, [-1e9, 0.0, 0.0], 1)]) == brute(rows)


def test_few_rows_and_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 0), (1, [1.0], 1), (2, [0.5], 2)]) == brute([(0, [1.0], 0), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 32768)]


def test_equals_sql(spark):
    rows = vectors(300, 6, 9) + [(900, None, 1), (901, [float("nan")] * 6, 2), (902, [1.0] * 6, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert mined(spark, rows) == sorted(con.execute(M.SQL).fetchall())
