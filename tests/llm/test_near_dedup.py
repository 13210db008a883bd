import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cropframe.llm import near_dedup as M


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            old = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(row[j + 1], row[j])
            before = old
    return row[-1]


def similar(a, b):
    matched = lcs(list(a), list(b))
    return matched / (len(a) + len(b) - matched)


def five_words(text):
    """Runs of five words as tuples, in plain Python."""
    words = re.findall(r"\w+", text.lower())
    return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def planted(seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(20, 200))]
        if g % 3 == 0:
            base = base + passage
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 60))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append(" ".join(copy).upper())
    return list(enumerate(rows + ["one two", "One, two!", "three", "***", "***", "###"]))


def classes(rows):
    """Brute force: components of the links at 0.8 by a full alignment table of the raw five-word runs."""
    s = [five_words(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1]
            close = s[i] and s[j] and min(len(s[i]), len(s[j])) >= 0.8 * max(len(s[i]), len(s[j])) and set(s[i]) & set(s[j])
            if same or (close and similar(s[i], s[j]) >= 0.8):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_classes_match_brute_force(documents):
    rows = planted()
    got = M.near_classes(documents(rows)).collect()
    want = classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert all(r.class_size == sizes[r.class_id] for r in got)


def test_split_buckets_change_nothing(documents):
    rows = planted(2)
    got = M.near_classes(documents(rows), big=1).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)


def test_one_per_class_and_defined_cases(documents):
    a = " ".join(f"w{i}" for i in range(40))
    docs = documents([(5, a), (2, a.upper()), (2, a.upper()), (None, a), (7, None), (None, None), (8, ""), (9, ""), (None, "solo x")])
    got = M.near_classes(docs).collect()
    assert len(got) == 9
    assert {r.class_id for r in got if r.class_size == 4} == {2}
    kept = sorted(((r.doc_id, r.text) for r in M.one_per_class(docs).collect()), key=str)
    assert kept == sorted([(2, a.upper()), (7, None), (None, None), (8, ""), (None, "solo x")], key=str)
    assert M.one_per_class(docs).columns == docs.columns
    assert M.near_classes(documents([])).count() == 0


def test_alignment_of_raw_sequences():
    rnd = random.Random(4)
    for _ in range(1500):
        letters = rnd.choice([2, 5, 30])
        a = [rnd.randrange(letters) for _ in range(rnd.randint(1, 60))]
        b = a[rnd.randint(0, 3):] + a[:rnd.randint(0, 5)]
        for _ in range(rnd.randint(0, 4)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(letters))
        if not b:
            continue
        matched = lcs(a, b)
        want = matched / (len(a) + len(b) - matched)
        got = M.aligned_similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert abs(got - want) < 1e-12 if want >= 0.8 else got == 0.0


def test_every_occurrence_counts(documents):
    p, x, y = ([f"{c}{i}" for i in range(n)] for c, n in (("p", 20), ("x", 40), ("y", 60)))
    once = [f"o{i}" for i in range(60)]
    line = [f"l{i}" for i in range(12)]
    rows = [(0, p + x + p + y), (1, x + p + y), (2, once + line * 2), (3, once + line * 40)]
    s = [M.shingles(" ".join(t), M.WordHashes()) for _, t in rows]
    matched = lcs(s[0].tolist(), s[1].tolist())
    assert matched / (len(s[0]) + len(s[1]) - matched) > 0.85
    got = M.near_classes(documents([(i, " ".join(t)) for i, t in rows])).collect()
    assert {r.doc_id: r.class_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_listed_buckets_stay_whole(spark):
    """Seven nodes share one band only; every pair across components is listed whatever the block size."""
    nodes = spark.createDataFrame([(bytes([x]), 50, [1] * 32, [7] + [100 * x + i for i in range(31)]) for x in range(7)],
                                  "node binary, n int, firsts array<int>, bands array<long>")
    labels = spark.createDataFrame([(bytes([x]), bytes([0])) for x in range(3)] + [(bytes([x]), bytes([4])) for x in (4, 5)],
                                   "node binary, component binary")
    members = M._contested(nodes.selectExpr("node", "bands[0] as bucket"), labels)
    assert {(r["size"], r["outer"]) for r in members.collect()} == {(7, 4)}
    of = {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    want = sorted((x, y) for x in of for y in of if x < y and of[x] != of[y])
    for big in (1, 2, 4096):
        got = M._listed(members, nodes, 0.8, 14, big).collect()
        assert sorted((r.a[0], r.b[0]) for r in got) == want


def test_common_counts_equal_sets():
    rnd = random.Random(6)
    lists = [M.numbered(np.array([rnd.randrange(60) for _ in range(rnd.randint(1, 40))], np.uint64)) for _ in range(80)]
    for least in (0.2, 0.5, 0.8):
        want = set()
        for i in range(15):
            for j in range(15, 80):
                x, y = set(lists[i].tolist()), set(lists[j].tolist())
                if len(x & y) >= least * len(x | y):
                    want.add((i, j - 15))
        assert set(M.common_counts(lists[:15], lists[15:], least)) == want


def group(seed, copies=60):
    """Copies of one text at many distances, on both sides of 0.8 to each other, and some with a block moved."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(copies):
        copy = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 6, 8, 10])):
            at = rnd.randrange(len(copy))
            if rnd.random() < 0.5:
                copy[at] = rnd.choice(vocab)
            else:
                copy[at:at + 1] = [rnd.choice(vocab)] * rnd.randint(0, 2)
        if i % 10 == 0:
            copy = copy[70:] + copy[:70]
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("met", [0, 1000])
def test_fields_met_in_blocks_equal_listed_buckets_and_brute_force(documents, monkeypatch, met):
    """met 0: every bucket is listed; 1000: every field that holds enough pairs meets in (small) blocks."""
    monkeypatch.setattr(M, "MET_PER_LISTED", met)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 1500)
    rows = group(3) + [(i + 100, t) for i, t in group(4, 40)]
    got = M.near_classes(documents(rows)).collect()
    want = classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want and len(set(want.values())) > 8


def test_recall_of_links_against_brute_force(documents):
    """Links at 0.8 whose ends share a class, over several planted groups."""
    rows = [(1000 * g + i, t) for g in range(2) for i, t in group(20 + g, 40)]
    found = {r.doc_id: r.class_id for r in M.near_classes(documents(rows)).collect()}
    links = hits = 0
    for g in range(2):
        own = [(i, five_words(t)) for i, t in rows if i // 1000 == g]
        for x in range(len(own)):
            for y in range(x):
                if similar(own[x][1], own[y][1]) >= 0.8:
                    links += 1
                    hits += found[own[x][0]] == found[own[y][0]]
    assert links > 60 and hits == links
