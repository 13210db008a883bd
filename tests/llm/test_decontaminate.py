import hashlib
import random
import re

from cropframe.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                key = tuple(w[i:i + n])
                if key in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, documents):
    rnd = random.Random(5)
    vocab = ["a", "b", "The", "Él", "x9", "été", "zu", "10"]

    def text(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    items = [(i, text(rnd.choice([0, 3, 9, 10, 11, 25]))) for i in range(25)] + [(30, None), (31, ""), (7, "one two")]
    docs = [(i, text(rnd.choice([0, 2, 9, 10, 40]))) for i in range(60)]
    docs += [(100 + i, text(20) + " -- " + (items[i][1] or "").replace(" ", "\n,") + " " + text(5)) for i in range(20)]
    docs += [(200, None), (201, ""), (None, items[3][1]), (3, docs[3][1]), (3, "THE one TWO"), (202, text(3000))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = D.digest(D.decontaminate(documents(docs), bench)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id int, text string")
    got = D.digest(D.decontaminate(documents([(1, "some words here")]), bench)).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got] == [(1, 3, 0, False)]
    bench = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert D.decontaminate(documents([]), bench).count() == 0


def test_clean_documents_keep_all_columns(spark, documents):
    bench = spark.createDataFrame([(1, " ".join(map(str, range(12))))], "item_id int, text string")
    leak = "x " + " ".join(map(str, range(1, 12)))
    docs = documents([(1, leak), (2, "clean"), (3, None), (None, leak), (2, "clean")])
    kept = D.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(2, "clean"), (2, "clean")]
    assert kept.count() == 3
