"""Fill-in-the-middle against a unit-by-unit split, an exact round trip and its SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cropframe.llm import fill_middle as M

TEXTS = [None, "", "a", " ", "\n", "abc def", "Ärger und ß, 12 x\n\n y", "日本語 text 😀 end", "tie tie tie", "tie tie tie",
         "has <P> inside", "has <S>", "x<M>y", "<", "ends with <P", "S>", "<<P<S<M", "P>S>M> <", "abc" * 1000, "a1" * 40_000]


def units_of(text):
    """One character after the other."""
    out = []
    for c in text:
        letter = c.isascii() and c.isalpha()
        if letter and out and out[-1][-1].isascii() and out[-1][-1].isalpha():
            out[-1] += c
        else:
            out.append(c)
    return out


def plainly(doc_id, text):
    text = text or ""
    units = units_of(text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def rows():
    found = [(i * len(TEXTS) + j, t) for i in range(12) for j, t in enumerate(TEXTS)]
    return found + [(None, "no id"), found[5], found[5]]


def test_matches_unit_by_unit_split(spark, documents):
    got = M.transform(documents(rows())).collect()
    assert len(got) == len(rows())
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (i, t) in zip(sorted(got, key=key), sorted(rows(), key=key)):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(i, t), (i, t and t[:40])
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_restores_every_text(spark, documents):
    made = M.transform(documents(rows())).withColumn("text", M.restored(F.col("output"), F.col("form")))
    want = {i: t or "" for i, t in rows()}
    assert all(r.text == want[r.doc_id] for r in made.select("doc_id", "text").collect())


@pytest.mark.parametrize("rate,spm", [(100, 0), (100, 100), (0, 50)])
def test_rates(spark, documents, rate, spm):
    forms = {r.form for r in M.transform(documents([(i, "some text") for i in range(30)]), rate=rate, spm_rate=spm).collect()}
    assert forms == ({"plain"} if rate == 0 else {"spm"} if spm else {"psm"})


def test_digest_equals_sql(spark, documents):
    found = [(i, t) for i, t in rows() if t is None or len(t) < 4000]
    got = sorted(map(tuple, M.digest(M.transform(documents(found))).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", found)
    assert got == sorted(con.execute(M.SQL).fetchall(), key=str)


def test_empty_table(spark, documents):
    assert M.digest(M.transform(documents([]))).count() == 0


def test_slices_keep_all_rows(spark, documents, monkeypatch):
    monkeypatch.setattr(M, "SLICE_CHARS", 10)
    assert M.transform(documents([(i, "abc def") for i in range(50)])).count() == 50
