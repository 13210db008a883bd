"""Benchmark decontamination by winnowing (DataFrame and SQL functions only).

A window is ``span`` consecutive benchmark words (10). Winnowing keeps, of the
``span - k + 1`` k-gram hashes inside a window, the smallest: two equal windows
keep the same fingerprint, so every shared span of ``span`` words is found. An
item of fewer than ``span`` words is one window of its own length and its
fingerprint is the hash of that window.

1. Benchmark: distinct windows, their fingerprints, and the items of each window.
2. Documents, first pass: words -> word hashes -> k-gram hashes -> sliding
   minimum; the distinct fingerprints (32 bits) of each document are stored.
3. Stored fingerprints join the benchmark's. Only documents with a common
   fingerprint are read again; their hits are extended to whole windows, whose
   words join the benchmark's windows as text, so a collision never counts.
4. Per document: union of the hit positions, distinct items.

Defined cases: null or word-free text has no words (0, 0, 0, sha of the empty
list, false). Rows repeating doc_id and text get equal results. An empty
benchmark or document table gives no hits or no rows. An item with a null id
marks words but is not listed or counted. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import doc_rows, small, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN, GRAM = 10, 5


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of 0-9, a-z and all characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _zip(df: DataFrame, out: str, a: str, b: str, shift: int, fn) -> DataFrame:
    """out[i] = fn(a[i], b[i + shift]) wherever both exist."""
    left = F.slice(F.col(a), F.lit(1), F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0)))
    right = F.slice(F.col(b), F.lit(shift + 1), F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0)))
    return df.withColumn(out, F.zip_with(left, right, fn))


def _mix(a: Column, b: Column) -> Column:
    return F.hash(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _gram_hashes(df: DataFrame, out: str, n: int) -> DataFrame:
    """``out``: hashes of all n-grams of column ``wh`` (word hashes), by doubling."""
    if n == 1:
        return df.withColumn(out, F.col("wh"))
    have, width, steps = "wh", 1, []
    while width * 2 <= n:
        name = f"{out}_p{width * 2}"
        df = _zip(df, name, have, have, width, _mix)
        steps.append(name)
        have, width = name, width * 2
    if width < n:  # overlap the last block: together they span n words
        df = _zip(df, f"{out}_x", have, have, n - width, _mix)
        steps.append(f"{out}_x")
        have = f"{out}_x"
    return df.withColumn(out, F.col(have)).drop(*steps)


def _winnowed(df: DataFrame, out: str, span: int, gram: int) -> DataFrame:
    """``out``[i]: the smallest of the ``gram``-gram hashes inside the window of ``span`` words at i."""
    df = _gram_hashes(df, "kg", gram)
    need, have, width, steps = span - gram + 1, "kg", 1, ["kg"]
    while width * 2 <= need:
        df = _zip(df, f"mn{width * 2}", have, have, width, _smaller)
        have, width = f"mn{width * 2}", width * 2
        steps.append(have)
    if width < need:
        df = _zip(df, "mnx", have, have, need - width, _smaller)
        have = "mnx"
        steps.append(have)
    return df.withColumn(out, F.col(have)).drop(*[s for s in steps if s != out])


def _fingerprints(df: DataFrame, out: str, length: int, span: int, gram: int) -> DataFrame:
    if length == span:
        return _winnowed(df, out, span, gram)
    df = _gram_hashes(df, f"{out}_g", length)
    return df.withColumn(out, F.transform(f"{out}_g", lambda h: F.hash(h, F.lit(length)))).drop(f"{out}_g")


def _windows(df: DataFrame, length: int) -> Column:
    return F.transform(F.col("starts"), lambda s: F.array_join(F.slice(F.col("words"), s + 1, F.lit(length)), " "))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(item_id, length, gram_text, fp): every window of every item with its fingerprint."""
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
             .where(F.size("words") > 0))
    items = stored(items, "benchmark-words")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(span)).alias("n")).distinct().collect()]
    parts = []
    for n in sorted(lengths):
        df = items.where(F.size("words") == n) if n < span else items.where(F.size("words") >= span)
        df = df.withColumn("wh", F.transform("words", lambda w: F.hash(w)))
        df = _fingerprints(df, "fp", n, span, gram)
        df = df.withColumn("starts", F.sequence(F.lit(0), F.size("words") - n))
        df = df.select("item_id", F.explode(F.arrays_zip(_windows(df, n).alias("t"), F.col("fp").alias("fp"))).alias("z"))
        parts.append(df.select("item_id", F.lit(n).alias("length"), F.col("z.t").alias("gram_text"),
                               F.col("z.fp").alias("fp")))
    if not parts:
        return items.select("item_id", F.lit(span).alias("length"), F.lit("").alias("gram_text"),
                            F.lit(0).alias("fp")).limit(0)
    return stored(reduce(DataFrame.unionByName, parts).distinct(), "benchmark-windows")


def _word_rows(docs: DataFrame) -> DataFrame:
    return doc_rows(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))


def _hashed(df: DataFrame, lengths: list[int], span: int, gram: int) -> DataFrame:
    """Adds fp{n}, the fingerprints of all windows of n words, for every length n."""
    df = df.select("*", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.hash(w)).alias("wh"))
    for n in lengths:
        df = _fingerprints(df, f"fp{n}", n, span, gram)
    return df


def document_fingerprints(docs: DataFrame, lengths: list[int], span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, n_words, fps): the distinct fingerprints of every document, stored."""
    df = _hashed(_word_rows(docs), lengths, span, gram)
    none = F.array().cast("array<int>")
    fps = F.array_distinct(F.concat(none, *[F.col(f"fp{n}") for n in lengths])) if lengths else none
    return stored(df.select("doc_id", "text_hash", "n_words", fps.alias("fps")), "decontaminate-fingerprints")


def _matched_starts(fingerprints: str) -> Column:
    return F.array_compact(F.transform(fingerprints, lambda h, i: F.when(F.array_contains(F.col("matched"), h), i)))


def _window_structs(starts: str, length: int) -> Column:
    return F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.lit(length).alias("length"),
        F.array_join(F.slice(F.col("words"), s + 1, F.lit(length)), " ").alias("gram_text")))


def possible_hits(docs: DataFrame, seen: DataFrame, windows: DataFrame, lengths: list[int], span: int = SPAN,
                  gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, start, length, gram_text) of windows whose fingerprint the benchmark has."""
    fps = windows.select("fp").distinct()
    matched = (seen.select("doc_id", "text_hash", F.explode("fps").alias("fp")).join(small(fps, fps.count()), "fp")
               .groupBy("doc_id", "text_hash").agg(F.collect_set("fp").alias("matched")))
    matched = stored(matched, "decontaminate-matched")
    keys = matched.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "matched")
    rows = doc_rows(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(small(keys, matched.count()),
                     rows["doc_id"].eqNullSafe(keys["k_id"]) & (rows["text_hash"] == keys["k_hash"]))
    df = rows.select("doc_id", "text_hash", "matched", words_of(F.col("text")).alias("words"))
    df = _hashed(df, lengths, span, gram)
    for n in lengths:
        df = df.withColumn(f"at{n}", _matched_starts(f"fp{n}")).drop(f"fp{n}")
    none = F.array().cast("array<struct<start:int,length:int,gram_text:string>>")
    return (df.select("doc_id", "text_hash", F.explode(F.concat(none, *[_window_structs(f"at{n}", n) for n in lengths]))
                      .alias("h")).select("doc_id", "text_hash", "h.start", "h.length", "h.gram_text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, items (sorted ids), hit_positions."""
    windows = benchmark_windows(benchmark, span, gram)
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    per_window = windows.groupBy("length", "gram_text").agg(F.collect_set("item_id").alias("window_items"))
    seen = document_fingerprints(docs, lengths, span, gram)
    hits = possible_hits(docs, seen, windows, lengths, span, gram)
    n_windows = per_window.count()
    hits = hits.join(small(per_window, n_windows), ["length", "gram_text"])
    marked = hits.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"),
        F.collect_set("window_items").alias("lists"))
    marked = marked.select(
        F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).alias("hit_positions"),
        F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))
    kept = seen.drop("fps")
    return kept.join(marked, kept["doc_id"].eqNullSafe(marked["m_id"]) & (kept["text_hash"] == marked["m_hash"]),
                     "left").select(
        "doc_id", "text_hash", "n_words",
        F.coalesce(F.size("hit_positions"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hit_positions", F.array().cast("array<int>")).alias("hit_positions"))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of ``decontaminate``."""
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no benchmark window."""
    result = decontaminate(docs, benchmark, **options)
    bad = result.where(F.col("n_hit") > 0).select(F.col("doc_id").alias("bad_id"),
                                                  F.col("text_hash").alias("bad_hash")).distinct()
    bad = stored(bad, "decontaminate-bad")
    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    return docs.join(small(bad, bad.count()), F.col("doc_id").cast("long").eqNullSafe(bad["bad_id"]) &
                     (F.xxhash64(text.cast("string")) == bad["bad_hash"]), "left_anti")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
             FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, s, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN i USING (rid)
"""
