"""Near-duplicates by Order MinHash, verified by banded alignment.

1. Words are runs of word characters, lower-cased; ``k`` of them (5) make a
   shingle (a shorter text is one shingle). The j-th occurrence of a shingle is
   labelled j for the sketch. Texts of equal words are one node.
2. Each of ``bands`` permutations takes the ``picks`` smallest labelled shingles
   and hashes them in text order: nodes of one band value share a bucket. At
   similarity 0.8 a pair shares none of 32 buckets of 4 with probability 5e-8.
3. Round one pairs every node with the smallest node of each of its buckets, so a
   bucket of n nodes gives n pairs. Pairs whose lengths or smallest hashes rule
   out the similarity are dropped; the rest are aligned, one per node first, the
   others only if their ends are not yet connected (round two likewise).
4. Round two takes the buckets whose nodes are still in different components and
   pairs nodes across components: a pair has an end outside the largest one, so these
   outer nodes meet the others. Buckets of one large group overlap, and listing each
   would make a pair once for each bucket. Buckets that share components are therefore
   gathered to a field; where it is cheaper, the field's outer nodes meet all its nodes
   once, in blocks of about ``BLOCK_SHINGLES`` shingles, and an exact count of common
   shingles (no alignment can match more) rules pairs out before any is listed. In the
   other fields pairs are listed bucket by bucket, in blocks of ``big``, under the
   conditions of step 3. Both see every pair of a bucket, so the 5e-8 of step 2 holds.
5. Linked nodes form components (smallest label, joins until nothing changes).

Similarity: M / (a + b - M) for texts of a and b shingles whose best alignment
in text order matches M; a link needs at least ``similarity``. Any two equal
shingles may be matched, whatever their labels. The alignment only follows
diagonals that a similarity that high can reach, a row of its table at a time in
one long integer.

Defined cases: null text never matches (a class of its own row). Texts without
words match only equal texts. Null doc_ids count as the largest. Repeated rows
share a class. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import BROADCAST_ROWS, doc_rows, small, stored

WORD = re.compile(r"\w+")
K, PICKS, BANDS, SIMILARITY = 5, 4, 32, 0.8
#: Equal smallest hashes (of 32) below which a pair cannot be at 0.8, but for a probability of 1e-6.
AGREE = 14
CACHE_WORDS = 200_000
#: Nodes of a bucket that meet in one join key.
BIG = 4096
#: Shingles of a block of a field, and how many pairs met in blocks cost as much as one listed and aligned.
BLOCK_SHINGLES, MET_PER_LISTED = 250_000, 20
#: Texts, and pairs of texts, a Python worker holds at once.
TEXTS_AT_ONCE, PAIRS_AT_ONCE = 2000, 200
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, k: int = K) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in text order."""
    words = WORD.findall(text.lower()) if text else []
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    size = min(k, len(w))
    out = np.full(len(w) - size + 1, np.uint64(size))
    for i in range(size):
        out = out * _P + w[i:len(w) - size + 1 + i]
    return _mix(out)


def numbered(s: np.ndarray) -> np.ndarray:
    """Shingle hashes made different by their occurrence number."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    number = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty_like(s)
    out[order] = run + number.astype(np.uint64) * _P
    return out


def sketch(marked: np.ndarray, bands: int = BANDS, picks: int = PICKS) -> tuple[np.ndarray, np.ndarray]:
    """(band values, smallest hash per band) of labelled shingles."""
    take = min(picks, len(marked))
    values, firsts = np.empty(bands, np.uint64), np.empty(bands, np.uint64)
    rows = max(1, 2_000_000 // len(marked))
    for at in range(0, bands, rows):
        seeds = _mix(np.arange(at + 1, min(at + rows, bands) + 1, dtype=np.uint64) * _P)
        ranks = _mix(marked[None, :] ^ seeds[:, None])
        firsts[at:at + rows] = ranks.min(axis=1)
        if take < len(marked):
            where = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)
        else:
            where = np.broadcast_to(np.arange(take), (len(seeds), take))
        value = seeds
        for i in range(take):
            value = _mix(value * _P + marked[where[:, i]])
        values[at:at + rows] = value
    return values, firsts


def _bits(at: list[int], size: int) -> int:
    flags = np.zeros(size, bool)
    flags[at] = True
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def banded_matches(a: list[int], b: list[int], band: int) -> int:
    """Most equal entries of ``a`` and ``b`` in text order, on diagonals at most ``band`` off.

    One row of the alignment table is one integer, a bit for each entry of ``a``:
    a row takes a few operations on it instead of a step per cell.
    """
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    often = {x: _bits(at, len(a)) for x, at in where.items() if len(at) > 8}
    row = full = (1 << len(a)) - 1
    near = (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b):
        if x in often:
            hits = often[x] & (near << (j - band) if j >= band else near >> (band - j))
        else:
            hits = 0
            for i in where.get(x, ()):
                if abs(i - j) <= band:
                    hits |= 1 << i
        if hits:
            taken = row & hits
            row = ((row + taken) | (row - taken)) & full
    return len(a) - row.bit_count()


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, marks_a: np.ndarray | None = None,
                       marks_b: np.ndarray | None = None) -> float:
    """M / (|a| + |b| - M) for the best in-order matching M; 0.0 if it is under ``least``. ``marks``: numbered shingles."""
    total = len(a) + len(b)
    most = int(total * (1 - least) / (1 + least) + 1e-9)  # unmatched shingles a similarity of ``least`` allows
    if not len(a) or not len(b) or abs(len(a) - len(b)) > most:
        return 0.0
    marks_a, marks_b = (numbered(x) if m is None else m for x, m in ((a, marks_a), (b, marks_b)))
    common = len(np.intersect1d(marks_a, marks_b, assume_unique=True))
    if total - 2 * common > most:
        return 0.0
    low = min(len(a), len(b))
    differ = np.flatnonzero(a[:low] != b[:low])
    head = int(differ[0]) if len(differ) else low
    differ = np.flatnonzero(a[::-1][:low - head] != b[::-1][:low - head])
    tail = int(differ[0]) if len(differ) else low - head
    matched = head + tail + banded_matches(a[head:len(a) - tail].tolist(), b[head:len(b) - tail].tolist(), most)
    return matched / (total - matched) if total - 2 * matched <= most else 0.0


def sketches(docs: DataFrame, k: int = K, bands: int = BANDS, picks: int = PICKS) -> DataFrame:
    """(doc_id, text_hash, node, n, bands, firsts) of every row; node is null for null text."""
    rows = doc_rows(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def sketched(batches):
        hashes = WordHashes()
        for frame in batches:
            nodes, sizes, values, firsts = [], [], [], []
            for text in frame["text"]:
                s = shingles(text, hashes, k)
                sizes.append(len(s))
                if len(s):
                    nodes.append(xxhash.xxh128_digest(s.tobytes()))
                    v, f = sketch(numbered(s), bands, picks)
                    values.append(v.view(np.int64))
                    firsts.append(f.view(np.int64).astype(np.int32))
                else:
                    nodes.append(None if text is None else xxhash.xxh128_digest(b"raw" + text.encode()))
                    values.append([])
                    firsts.append([])
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_hash": frame["text_hash"],
                                "node": nodes, "n": sizes, "bands": values, "firsts": firsts})

    return rows.mapInPandas(sketched, "doc_id long, text_hash long, node binary, n int, bands array<long>, "
                                      "firsts array<int>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the ends of ``edges`` (a, b): the smallest node each is connected to."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "dedup-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")),
                    "dedup-labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("component").alias("old"),
                                                                     F.least("component", "near").alias("new"))
        up = step.select(F.col("node").alias("up_node"), F.col("new").alias("up"))
        step = stored(step.join(up, step["new"] == up["up_node"], "left").select(
            "node", "old", F.least("new", F.coalesce("up", "new")).alias("component")), "dedup-labels")
        labels = step.select("node", "component")
        if not step.where("old <> component").limit(1).count():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links``: components over the components they join, not over all nodes again."""
    la, lb = (labels.select(F.col("node").alias(f"n_{s}"), F.col("component").alias(f"c_{s}")) for s in "ab")
    named = links.join(la, links["a"] == la["n_a"], "left").join(lb, links["b"] == lb["n_b"], "left").select(
        "a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b"))
    named = stored(named, "dedup-named-links")
    joined = components(named.where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    ends = named.select(F.col("a").alias("node"), F.col("c_a").alias("component")).union(named.select("b", "c_b")).distinct()
    every = labels.union(ends.join(labels.select("node"), "node", "left_anti"))
    new = joined.select(F.col("node").alias("old"), F.col("component").alias("new"))
    return stored(every.join(new, every["component"] == new["old"], "left").select(
        "node", F.coalesce("new", "component").alias("component")), "dedup-labels")


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float, agree: int) -> DataFrame:
    """Pairs (a, b) whose lengths and smallest hashes allow the similarity."""
    facts = nodes.select("node", "n", "firsts")
    fa, fb = (facts.select(*[F.col(c).alias(f"{c}_{s}") for c in facts.columns]) for s in "ab")
    pairs = pairs.join(fa, pairs["a"] == fa["node_a"]).join(fb, pairs["b"] == fb["node_b"])
    return pairs.where(_can_link(similarity, agree)).select("a", "b")


def _can_link(similarity: float, agree: int):
    same = F.size(F.filter(F.zip_with("firsts_a", "firsts_b", lambda x, y: x == y), lambda t: t))
    return ((F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity) & (same >= agree))


def shingled(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, s): the shingles of the nodes of ``wanted`` (node, rep_id, rep_hash), as 64-bit integers in text order."""
    rows = doc_rows(docs).withColumn("text_hash", F.xxhash64("text"))
    keys = small(wanted.select("node", "rep_id", "rep_hash"), wanted.count(), BROADCAST_ROWS)
    texts = rows.join(keys, rows["doc_id"].eqNullSafe(keys["rep_id"]) & (rows["text_hash"] == keys["rep_hash"]))

    def cut(batches):
        hashes = WordHashes()
        for frame in batches:
            yield pd.DataFrame({"node": frame["node"], "s": [shingles(t, hashes, k).tobytes() for t in frame["text"]]})

    found = texts.select("node", "text").mapInPandas(cut, "node binary, s binary")
    return stored(found.dropDuplicates(["node"]), "dedup-shingles", batch_rows=TEXTS_AT_ONCE)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, k: int) -> DataFrame:
    """The pairs whose alignment reaches ``similarity``; every end is cut into shingles once."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ends = stored(nodes.select("node", "rep_id", "rep_hash").join(ends, "node"), "dedup-ends")
    cut = shingled(ends, docs, k)
    sa, sb = (cut.select(F.col("node").alias(f"node_{s}"), F.col("s").alias(f"s_{s}")) for s in "ab")
    full = pairs.join(sa, pairs["a"] == sa["node_a"]).join(sb, pairs["b"] == sb["node_b"])

    def aligned(batches):
        for frame in batches:
            seen = {node: np.frombuffer(x, np.uint64) for s in "ab" for node, x in zip(frame[s], frame[f"s_{s}"])}
            marks = {node: numbered(x) for node, x in seen.items()}
            keep = [aligned_similarity(seen[x], seen[y], similarity, marks[x], marks[y]) >= similarity
                    for x, y in zip(frame["a"], frame["b"])]
            yield frame.loc[keep, ["a", "b"]]

    return stored(full.select("a", "b", "s_a", "s_b").mapInPandas(aligned, "a binary, b binary"), "dedup-links",
                  batch_rows=PAIRS_AT_ONCE)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    la, lb = (labels.select(F.col("node").alias(f"n_{s}"), F.col("component").alias(f"c_{s}")) for s in "ab")
    joined = pairs.join(la, pairs["a"] == la["n_a"], "left").join(lb, pairs["b"] == lb["n_b"], "left")
    return joined.where(~F.coalesce("c_a", "a").eqNullSafe(F.coalesce("c_b", "b"))).select("a", "b")


def _contested(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, main, size, outer, node, c) of the buckets that hold several components; main: the largest."""
    named = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    parts = named.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("main"), F.sum("n").alias("size"),
                                        F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = mixed.select("bucket", F.col("main.c").alias("main"), "size", (F.col("size") - F.col("main.n")).alias("outer"))
    return stored(mixed.join(named, "bucket"), "dedup-contested")


def _met_fields(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main, node, c) of all fields; (main) of the fields whose nodes better meet in blocks.

    The buckets of one largest component ``main`` are a field: listing makes size x outer pairs of each.
    """
    nodes = stored(members.select("main", "node", "c").distinct(), "dedup-field-nodes")
    sizes = nodes.groupBy("main").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") != F.col("main")).alias("outer"))
    listed = members.groupBy("main").agg(F.sum("outer").alias("listed"))  # a row for each of a bucket's ``size`` nodes
    chosen = sizes.join(listed, "main").where((F.col("listed") > 64) & (F.col("n") * F.col("outer") <= F.col("listed") * MET_PER_LISTED))
    return nodes, stored(chosen.select("main"), "dedup-met-fields")


def _listed(members: DataFrame, nodes: DataFrame, similarity: float, agree: int, big: int) -> DataFrame:
    """Possible pairs across components, bucket by bucket: the nodes outside a bucket's main component meet all its nodes."""
    members = members.select("bucket", "main", "node", "c", F.ceil(F.col("size") / big).cast("int").alias("blocks"),
                             F.ceil(F.col("outer") / big).cast("int").alias("outers")).join(nodes.select("node", "n", "firsts"), "node")

    def side(rows: DataFrame, s: str, block, outer) -> DataFrame:
        return rows.select("bucket", block.alias("block"), outer.alias("outer"), F.col("node").alias(s), *[
            F.col(x).alias(f"{x}_{s}") for x in ("c", "n", "firsts")])

    def dealt(count: str):
        return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    a = side(members.where("c <> main").withColumn("block", each("blocks")), "a", F.col("block"), dealt("outers"))
    b = side(members.withColumn("outer", each("outers")), "b", dealt("blocks"), F.col("outer"))
    return a.join(b, ["bucket", "block", "outer"]).where(
        (F.col("c_a") != F.col("c_b")) & _can_link(similarity, agree)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def common_counts(outer: list[np.ndarray], others: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Places (outer, other) of the pairs whose common numbered shingles allow a similarity of ``least``."""
    order = sorted(range(len(others)), key=lambda i: len(others[i]))
    sizes = np.array([len(others[i]) for i in order])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, ids = np.unique(np.concatenate([*outer, *(others[i] for i in order)]), return_inverse=True)
    at = sum(map(len, outer))
    pool, mark, found, place = ids[at:], np.zeros(int(ids.max()) + 1, np.int32), [], 0
    for o, x in enumerate(outer):
        own = ids[place:place + len(x)]
        place += len(x)
        a, b = np.searchsorted(sizes, np.ceil(len(x) * least - 1e-9)), np.searchsorted(sizes, len(x) / least + 1e-9, "right")
        if a >= b:
            continue
        mark[own] = 1
        common = np.add.reduceat(mark[pool[starts[a]:ends[b - 1]]], starts[a:b] - starts[a])
        mark[own] = 0
        fit = np.flatnonzero(common >= least * (len(x) + sizes[a:b] - common) - 1e-9)
        found += [(o, order[a + i]) for i in fit]
    return found


def _met(inside: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, k: int) -> DataFrame:
    """Pairs across components inside fields (main, node, c) whose common shingles allow the similarity."""
    facts = nodes.select("node", "n", "rep_id", "rep_hash")
    inside = stored(inside.join(facts, "node"), "dedup-met-nodes")
    cut = shingled(inside.select("node", "rep_id", "rep_hash").distinct(), docs, k)
    outside = F.sum(F.when(F.col("c") != F.col("main"), F.col("n")).otherwise(0))
    blocks = inside.groupBy("main").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"),
                                        F.ceil(outside / BLOCK_SHINGLES).cast("int").alias("outers"))
    rows = stored(inside.join(cut, "node").join(blocks, "main").select("main", "node", "c", "s", "blocks", "outers"), "dedup-met-shingles")

    def dealt(count: str):
        return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    a = rows.where("c <> main").select("main", each("blocks").alias("block"), dealt("outers").alias("outer"), "node", "c", "s")
    b = rows.select(F.col("main").alias("main"), dealt("blocks").alias("block"), each("outers").alias("outer"),
                    F.col("node").alias("node"), F.col("c").alias("c"), F.col("s").alias("s"))

    def met(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        if len(left) and len(right):
            mine, others = ([numbered(np.frombuffer(x, np.uint64)) for x in f["s"]] for f in (left, right))
            na, ca, nb, cb = (f[x].tolist() for f in (left, right) for x in ("node", "c"))
            pairs = [(min(na[i], nb[j]), max(na[i], nb[j])) for i, j in common_counts(mine, others, similarity) if ca[i] != cb[j]]
        return pd.DataFrame(pairs, columns=["a", "b"])

    on = ["main", "block", "outer"]
    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(met, "a binary, b binary").distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, bands: int = BANDS, picks: int = PICKS,
                 agree: int = AGREE, big: int = BIG) -> DataFrame:
    """(doc_id, text_hash, class_id, class_size, rep_id, rep_hash): one row per document, stored.

    class_id is the smallest doc_id of the class; rep_id and rep_hash name the document that stays.
    """
    rows = stored(sketches(docs, k, bands, picks), "dedup-sketches", batch_rows=TEXTS_AT_ONCE)
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = (rows.where("node is not null").groupBy("node")
             .agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("firsts").alias("firsts"),
                  rep.alias("rep"), F.count(F.lit(1)).alias("copies")))
    nodes = stored(nodes.select("node", "n", "bands", "firsts", F.col("rep.doc_id").alias("rep_id"),
                                F.col("rep.text_hash").alias("rep_hash"), "copies"), "dedup-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = stored(buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size"))
                     .where("size > 1").select("bucket", "leader"), "dedup-leaders")
    shared = stored(buckets.join(leaders, "bucket"), "dedup-buckets")
    pairs = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(_possible(pairs, nodes, similarity, agree), "dedup-pairs")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verified(first, nodes, docs, similarity, k)
    labels = components(links)
    rest = stored(_apart(pairs.join(first, ["a", "b"], "left_anti"), labels), "dedup-rest")
    if rest.limit(1).count():
        labels = _merged(labels, verified(rest, nodes, docs, similarity, k))
    members = _contested(shared.select("bucket", "node"), labels)
    fields, chosen = _met_fields(members)
    across = _listed(members.join(chosen, "main", "left_anti"), nodes, similarity, agree, big)
    if chosen.limit(1).count():
        across = across.union(_met(fields.join(chosen, "main"), nodes, docs, similarity, k)).distinct()
    across = stored(across.join(pairs, ["a", "b"], "left_anti"), "dedup-across")
    if across.limit(1).count():
        # one pair of each end first: in a large group that joins most ends, and their other pairs need no alignment
        nearest = across.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(
            across.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        nearest = stored(nearest, "dedup-nearest")
        labels = _merged(labels, verified(nearest, nodes, docs, similarity, k))
        rest = stored(_apart(across.join(nearest, ["a", "b"], "left_anti"), labels), "dedup-rest")
        if rest.limit(1).count():
            labels = _merged(labels, verified(rest, nodes, docs, similarity, k))
    named = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"),
                                                      "rep_id", "rep_hash", "copies")
    named = stored(named, "dedup-named")
    best = F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_hash"))
    classes = named.groupBy("component").agg(best.alias("best"), F.sum("copies").alias("class_size"))
    by_node = stored(named.select("node", "component").join(classes, "component").select(
        F.col("node").alias("of"), F.col("best.rep_id").alias("rep_id"), F.col("best.rep_hash").alias("rep_hash"),
        "class_size"), "dedup-classes")
    out = rows.select("doc_id", "text_hash", "node").join(by_node, F.col("node") == F.col("of"), "left")
    alone = F.col("node").isNull()
    return stored(out.select("doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("class_id"),
                             F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
                             alone.alias("null_text"), "rep_id", "rep_hash"), "dedup-result")


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns: one document of each class, and every row of null text.

    The documents that go are fewer than those that stay, so these are joined away.
    """
    classes = near_classes(docs, **options).where("not null_text")
    stays = F.col("text_hash").eqNullSafe(F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    gone = stored(classes.where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
                  .distinct(), "dedup-gone")
    text = F.col("text").cast("string")
    kept = docs.join(small(gone, gone.count()), F.col("doc_id").cast("long").eqNullSafe(gone["gone_id"]) &
                     (F.xxhash64(text) == gone["gone_hash"]) & text.isNotNull(), "left_anti")
    repeated = classes.where(stays).groupBy("rep_id", "rep_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.limit(1).count():
        kept = kept.where(text.isNotNull()).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(text.isNull()))
    return kept
