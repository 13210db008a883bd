"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

1. A bounded sample (``sample_rows``, the rows with the smallest hash of vec_id)
   trains the tree on the driver in numpy: every node splits its vectors into
   ``branch`` clusters by spherical k-means until ``leaf_rows`` remain.
2. Every row descends to its leaf (in tasks); rows are stored by leaf.
3. A query's leaves are opened from a priority queue, nearest centre first. How
   many is calibrated: sample queries are searched in the sample, and leaf visits
   widen until the mean share of true neighbours found reaches ``recall``.
4. Queries meet the rows of their leaves in tasks. Leaves are cut into blocks of
   about ``block_rows`` rows (by hash of vec_id), so a leaf that holds a third of
   all rows is spread; each block keeps a query's best ``k``, and Spark merges.
   Queries whose visited leaves hold fewer than ``k`` rows are searched in all.

Score: cosine in double precision on the original vectors, each pair summed in
one fixed order, so equal vectors tie exactly; ties go to the smaller vec_id.

Defined cases: vectors that are null, empty, all zero, of another length than
most, or hold a null or non-finite component take no part. Null vec_ids are no
queries; as candidates they come last among ties. Rows repeating a vec_id are
separate candidates, never for a query of their own id; a query id in several rows
asks once, with the smallest of its vectors (component by component). An empty table gives no
rows; fewer than ``k`` candidates are all returned; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import stored

K, EVERY = 5, 50


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list = field(default_factory=list)
    leaf: int = -1


def _split(x: np.ndarray, branch: int, random: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit vectors: (centres, cluster of each row); empty clusters are left out."""
    centres = x[random.choice(len(x), branch, replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = sums[norms > 1e-12] / norms[norms > 1e-12, None]
    return centres, np.argmax(x @ centres.T, axis=1)


class Tree:
    """A hierarchical k-means tree over unit vectors."""

    def __init__(self, x: np.ndarray, branch: int = 8, leaf_rows: int = 64, seed: int = 11):
        random, self.leaves, self.root = np.random.default_rng(seed), 0, Node()
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = []
            if len(rows) > leaf_rows:
                centres, at = _split(x[rows], min(branch, len(rows)), random)
                parts = [rows[at == c] for c in range(len(centres))]
            if sum(len(p) > 0 for p in parts) < 2:
                node.leaf, self.leaves = self.leaves, self.leaves + 1
                continue
            kept = [c for c in range(len(parts)) if len(parts[c])]
            node.centres, node.children = centres[kept], [Node() for _ in kept]
            todo += [(child, parts[c]) for child, c in zip(node.children, kept)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row descends to."""
        out, todo = np.empty(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
                continue
            at = np.argmax(x[rows] @ node.centres.T, axis=1)
            todo += [(child, rows[at == c]) for c, child in enumerate(node.children)]
        return out

    def nearest_leaves(self, q: np.ndarray, most: int) -> list[int]:
        """Up to ``most`` leaves in best-bin-first order: the queue holds unopened bins by cosine of their centre."""
        queue, found, tie = [(-2.0, 0, self.root)], [], 0
        while queue and len(found) < most:
            _, _, node = heapq.heappop(queue)
            while node.leaf < 0:
                near = node.centres @ q
                best = int(np.argmax(near))
                for c, child in enumerate(node.children):
                    if c != best:
                        tie += 1
                        heapq.heappush(queue, (-near[c], tie, child))
                node = node.children[best]
            found.append(node.leaf)
        return found


def calibrate(tree: Tree, x: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """The smallest number of leaf visits at which the sample's mean recall is at least ``recall``."""
    leaf = tree.assign(x)
    needed = []
    for i in queries:
        near = x @ x[i]
        near[i] = -np.inf
        true = np.argpartition(-near, min(k, len(x) - 1) - 1)[:k] if len(x) > k else np.flatnonzero(near > -np.inf)
        place = {v: n for n, v in enumerate(tree.nearest_leaves(x[i], tree.leaves))}
        needed += [place[v] + 1 for v in leaf[true]]
    needed = np.sort(needed)
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>): rows whose vector takes part."""
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & fine & F.exists("vec", lambda v: v != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(
        F.col("c").desc(), "n").limit(1).collect()
    return rows.where(F.size("vec") == (usual[0]["n"] if usual else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _halved(x: np.ndarray) -> np.ndarray:
    """Vectors divided by the power of two above their largest component: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with every row of ``x``, every row summed alike."""
    q, x = _halved(q), _halved(x)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _best(queries: pd.DataFrame, ids: np.ndarray, x: np.ndarray, units: np.ndarray, k: int):
    """Per query the best ``k`` rows: matrix products pick, with slack for rounding; exact cosines decide."""
    q = np.stack(queries["q_vec"].to_numpy())
    near = _unit(q) @ units.T
    for row, q_id in enumerate(queries["query_id"].to_numpy()):
        own = near[row].copy()
        own[ids == q_id] = -np.inf
        there = int((own > -np.inf).sum())
        if not there:
            continue
        kth = np.partition(own, len(own) - min(k, there))[len(own) - min(k, there)]
        pick = np.flatnonzero((own >= kth - 1e-9) & (own > -np.inf))
        exact = cosines(q[row], x[pick])
        order = np.lexsort((ids[pick], -exact))[:k]
        yield pd.DataFrame({"query_id": q_id, "vec_id": ids[pick][order], "score": exact[order]})


def search(vectors: DataFrame, k: int = K, every: int = EVERY, recall: float = 0.97, sample_rows: int = 20_000,
           calibration_queries: int = 200, branch: int = 8, leaf_rows: int = 64, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of every row whose vec_id divides by ``every``."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    rows = stored(usable(vectors), "ann-rows")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _unit(np.stack(sample["vec"].to_numpy()))
    tree = Tree(x, branch, leaf_rows)
    visits = calibrate(tree, x, np.arange(min(calibration_queries, len(x))), k, recall)
    shipped = spark.sparkContext.broadcast(tree)

    def assigned(batches):
        for frame in batches:
            if len(frame):
                yield frame.assign(leaf=shipped.value.assign(_unit(np.stack(frame["vec"].to_numpy()))))

    placed = stored(rows.mapInPandas(assigned, "vec_id long, vec array<double>, leaf long"), "ann-leaves")
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).select(
        "leaf", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    sizes = F.broadcast(stored(sizes, "ann-blocks"))  # one row per leaf: bounded by the sample
    block = F.pmod(F.xxhash64("vec_id", "vec"), F.col("blocks")).cast("int")
    candidates = placed.join(sizes, "leaf").select("leaf", block.alias("block"), "vec_id", "vec")
    asked = placed.where((F.col("vec_id") % every) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min("vec").alias("q_vec"))

    def routed(batches):
        for frame in batches:
            if len(frame):
                leaves = [shipped.value.nearest_leaves(q, visits) for q in _unit(np.stack(frame["q_vec"].to_numpy()))]
                yield frame.assign(leaf=leaves).explode("leaf").astype({"leaf": "int64"})

    visited = (asked.mapInPandas(routed, "query_id long, q_vec array<double>, leaf long").join(sizes, "leaf")
               .select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "q_vec"))

    def met(_, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(queries) and len(found):
            block_x = np.stack(found["vec"].to_numpy())
            ids = found["vec_id"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            units = _unit(block_x)
            for at in range(0, len(queries), 512):
                parts += _best(queries.iloc[at:at + 512], ids, block_x, units, k)
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    hits = visited.groupBy("leaf", "block").cogroup(candidates.groupBy("leaf", "block")).applyInPandas(met, out)
    hits = stored(hits, "ann-hits")
    total = rows.count()
    short = (asked.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
             .where(F.coalesce("n", F.lit(0)) < min(k, total - 1)).select("query_id", "q_vec"))
    short = stored(short, "ann-short")
    if short.limit(1).count():
        every_block = placed.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(
            "block")).distinct()
        whole = short.withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tree.leaves - 1).cast("long"))))
        whole = whole.join(every_block, "leaf").select("leaf", "block", "query_id", "q_vec")
        more = whole.groupBy("leaf", "block").cogroup(candidates.groupBy("leaf", "block")).applyInPandas(met, out)
        hits = hits.join(short.select("query_id"), "query_id", "left_anti").unionByName(more)
    return ranked(hits, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` hits of each query, ranked from 1."""
    best = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    none = F.lit(2**63 - 1)
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("hit.vec_id"), none).alias("vec_id"),
        (-F.col("hit.far")).alias("score"))
