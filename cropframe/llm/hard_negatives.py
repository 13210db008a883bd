"""Hard-negative mining with exact integer scores by the Four-Russians method.

Every component x becomes the integer floor(256 x); a row is stored as its bit
planes: for each bit of the two's complement and each group of eight dimensions
one byte. An anchor has, for each group, a table of the 256 sums of subsets of its
eight integers. The score of a row is its planes' bytes looked up in the tables,
summed over the groups, and added up over the planes by shifting: the highest plane
counts negative. That is the exact inner product.

1. ``packed`` writes the planes once, with a block number (hash of vec_id); as many
   blocks as give ``block_rows`` rows each, as many anchor blocks as give
   ``anchor_rows`` anchors. Every anchor block meets every block in one task.
2. First meeting: per anchor the best ``positives`` rows of its label. A block is
   sorted by label, so only rows of an anchor's own label are scored.
3. Second meeting, with the positives' scores: per anchor and positive the best
   ``negatives`` rows of another label in the window
   low * positive_score <= 100 * negative_score <= high * positive_score.
Blocks keep their best few, Spark merges: higher scores first, ties by smaller vec_id.

Defined cases: rows with a null vec_id or label, a null vector, or a null or
non-finite component take no part. Of several rows of one vec_id the one with the
smallest label, then the smallest planes, takes part. Shorter vectors count as
padded with zeros. Rows whose absolute integers sum to 2^31 or more take no part:
their scores would not fit a long. A positive without a row in its window, or with a
negative score, has no rows in the result; neither has an empty table. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropframe.llm.common import stored

SCALE, EVERY = 256, 100
#: Anchors whose tables are built together.
TABLE_ANCHORS = 64
HITS = "anchor_id long, vec_id long, score long"
MINED = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def contract_label(label: Column, vec_id: Column) -> Column:
    """Every seventh id has a wrong label."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def quantised(vectors: DataFrame, relabel=contract_label) -> DataFrame:
    """(vec_id, label, q array<long>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & fine)
    fits = F.aggregate("vec", F.lit(0.0), lambda a, v: a + F.abs(F.floor(v * SCALE).cast("double"))) < 2.0**31
    return rows.where(fits).select("vec_id", relabel(F.col("label"), F.col("vec_id")).alias("label"),
                                   F.transform("vec", lambda v: F.floor(v * SCALE)).alias("q"))


def planes_of(q: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (rows, bits, groups) of integers (rows, dimensions): bit b of eight dimensions in a byte."""
    planes = (q[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def integers_of(planes: np.ndarray) -> np.ndarray:
    """The integers (rows, groups * 8) that ``planes`` were made from."""
    bits = planes.shape[1]
    weights = 1 << np.arange(bits, dtype=np.int64)
    weights[-1] *= -1
    return np.einsum("rbd,b->rd", np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64), weights)


def subset_sums(q: np.ndarray) -> np.ndarray:
    """Tables (groups, 256, anchors) of anchors' integers (anchors, groups * 8): the sum of each subset of eight."""
    groups = q.shape[1] // 8
    parts = q.T.reshape(groups, 8, len(q)).astype(np.int32)
    tables = np.zeros((groups, 256, len(q)), np.int32)
    for j in range(8):
        np.add(tables[:, :1 << j], parts[:, j:j + 1], out=tables[:, 1 << j:2 << j])
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products (rows, anchors): look-ups by byte, summed over groups, shifted and added over planes."""
    total = np.zeros((len(planes), tables.shape[2]), np.int64)
    plane = np.empty(total.shape, np.int32)
    for b in reversed(range(planes.shape[1])):
        plane[:] = 0
        for g, table in enumerate(tables):
            plane += table[planes[:, b, g]]
        total <<= 1
        if b == planes.shape[1] - 1:
            total -= plane
        else:
            total += plane
    return total


def _planes(column: pd.Series, bits: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column), np.uint8)
    return flat.reshape(len(column), bits, -1)


def _scored(anchors: pd.DataFrame, planes: np.ndarray, bits: int):
    """(position of an anchor, its scores of all ``planes``), ``TABLE_ANCHORS`` tables at a time."""
    for at in range(0, len(anchors), TABLE_ANCHORS):
        part = anchors["planes"].iloc[at:at + TABLE_ANCHORS]
        found = scores(subset_sums(integers_of(_planes(part, bits))), planes).T
        for i in range(len(part)):
            yield at + i, found[i]


def _best(ids: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k``: highest score first, ties by smaller id (``ids`` rise)."""
    if len(found) > 4 * k:
        keep = np.flatnonzero(found >= np.partition(found, len(found) - k)[len(found) - k])
        return keep[np.argsort(-found[keep], kind="stable")[:k]]
    return np.argsort(-found, kind="stable")[:k]


def best_of_label(anchors: pd.DataFrame, block: pd.DataFrame, bits: int, k: int) -> pd.DataFrame:
    """Per anchor the block's best ``k`` rows of its own label, never its own id."""
    out = []
    block = block.sort_values(["label", "vec_id"], kind="stable")
    labels, ids = block["label"].to_numpy(), block["vec_id"].to_numpy()
    planes = _planes(block["planes"], bits)
    for label, mine in anchors.groupby("label", sort=False):
        a, b = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
        if a == b:
            continue
        own = mine["vec_id"].to_numpy()
        for i, found in _scored(mine, planes[a:b], bits):
            other = np.flatnonzero(ids[a:b] != own[i])
            top = other[_best(ids[a:b][other], found[other], k)]
            out.append(pd.DataFrame({"anchor_id": own[i], "vec_id": ids[a:b][top], "score": found[top]}))
    return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "vec_id": [], "score": []})


def best_in_windows(anchors: pd.DataFrame, block: pd.DataFrame, bits: int, k: int, low: int, high: int) -> pd.DataFrame:
    """Per anchor and positive the block's best ``k`` rows of other labels within the positive's window."""
    out = []
    block = block.sort_values("vec_id", kind="stable")
    labels, ids = block["label"].to_numpy(), block["vec_id"].to_numpy()
    own, own_label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    for i, found in _scored(anchors, _planes(block["planes"], bits), bits):
        wins = [(p["positive_id"], p["positive_score"], -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100)
                for p in anchors["positives"].iloc[i]]
        wins = [w for w in wins if w[2] <= w[3]]
        if not wins:
            continue
        fit = np.flatnonzero((labels != own_label[i]) & (found >= min(w[2] for w in wins)) & (found <= max(w[3] for w in wins)))
        order = fit[np.argsort(-found[fit], kind="stable")]
        falling = -found[order]
        for positive, score, least, most in wins:
            a, b = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
            top = order[a:min(b, a + k)]
            out.append(pd.DataFrame({"anchor_id": own[i], "positive_id": positive, "negative_id": ids[top],
                                     "positive_score": score, "negative_score": found[top]}))
    return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in MINED.split(", ")})


def mine(vectors: DataFrame, every: int = EVERY, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         block_rows: int = 4096, anchor_rows: int = 2048, relabel=contract_label) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = quantised(vectors, relabel)
    size = rows.agg(F.max(F.size("q")).alias("dims"), F.max(F.array_max("q")).alias("top"),
                    F.min(F.array_min("q")).alias("bottom"), F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    groups = max(1, -(-(size["dims"] or 0) // 8))
    bits = 1 + max((size["top"] or 0).bit_length(), (~min(size["bottom"] or 0, -1)).bit_length())

    def packed(batches):
        for frame in batches:
            q = np.zeros((len(frame), groups * 8), np.int64)
            for i, values in enumerate(frame["q"]):
                q[i, :len(values)] = values
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"],
                                "planes": [p.tobytes() for p in planes_of(q, bits)]})

    rows = rows.mapInPandas(packed, "vec_id long, label long, planes binary")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "planes")).alias("row")).select("vec_id", "row.*")
    blocks, anchor_blocks = max(1, -(-size["n"] // block_rows)), max(1, -(-size["asked"] // anchor_rows))
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "mining-rows")
    anchors = rows.where(F.col("vec_id") % every == 0).drop("block").withColumn(
        "anchor_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(anchor_blocks)).cast("int"))
    met = rows.withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))

    def meeting(asked: DataFrame, kernel, schema: str) -> DataFrame:
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns],  # other columns than those of ``met``
                             F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        return (asked.groupBy("anchor_block", "block").cogroup(met.groupBy("anchor_block", "block"))
                .applyInPandas(kernel, schema))

    near = meeting(anchors, lambda asked, block: best_of_label(asked, block, bits, positives), HITS)
    near = stored(_first(near, ["anchor_id"], "score", "vec_id", positives), "mining-positives")
    asked = anchors.join(near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("positives")), "vec_id")
    found = meeting(asked, lambda asked, block: best_in_windows(asked, block, bits, negatives, low, high), MINED)
    return _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _first(rows: DataFrame, keys: list[str], score: str, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), by)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""
