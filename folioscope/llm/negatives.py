"""Hard-negative mining with cover trees over norm-augmented candidates.

The score of two rows is the inner product of their whole-number vectors. A candidate x gets one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, and an anchor q a zero: products stay what they are, and all candidates lie on one
sphere, so that distances in a tree bound products. A node that covers its points within r of its centre c has
``q.c - |q| r <= q.x <= q.c + |q| r`` for each of them.

* Spark makes the top of the trees: candidates go to the nearest of a bounded number of pivots of their label, and cells of
  more than ``TREE_ROWS`` rows are split by hash; each part becomes one cover tree (``cover_tree``), a stored row. A tree is
  of one label, so positives are asked for in the anchor's own trees only, and negatives in all others only.
* Anchors go to the tasks in blocks of bounded bytes, and each block passes over the stored trees twice: for the positives,
  then for the negatives in the window that each positive opens. A node outside every window of an anchor, or not
  better than the k-th row found so far, is skipped with all below it; the nodes with the best bounds are opened first,
  and the leaves reached are scored exactly. Best rows per task are shuffled, k for each anchor and window.

Nothing is left out by a bound that could matter: bounds are widened by more than their rounding, and equal scores are
still looked at, as the smaller id wins. Of equal vectors in one tree only the smallest ids can be among the best, so a vector
that a third of the rows share is kept a few times a tree. How much is skipped depends on the data: vectors without any
clusters, as random ones of 64 dimensions are, leave little to skip, and the work is then that of comparing every anchor with
every candidate in matrix products.

Rows with a null label, a null or empty vector, or an entry that is null or not finite take no part, nor do rows without
an id. Rows that repeat whole are one; rows of one id that differ are rows of their own, but never partners. Ties go to the
smaller id. An anchor without a positive, and a positive with an empty window, give no rows; an empty table gives none. Vectors
of unequal length are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioscope.llm.store import materialize, table
from folioscope.llm.vectors import is_vector, matrix, one_dimension, whole_numbers
from folioscope.session import run_dir

POSITIVES = 5
NEGATIVES = 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
TREE_ROWS = 1_024
LEAF_ROWS = 32
#: Covering radius of a level by that of the level above it.
SHRINK = 0.77
MAX_PIVOTS = 1_024
TREES_PER_FILE = 16
BLOCK_BYTES = 32 << 20
#: Anchors that meet a tree at once.
BATCH = 1_024
ALLOWANCE = 1e-9
TREE = ("label long, ids array<long>, x array<long>, centre array<int>, radius array<double>, start array<int>, stop array<int>, "
        "child array<int>, children array<int>")


# Trees


def cover_tree(points: np.ndarray, leaf: int = LEAF_ROWS, shrink: float = SHRINK) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the points, and nodes by level: centre (a place in that order), covering radius, points, children.

    A node's children are centred on points of it, its own centre first and then always the farthest point that none covers
    yet, until all are within ``shrink`` times the node's radius of one. Children of a node follow each other.
    """
    order = np.arange(len(points))
    first = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    reach = np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    nodes = [[first, float(reach.max()), 0, len(points), 0, 0]]  # centre is a point number until the end
    at = 0
    while at < len(nodes):
        centre, radius, start, stop, _, _ = nodes[at]
        if stop - start > leaf and radius > 0:
            own = order[start:stop]
            x = points[own]
            near = np.sqrt(((x - points[centre]) ** 2).sum(axis=1))
            of, centres = np.zeros(len(own), np.int64), [centre]
            while near.max() > radius * shrink:
                pick = int(np.argmax(near))
                away = np.sqrt(((x - x[pick]) ** 2).sum(axis=1))
                closer = away < near
                near[closer], of[closer] = away[closer], len(centres)
                centres.append(int(own[pick]))
            by = np.argsort(of, kind="stable")
            order[start:stop] = own[by]
            ends = np.cumsum(np.bincount(of, minlength=len(centres)))
            nodes[at][4:] = len(nodes), len(centres)
            for c, lo, hi in zip(centres, np.append(0, ends[:-1]).tolist(), ends.tolist()):
                nodes.append([c, float(near[by[lo:hi]].max()), start + lo, start + hi, 0, 0])
        at += 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    columns = list(zip(*nodes))
    tree = {"centre": place[list(columns[0])], "radius": np.array(columns[1])}
    return order, tree | {name: np.array(c) for name, c in zip(("start", "stop", "child", "children"), columns[2:])}


def few_copies(x: np.ndarray, ids: np.ndarray, copies: int) -> np.ndarray:
    """Places of the ``copies`` smallest ids of every distinct row."""
    order = np.lexsort((ids, *x.T))
    new = np.concatenate([[True], (x[order[1:]] != x[order[:-1]]).any(axis=1)])
    start = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return np.sort(order[rank < copies])


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the coordinate that puts them all on the sphere of radius ``longest``."""
    y = x.astype(np.float64)
    return np.column_stack([y, np.sqrt(np.maximum(longest**2 - (y**2).sum(axis=1), 0.0))])


def cover_trees(rows: DataFrame, dim: int, copies: int, tree_rows: int = TREE_ROWS, max_pivots: int = MAX_PIVOTS, leaf: int = LEAF_ROWS) -> DataFrame:
    """One row a tree over ``rows`` (id, label, x). At most ``max_pivots`` pivots are chosen, by hash."""
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    n, labels, most = rows.agg(F.count("id"), F.countDistinct("label"), F.max(square)).first()
    longest = float(most or 0.0) ** 0.5 * (1 + ALLOWANCE)
    wanted = max(1, min(max_pivots, -(-n // (tree_rows * max(1, labels)))))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "label", "x").limit(wanted).select("x").toArrow()
    pivots = augmented(matrix(chosen["x"].combine_chunks(), dim), longest)
    halves = (pivots**2).sum(axis=1) / 2

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = np.argmax(augmented(matrix(batch.column("x"), dim), longest) @ pivots.T - halves, axis=1)
                yield batch.append_column("cell", pa.array(nearest.astype(np.int32)))

    placed = materialize(rows.mapInArrow(cell, "id long, label long, x array<long>, cell int"), "cells")
    parts = placed.groupBy("label", "cell").agg(F.ceil(F.count("id") / tree_rows).alias("parts"))
    dealt = placed.join(parts, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    # About TREES_PER_FILE trees a task and file, which also bounds what a reader holds at once.
    tasks = max(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // (tree_rows * TREES_PER_FILE)))
    dealt = dealt.repartition(tasks, "label", "cell", "part")

    def build(key: tuple, group: pa.Table) -> pa.Table:
        x, ids = matrix(group["x"].combine_chunks(), dim), group["id"].to_numpy()
        kept = few_copies(x, ids, copies)
        x, ids = x[kept], ids[kept]
        order, tree = cover_tree(augmented(x, longest), leaf)
        columns = {"ids": ids[order], "x": x[order].ravel(), **tree}
        kinds = {"ids": pa.int64(), "x": pa.int64(), "radius": pa.float64()}
        return pa.table({"label": pa.array([key[0].as_py()], pa.int64()),
                         **{name: pa.array([values], pa.list_(kinds.get(name, pa.int32()))) for name, values in columns.items()}})

    return materialize(dealt.groupBy("label", "cell", "part").applyInArrow(build, TREE), "cover-trees")


# Descent


@dataclass
class _Tree:
    label: int
    ids: np.ndarray
    x: np.ndarray
    nodes: dict[str, np.ndarray]


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[_Tree]:
    names = ("centre", "radius", "start", "stop", "child", "children")
    for row in range(batch.num_rows):
        def values(name: str) -> np.ndarray:
            return batch.column(name)[row].values.to_numpy(zero_copy_only=False)

        yield _Tree(batch.column("label")[row].as_py(), values("ids"), values("x").reshape(-1, dim), {n: values(n) for n in names})


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as long."""
    reach = int(max(abs(q).max(initial=0), 1)) * int(max(abs(x).max(initial=0), 1)) * max(q.shape[1], 1)
    if reach < 1 << 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ x.T.astype(object)
    return exact.astype(np.int64)


class Best:
    """The ``k`` best rows found so far for every slot, a pair of anchor and window; higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(slots, -np.inf)  # a score that rows which matter do not fall below

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(slot)))
        kept = np.arange(len(slot)) - np.repeat(start, size) < self.k
        self.slot, self.score, self.id = slot[kept], score[order][kept], ids[order][kept]
        full = size >= self.k
        self.floor[slot[start[full]]] = score[order][start[full] + self.k - 1]


def descend(tree: _Tree, q: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best, slots: np.ndarray) -> None:
    """Best-first through one tree for a batch of anchors ``q`` (ids ``own``) with windows ``low`` to ``high``, one column each.

    In every round an anchor opens its nodes with the best bounds, twice as many as in the round before.
    """
    node = tree.nodes
    n, m = len(q), len(node["radius"])
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    upper, lower = np.full((n, m), -np.inf), np.full((n, m), np.inf)
    waits = np.zeros((n, m), bool)

    def enter(rows: np.ndarray, nodes: np.ndarray) -> None:
        centre = products(q[rows], tree.x[node["centre"][nodes]]).astype(np.float64)
        reach = norm[rows, None] * node["radius"][nodes] * (1 + ALLOWANCE) + np.abs(centre) * ALLOWANCE + 1e-6
        at = np.ix_(rows, nodes)
        upper[at], lower[at], waits[at] = centre + reach, centre - reach, True

    enter(np.arange(n), np.zeros(1, np.int64))
    width = 1
    while True:
        floor = np.maximum(low, best.floor[slots])
        useful = np.zeros((n, m), bool)
        for w in range(low.shape[1]):
            useful |= (upper >= floor[:, w, None]) & (lower <= high[:, w, None]) & (low[:, w, None] <= high[:, w, None])
        waits &= useful
        if not waits.any():
            return
        bound = np.where(waits, upper, -np.inf)
        opened = waits if width >= m else waits & (bound >= -np.partition(-bound, width - 1, axis=1)[:, width - 1:width])
        waits = waits & ~opened
        found: list[tuple] = []
        for v in np.flatnonzero(opened.any(axis=0)).tolist():
            rows = np.flatnonzero(opened[:, v])
            if node["children"][v]:
                enter(rows, np.arange(node["child"][v], node["child"][v] + node["children"][v]))
                continue
            lo, hi = node["start"][v], node["stop"][v]
            score = products(q[rows], tree.x[lo:hi])
            other = tree.ids[None, lo:hi] != own[rows, None]
            for w in range(low.shape[1]):
                i, j = np.nonzero(other & (score >= floor[rows, w, None]) & (score <= high[rows, w, None]))
                if len(i):
                    found.append((slots[rows[i], w], score[i, j], tree.ids[lo + j]))
        if found:
            best.add(*(np.concatenate(part) for part in zip(*found)))
        width *= 2


# Spark


def search(trees: DataFrame, anchors: DataFrame, dim: int, k: int, same_label: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor, slot, rank, id, score: the ``k`` best rows of every window of ``anchors`` (anchor, id, label, x, low, high).

    Windows are arrays of bounds, both inclusive. Trees are those of the anchor's label, or all others.
    """
    spark = trees.sparkSession
    n, windows = anchors.agg(F.count("anchor"), F.max(F.size("low"))).first()
    path = run_dir(spark, "best-rows")
    if not n:
        return spark.createDataFrame([], "anchor long, slot int, rank int, id long, score long")
    blocks = -(-n * 8 * (dim + 4 * windows + 2) // block_bytes)
    stored = materialize(anchors.withColumn("_block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))), "anchors")
    for number in range(blocks):
        block = stored.where(F.col("_block") == number).toArrow()
        if not block.num_rows:
            continue
        found = _pass(trees, block, dim, windows, k, same_label)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor", "slot", "rank", "id", "score").write.mode("append").parquet(path)
    return spark.read.schema("anchor long, slot int, rank int, id long, score long").parquet(path)


def _pass(trees: DataFrame, block: pa.Table, dim: int, windows: int, k: int, same_label: bool) -> DataFrame:
    sent = trees.sparkSession.sparkContext.broadcast(block.combine_chunks())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        keys, own, label = (rows[c].to_numpy() for c in ("anchor", "id", "label"))
        q = matrix(rows["x"].combine_chunks(), dim)
        low, high = (matrix(rows[c].combine_chunks(), windows, np.float64) for c in ("low", "high"))
        slots = np.arange(len(q) * windows).reshape(len(q), windows)
        best = Best(slots.size, k)
        for batch in batches:
            for tree in _trees(batch, dim):
                asked = np.flatnonzero((label == tree.label) == same_label)
                for lo in range(0, len(asked), BATCH):
                    a = asked[lo:lo + BATCH]
                    descend(tree, q[a], own[a], low[a], high[a], best, slots[a])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[best.slot // windows]), pa.array((best.slot % windows).astype(np.int32)), pa.array(best.id), pa.array(best.score)],
            names=["anchor", "slot", "id", "score"])

    return trees.mapInArrow(scan, "anchor long, slot int, id long, score long")


def prepared(embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """id, label and whole-number vector ``x`` of the rows that take part, each once."""
    usable = is_vector(F.col(vec_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    return embeddings.where(usable).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole_numbers(F.col(vec_col)).alias("x")).distinct()


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT,
                   most: int = MOST_PERCENT, block_bytes: int = BLOCK_BYTES, tree_rows: int = TREE_ROWS, leaf: int = LEAF_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (id, label, x) where ``is_anchor``.

    Positives are the best rows of the anchor's label, negatives the best of other labels whose score is ``least`` to ``most``
    hundredths of the positive's.
    """
    rows = materialize(rows, "vectors")
    dim = one_dimension(rows, "x")
    trees = cover_trees(rows, dim, max(positives, negatives) + 1, tree_rows, leaf=leaf)
    # Anchors that share an id keep their rows apart by the hash of what they hold.
    anchors = materialize(rows.where(is_anchor).withColumn("anchor", F.xxhash64("id", "label", "x")), "all-anchors")
    everything = anchors.withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    near = search(trees, everything, dim, positives, True, block_bytes)
    near = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The positive scores of an anchor in order, and an empty window where it has fewer.
    scores = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("s"))

    def bounds(of, none: float) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(of(F.get("s", i).positive_score).cast("double"), F.lit(none)))

    low, high = bounds(lambda p: F.ceil(p * least / 100), 1.0), bounds(lambda p: F.floor(p * most / 100), 0.0)
    opened = anchors.join(scores, "anchor").select(*(anchors[c] for c in anchors.columns), low.alias("low"), high.alias("high"))
    far = search(trees, opened, dim, negatives, False, block_bytes)
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return far.join(near, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, "id % 50 = 0")


SQL = r"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
a AS (SELECT row_number() OVER (ORDER BY vec_id, label, x) AS a, * FROM e WHERE vec_id % 50 = 0),
s AS (SELECT a.a, a.vec_id AS anchor_id, e.vec_id AS id, e.label = a.label AS same, CAST(list_dot_product(a.x, e.x) AS BIGINT) AS score
      FROM a JOIN e ON e.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.id, p.score ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
