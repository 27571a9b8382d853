"""Hard-negative mining with bounds along spanning trees of anchors.

Scores are integer inner products of scaled vectors. The anchors of a label are dealt to groups of about ``TREE``, and a
minimum spanning tree of each group's distances is made in a task of its own. For a batch of rows the root's scores are exact;
from there on a child's score of a row lies within the parent's score (or its bounds), less or more the length of the edge
between both anchors times the row's norm. Only rows whose bounds overlap what is asked for are scored exactly:

- positives: the rows of the anchor's label whose upper bound reaches the anchor's fifth score so far;
- negatives: the rows of other labels whose bounds overlap the window of one of the anchor's positives, its lower end raised to
  that window's fifth score so far.

Both are passes over the rows where they lie; each task returns its first five for every anchor, then for every anchor and
positive, and the first five of all tasks are the result. Trees and positives come to the tasks in rounds of at most
``ROUND_BYTES`` of anchors' vectors, the only thing that passes through the driver; a round reads the rows twice.

Rows take no part whose label or vector is null or whose vector holds a null or non-finite component. A null ``vec_id`` is no
anchor and comes last among equal scores; rows that repeat in ``vec_id`` are other rows, and anchors of their own. Vectors of
different lengths never meet. Scores are exact; one beyond 64 bits counts as the nearest 64-bit number. Anchors without positives,
and positives with an empty window (a negative score has one), have no rows. An empty table gives none; other columns are ignored,
whatever their names. Vectors of any length are fine as long as ``BATCH`` of them fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_small, materialise

EVERY = 100
POSITIVES = NEGATIVES = 5
#: A negative's score is at least this many hundredths of the positive's.
LEAST = 80
TREE = 1024
ROUND_BYTES = 32 << 20
BATCH = 2048
#: Products of norms below which sums of doubles are exact.
EXACT = 2.0**52
LIMIT = (1 << 63) - 1
#: Stands for "fewer than five so far".
NONE = -LIMIT - 1


def scale(vectors: np.ndarray) -> np.ndarray:
    """Components as whole numbers: floor(256 x)."""
    with np.errstate(over="ignore"):
        return np.floor(256.0 * vectors)


def _whole(vector: np.ndarray) -> list[int]:
    return [int(np.floor(256.0 * x)) if abs(x) < 2.0**1000 else 256 * int(x) for x in vector.tolist()]


class Rows:
    """A batch of rows of one length, with what scoring needs of them."""

    def __init__(self, vectors: np.ndarray):
        self.raw, self.scaled = vectors, scale(vectors)
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((self.scaled**2).sum(axis=1))

    def __len__(self) -> int:
        return len(self.raw)

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some rows with an anchor, given by its unscaled vector."""
        point = scale(anchor)
        with np.errstate(over="ignore", invalid="ignore"):
            safe = self.norms[rows] * np.sqrt((point**2).sum()) < EXACT
            out = np.zeros(len(rows), np.int64)
            out[safe] = self.scaled[rows[safe]] @ point
        if not safe.all():
            whole = _whole(anchor)
            out[~safe] = [max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(whole, _whole(self.raw[k]), strict=True)))) for k in rows[~safe]]
        return out


def bounds(low: np.ndarray, high: np.ndarray, edge: float, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A child's bounds from its parent's, a little wider than they are for rounding's sake."""
    with np.errstate(over="ignore", invalid="ignore"):
        wide = edge * norms * (1 + 1e-9) + 1 + 1e-9 * np.maximum(np.abs(low), np.abs(high))
        low, high = low - wide, high + wide
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's: the order in which points join, each one's parent as a place in that order (-1 for the root), and the edges' lengths."""
    n = len(points)
    order, parents, edges = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    nearest, via, free = np.full(n, np.inf), np.full(n, 0), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], free[at] = at, False
        if k:
            parents[k], edges[k] = via[at], nearest[at]
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        far = np.where(np.isnan(far), np.inf, far)
        closer = free & ((far < nearest) | (via < 0))
        nearest[closer], via[closer] = far[closer], k
        left = np.where(free, nearest, np.inf)
        at = int(left.argmin()) if np.isfinite(left.min()) else int(free.argmax())
    return order, parents, edges * (1 + 1e-9)


def _grow(frame: pd.DataFrame) -> pd.DataFrame:
    order, parents, edges = spanning_tree(scale(np.stack(frame["embedding"].to_numpy()).astype(np.float64).reshape(len(frame), -1)))
    frame = frame.iloc[order].reset_index(drop=True)
    return frame.assign(place=np.arange(len(frame), dtype=np.int32), parent=parents.astype(np.int32), edge=edges)


class Tree:
    """A group of anchors in the order of their tree; ``windows`` holds each anchor's positives' scores, once they are known."""

    def __init__(self, rows: list, numbers: dict[int, int]):
        self.label, self.size = rows[0]["label"], len(rows[0]["embedding"])
        self.points = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), self.size)
        self.rows = np.array([r["row"] for r in rows], np.int64)
        self.parents, self.edges = [r["parent"] for r in rows], [r["edge"] for r in rows]
        self.last = {p: k for k, p in enumerate(self.parents)}  # the last child of each
        self.numbers = [numbers[int(r)] for r in self.rows]

    def walk(self, batch: Rows, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor, by its number, the rows of a batch that are scored exactly and their scores; ``wanted`` says which, given the bounds."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, number in enumerate(self.numbers):
            if self.parents[k] < 0:
                chosen = np.arange(len(batch))
                low, high = np.zeros(len(batch)), np.zeros(len(batch))
            else:
                low, high = bounds(*held[self.parents[k]], self.edges[k], batch.norms)
                chosen = np.flatnonzero(wanted(number, low, high))
            scores = batch.scores(self.points[k], chosen)
            low[chosen] = high[chosen] = scores
            if k in self.last:
                held[k] = (low, high)
            if self.last.get(self.parents[k]) == k:
                held.pop(self.parents[k], None)
            yield number, chosen, scores


class Firsts:
    """For each of a fixed number of keys the first ``k`` entries by falling score, then rising id, then row."""

    def __init__(self, keys: int, k: int):
        self.k, self.held = k, [None] * keys
        self.floor = np.full(keys, NONE, np.int64)  # the k-th score, once there are as many

    def add(self, key: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        good = scores >= self.floor[key]
        if not good.any():
            return
        scores, ids, rows = scores[good], ids[good], rows[good]
        if len(scores) > 4 * self.k:  # of many only those that reach the k-th of them
            good = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, rows = scores[good], ids[good], rows[good]
        if self.held[key] is not None:
            scores, ids, rows = (np.concatenate(x) for x in zip(self.held[key], (scores, ids, rows), strict=True))
        order = np.lexsort((rows, ids, -(scores & 1), -(scores >> 1)))[: self.k]  # in two parts, as the least number has no negative
        self.held[key] = (scores[order], ids[order], rows[order])
        if len(order) == self.k:
            self.floor[key] = self.held[key][0][-1]


#: Stands for a null id; it comes last.
NO_ID = LIMIT


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``row, vec_id, label, embedding`` as length, rows, ids, labels and vectors, no more than ``BATCH`` at once."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            rows, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            values = batch.column(3).flatten().to_numpy()
            for size in np.unique(sizes):
                here = sizes == size
                yield int(size), rows[here], ids[here], labels[here], values[np.repeat(here, sizes)].reshape(int(here.sum()), size)


def _positives(trees: list[Tree], anchors: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts(len(anchors), k)
        for size, rows, ids, labels, vectors in _batches(batches):
            for label in np.unique(labels):
                own = labels == label
                asking = [t for t in trees if t.size == size and t.label == label]
                batch = Rows(vectors[own]) if asking else None
                for tree in asking:
                    for number, chosen, scores in tree.walk(batch, lambda n, low, high: high >= firsts.floor[n]):
                        other = rows[own][chosen] != anchors[number]
                        firsts.add(number, scores[other], ids[own][chosen][other], rows[own][chosen][other])
        yield from _told(firsts, lambda key: (int(anchors[key]), 0))

    return run


def _negatives(trees: list[Tree], anchors: np.ndarray, windows: list[list[tuple[int, int]]], k: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``windows`` has each anchor's positives as place and score."""
    starts = np.cumsum([0, *map(len, windows)])
    ends = [(n, place, -((-least * score) // 100), score) for n, found in enumerate(windows) for place, score in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts(len(ends), k)

        def overlapping(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(len(low), bool)
            for key in range(starts[n], starts[n + 1]):
                _, _, bottom, top = ends[key]
                if bottom <= top:
                    out |= (high >= max(bottom, int(firsts.floor[key]))) & (low <= top)
            return out

        for size, rows, ids, labels, vectors in _batches(batches):
            for tree in trees:
                other = labels != tree.label
                if tree.size != size or not other.any():
                    continue
                batch = Rows(vectors[other])
                for number, chosen, scores in tree.walk(batch, overlapping):
                    for key in range(starts[number], starts[number + 1]):
                        _, _, bottom, top = ends[key]
                        inside = (scores >= bottom) & (scores <= top)
                        if inside.any():
                            firsts.add(key, scores[inside], ids[other][chosen][inside], rows[other][chosen][inside])
        yield from _told(firsts, lambda key: (int(anchors[ends[key][0]]), ends[key][1]))

    return run


FIRSTS = "anchor long, place int, vec_id long, row long, score long"


def _told(firsts: Firsts, name: Callable[[int], tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(firsts.held), 4096):
        keys = [k for k in range(at, min(at + 4096, len(firsts.held))) if firsts.held[k] is not None]
        if keys:
            sizes = [len(firsts.held[k][0]) for k in keys]
            scores, ids, rows = (np.concatenate([firsts.held[k][j] for k in keys]) for j in range(3))
            anchor, place = (np.repeat([name(k)[j] for k in keys], sizes) for j in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(rows), pa.array(scores)], names=["anchor", "place", "vec_id", "row", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of all tasks for each anchor and place, with their ``rank``."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(vectors: DataFrame) -> DataFrame:
    """Rows that take part: ``row, vec_id, label, embedding``, the label moved on where ``vec_id`` is divisible by 7."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), "embedding")


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, tree: int = TREE, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows = materialise(prepared(vectors), "rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    groups = materialise(anchors.groupBy("label", F.size("embedding").alias("size")).agg(F.count("*").alias("many")), "groups")
    sized = join_small(anchors.withColumn("size", F.size("embedding")), groups, ["label", "size"])
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.col("many") / tree))).select("row", "vec_id", "label", "embedding", "size", "part")
    grown = dealt.groupBy("label", "size", "part").applyInPandas(_grow, "row long, vec_id long, label long, embedding array<double>, size int, part long, place int, parent int, edge double")
    grown = materialise(grown.withColumn("tree", F.xxhash64("label", "size", "part")), "trees")
    rounds = -(-(grown.agg(F.sum(8 * F.greatest("size", F.lit(1)).cast("long"))).first()[0] or 0) // round_bytes)
    out = []
    for number in range(rounds):
        here = grown.where(F.pmod("tree", F.lit(rounds)) == number).orderBy("tree", "place").collect()  # about ``round_bytes``
        if not here:
            continue
        ids = {r["row"]: k for k, r in enumerate(here)}
        together: dict[int, list] = {}
        for r in here:
            together.setdefault(r["tree"], []).append(r)
        trees = [Tree(t, ids) for t in together.values()]
        own = np.array([r["row"] for r in here], np.int64)
        found = materialise(_first(rows.mapInArrow(_positives(trees, own, positives), FIRSTS), positives), "positives")
        windows: list[list[tuple[int, int]]] = [[] for _ in here]
        for r in found.select("anchor", "rank", "score").collect():  # ``positives`` rows for each anchor of the round
            windows[ids[r["anchor"]]].append((r["rank"], r["score"]))
        hard = _first(rows.mapInArrow(_negatives(trees, own, windows, negatives, least), FIRSTS), negatives)
        named = found.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = named.join(grown.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        hard = hard.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out.append(hard.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    if not out:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionAll(other)
    return whole


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e, row_number() OVER (ORDER BY vec_id) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, b.n, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.n <> b.n),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) p WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id) AS place
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score) q WHERE place <= 5
"""
