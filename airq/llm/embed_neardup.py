"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its ``NEAREST`` reference points (pivots), nearest first. It stands in the inverted lists, by
label, of those pivots. Two vectors of a list are a candidate pair if they share at least ``SHARED`` pivots and their
permutations agree well enough: each shared pivot counts by how far in front both have it, and the sum must reach
``AGREEMENT``. A pair is counted in the list of the first pivot it shares alone, and verified by its cosine in double
precision. Every vector is indexed and is a query. Long lists are cut into blocks, and every two blocks of a list meet in a
task of their own, which returns counts and a spanning forest of its links, never the links themselves.

The pivots of a length are vectors of that length drawn by hash, as many as ``PIVOT_RATE`` times the root of their number, so
that comparisons grow with the power 1.5 of the vectors. They are the one thing that passes through the driver, within
``PIVOT_BYTES``; lengths beyond that bound take pseudo-random reference points instead, which every task makes by itself from
the length. Lengths of at most ``SMALL`` vectors have one list in which all are compared.

Equal vectors of one label are one vector from the start, with a count. Vectors that are null, empty or zero, or
hold null or non-finite components, and null labels link with nothing; vectors of different length do not
either. Components are scaled by the largest before they are squared, so that very large and very small vectors
keep their links. Rows that repeat in id count as other vectors, null ids as well. An empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import join_small, materialise
from .graph import connected_components

COSINE = 0.93
#: Pivots for each root of a length's vectors, at least and at most.
PIVOT_RATE, PIVOTS_LEAST, PIVOTS_MOST = 1.2, 64, 65_536
#: Bytes of pivots that pass through the driver, and vectors of a length up to which all are compared.
PIVOT_BYTES, SMALL = 64 << 20, 512
NEAREST = 12
SHARED = 2
#: Least sum over shared pivots of both places' weights, 1 for the nearest down to 1 / NEAREST.
AGREEMENT = 0.5
BLOCK = 1024


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` points by the links ``a - b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(pivots: dict[int, np.ndarray], rate: float, nearest: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each vector's nearest pivots, nearest first; the single pivot 0 where a length has few vectors."""
    made: dict[int, np.ndarray] = {}

    def points(size: int, vectors: int) -> np.ndarray:
        if size in pivots:
            return pivots[size]
        if size not in made:
            made.clear()  # one length's at a time
            made[size] = unit(np.random.default_rng(size).normal(size=(pivot_count(vectors, rate), size)))
        return made[size]

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (size, vectors), part in frame.groupby(["size", "vectors"]):
                if vectors <= SMALL:
                    yield part.drop(columns="vectors").assign(pivots=[np.zeros(1, np.int32)] * len(part))
                    continue
                x = unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)) @ points(int(size), int(vectors)).T
                top = np.argpartition(-x, min(nearest, x.shape[1]) - 1, axis=1)[:, :nearest]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(x, top, 1), axis=1, kind="stable"), 1)
                yield part.drop(columns="vectors").assign(pivots=list(top.astype(np.int32)))

    return describe


def pivot_count(vectors: int, rate: float = PIVOT_RATE) -> int:
    return int(min(PIVOTS_MOST, max(PIVOTS_LEAST, np.ceil(rate * np.sqrt(vectors)))))


def _compare(cosine: float, nearest: int, shared: int, agreement: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """In one pair of blocks of one list: how many vectors each vector links with, and a forest of the links."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pivot = int(frame["pivot"].iloc[0])
        first, second = frame["block_a"].iloc[0], frame["block_b"].iloc[0]
        n = len(frame)
        x = unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
        tops = np.stack(frame["pivots"].to_numpy())
        names, place = np.unique(tops, return_inverse=True)  # the pivots that occur here, in order
        place, own = place.reshape(tops.shape), int(np.searchsorted(names, pivot))
        bits, weight = np.zeros((n, len(names)), np.float32), np.zeros((n, len(names)), np.float32)
        bits[np.arange(n)[:, None], place] = 1
        weight[np.arange(n)[:, None], place] = 1 - np.arange(tops.shape[1], dtype=np.float32) / nearest
        side = frame["block"].to_numpy()
        left = np.flatnonzero(side == first)
        right = left if first == second else np.flatnonzero(side == second)
        if tops.shape[1] == 1:  # a length of few vectors: all meet
            fine = np.ones((len(left), len(right)), bool)
        else:
            fine = (bits[left] @ bits[right].T >= shared) & (weight[left] @ weight[right].T >= agreement) & (bits[left, :own] @ bits[right, :own].T == 0)
        a, b = np.nonzero(fine)
        a, b = left[a], right[b]
        if first == second:
            a, b = a[a < b], b[a < b]
        good = [np.zeros(0, bool)]
        for at in range(0, len(a), 65536):
            i, j = a[at : at + 65536], b[at : at + 65536]
            good.append(np.einsum("ij,ij->i", x[i], x[j]) >= cosine)
        good = np.concatenate(good)
        a, b = a[good], b[good]
        many = frame["copies"].to_numpy()
        links = np.bincount(a, many[b], n) + np.bincount(b, many[a], n)
        root = local_forest(n, a, b)
        hit = links > 0
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"id": ids[hit], "links": links[hit].astype(np.int64), "root": ids[root[hit]]})

    return run


def _pivots(one: DataFrame, lengths: list, rate: float) -> dict[int, np.ndarray]:
    """The pivots of the lengths with most vectors, drawn by hash, within ``PIVOT_BYTES``."""
    chosen, room = {}, PIVOT_BYTES
    for size, vectors in lengths:
        count = pivot_count(vectors, rate)
        room -= 8 * size * count
        if room < 0:
            break
        low = int(2.0**63 * min(1.0, (count + 6 * count**0.5) / vectors)) - 1  # a few more are drawn than are asked for, so that they suffice
        drawn = one.where((F.size("embedding") == size) & ((F.col("id").bitwiseAND(F.lit((1 << 63) - 1))) <= low)).orderBy("id").limit(count)
        chosen[size] = unit(np.array([r[0] for r in drawn.select("embedding").collect()], np.float64))
    return chosen


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, rate: float = PIVOT_RATE, nearest: int = NEAREST, shared: int = SHARED, agreement: float = AGREEMENT, block: int = BLOCK
) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to ``vec_id, n_links, component_id, kept``, a row a vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)
    keyed = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.sha2(F.to_json(F.struct("label", F.col("embedding").cast("array<string>").alias("v"))), 256)))
    members = materialise(keyed.select("vec_id", "key"), "members")
    # equal vectors are summed up before the shuffle; any one of them stands for all
    one = keyed.where("key is not null").groupBy("key").agg(F.count("*").cast("double").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    one = materialise(one.select("key", F.xxhash64("key").alias("id"), "copies", "least", "label", "embedding"), "distinct")

    lengths = materialise(one.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("vectors")), "lengths")
    bulk = lengths.where(F.col("vectors") > SMALL).orderBy(F.desc("vectors"), "size").limit(PIVOT_BYTES // (8 * PIVOTS_LEAST))  # more than these cannot have pivots within the bound
    chosen = _pivots(one, [tuple(r) for r in bulk.collect()], rate)

    described = join_small(one.select("id", "copies", "label", "embedding", F.size("embedding").alias("size")), lengths, ["size"])
    described = described.select("id", "copies", "label", "embedding", "size", "vectors").mapInPandas(_nearest(chosen, rate, nearest), "id long, copies double, label string, embedding array<double>, size int, pivots array<int>")
    described = materialise(described, "described")
    lists = described.withColumn("pivot", F.explode("pivots"))
    counts = described.select("label", "size", F.explode("pivots").alias("pivot")).groupBy("label", "size", "pivot").count()
    counts = materialise(counts.where("count > 1").select("label", "size", "pivot", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "lists")
    dealt = join_small(lists, counts, ["label", "size", "pivot"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = other.withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other"))
    compared = met.groupBy("label", "size", "pivot", "block_a", "block_b").applyInPandas(_compare(cosine, nearest, shared, agreement), "id long, links long, root long")
    compared = materialise(compared, "compared")

    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    found = connected_components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = one.select("key", "id", "copies", "least").join(links, "id", "left").join(found.withColumnRenamed("v", "id"), "id", "left")
    named = materialise(named.select("key", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("key", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    linked = join_small(members.where("key is not null"), materialise(named, "linked"), ["key"]).select("vec_id", "n_links", "component_id")
    alone = members.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
