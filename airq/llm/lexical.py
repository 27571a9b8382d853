"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

A query term's list holds the documents with the term by falling impact, its integer share of a score. Documents stay in
the partitions they are read in; each task cuts its documents into indexes of about ``POSTINGS`` list entries. In an index
the lists of an item's terms are read side by side, in growing steps; a document met for the first time is looked up
directly in all of them (its row of the index holds the impacts and the positions of all its terms), which marks those positions
as seen as well. A list's best position is the end of its contiguous seen positions; the impacts there add up to what a document
not seen yet can reach at most, tighter than the impacts last read. The search stops when that sum is strictly below
the ``k``-th score, as an equal score may still win by a smaller id. A task carries its best ``k`` of an item from index to
index, so later ones stop earlier, and returns them once; the best of all tasks are an item's result.

Nothing is shuffled but those few rows and the document frequencies. Items are taken in blocks of about ``TERMS`` terms, the
only thing that passes through the driver; each block reads the documents once.

An item with a null text, or without terms, has no rows; repeated items have their rows each, null ids of items stay null. A
document without terms scores nothing. Repeated documents are ranked each; of equal scores the smaller ``doc_id`` comes
first, null ones last. Texts of any length are read whole, a megabyte at a time. Empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise

K = 50
#: Terms of items, repeats between items counted, that pass through the driver at once.
TERMS = 500_000
#: List entries of one index.
POSTINGS = 1 << 20
#: Positions of each list that are read at first; every further step doubles them.
STEP = 16
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20
#: ASCII letters, lower-cased, and digits stay, other ASCII characters part terms; all else stays.
_FOLD = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or chr(k).isalnum() else 32 for k in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in UTF-8, piece by piece."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        stop = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        stop = len(folded) if stop < 0 else stop
        yield folded[at:stop].split()
        at = stop


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({t for part in terms(x.as_py() or b"") for t in part}) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])


def _counter(numbers: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's number of terms, and which of the numbered terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, held, often = [], [], []
                for text in batch.column(1):
                    n, counts = 0, Counter()
                    for part in terms(text.as_py() or b""):
                        n += len(part)
                        counts.update(map(numbers.get, part))
                    counts.pop(None, None)
                    sizes.append(n)
                    held.append(list(counts))
                    often.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return run


class Best:
    """The best ``k`` of a growing set of scored documents; equal scores go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """The score that a document must reach: the ``k``-th, or 1 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor()
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


class Index:
    """Impact lists of some documents: each term's documents by falling impact, and each document's terms with their positions.

    ``held`` and ``impacts`` are the documents' terms and impacts, one document after the other, ``sizes`` how many each has (at least one).
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, held: np.ndarray, impacts: np.ndarray, count: int):
        self.ids, self.sizes, self.held, self.impacts = ids, sizes, held, impacts
        self.first = np.cumsum(sizes) - sizes
        documents = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((documents, -impacts, held))
        self.list_documents, self.list_impacts = documents[order], impacts[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=count))])
        self.position = np.empty(len(order), np.int64)  # of each entry of the documents' rows, in the lists laid end to end
        self.position[order] = np.arange(len(order))
        self.seen, self.met, self.asked = np.zeros(len(order), bool), np.zeros(len(ids), bool), np.zeros(count, bool)
        self.read = 0  # documents looked up, for tests

    def search(self, wanted: np.ndarray, best: Best, tight: bool = True) -> int:
        """Add an item's documents to ``best``; returns how deep its lists were read. Without ``tight`` the stopping rule is that of last-read positions."""
        lists = wanted[self.start[wanted] < self.start[wanted + 1]]
        if not len(lists):
            return 0
        low, high = self.start[lists], self.start[lists + 1]
        self.asked[lists] = True
        reach, depth, step, found = low.copy(), 0, STEP, []
        while True:
            spans = [(a + depth, min(a + depth + step, b)) for a, b in zip(low, high, strict=True) if a + depth < b]
            for a, b in spans:
                self.seen[a:b] = True
            met = np.concatenate([self.list_documents[a:b] for a, b in spans])
            new = np.unique(met[~self.met[met]])
            depth, step = depth + step, 2 * step
            if len(new):
                self.met[new] = True
                found.append(new)
                self._look_up(new, best)
            deepest = depth >= (high - low).max()
            if deepest:
                break
            if tight:
                for k in range(len(lists)):
                    if reach[k] < high[k]:
                        ahead = self.seen[reach[k] : high[k]]
                        gap = int(ahead.argmin())
                        reach[k] = high[k] if ahead[gap] else reach[k] + gap
            else:
                reach = np.minimum(low + depth, high)
            # a list read to its end holds no document that was not seen
            limit = int(np.where(reach < high, self.list_impacts[reach - 1], 0).sum())
            if len(best.scores) == best.k and limit < best.floor():
                break
        self.asked[lists] = False
        for a, b in zip(low, high, strict=True):
            self.seen[a:b] = False
        for new in found:
            self.met[new] = False
        return depth

    def _look_up(self, new: np.ndarray, best: Best) -> None:
        """The whole scores of documents, from their own rows; all their positions in the item's lists count as seen."""
        sizes = self.sizes[new]
        ends = np.cumsum(sizes)
        entries = np.arange(ends[-1]) + np.repeat(self.first[new] - (ends - sizes), sizes)
        asked = self.asked[self.held[entries]]
        best.add(np.add.reduceat(np.where(asked, self.impacts[entries], 0), ends - sizes), self.ids[new])
        self.seen[self.position[entries[asked]]] = True
        self.read += len(new)


def impact(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


#: Stands for a null id among documents; it comes last.
NO_ID = (1 << 63) - 1


def _searcher(items: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, length: int, k: int, postings: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best documents of a task for each item; a null id is told from the largest one by a mark of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(Best(k), Best(k)) for _ in items]  # documents with and without an id

        def finish(parts: list[tuple[np.ndarray, ...]], has_id: bool) -> None:
            ids, sizes, n, held, tfs = (np.concatenate(x) for x in zip(*parts, strict=True))
            m = np.array([50 + 50 * int(x) * documents // length for x in n], np.int64)  # Python's integers, as the product may pass 64 bits
            index = Index(ids, sizes, held, impact(weights[held], tfs, np.repeat(m, sizes)), len(weights))
            for (_, wanted), tops in zip(items, best, strict=True):
                index.search(wanted, tops[not has_id])

        waiting: dict[bool, list] = {True: [], False: []}
        filled = {True: 0, False: 0}
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n, sizes = batch.column(1).to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            held, tfs = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            for has_id in (True, False):
                rows = known == has_id
                if rows.any():
                    entries = np.repeat(rows, sizes)
                    waiting[has_id].append((ids[rows], sizes[rows].astype(np.int64), n[rows], held[entries], tfs[entries]))
                    filled[has_id] += int(entries.sum())
                if filled[has_id] >= postings:
                    finish(waiting[has_id], has_id)
                    waiting[has_id], filled[has_id] = [], 0
        for has_id, parts in waiting.items():
            if parts:
                finish(parts, has_id)
        for (item, _), tops in zip(items, best, strict=True):
            for top, has_id in zip(tops, (True, False), strict=True):
                if len(top.ids):
                    ids = pa.array(top.ids) if has_id else pa.nulls(len(top.ids), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), item)), ids, pa.array(top.scores)], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, most: int = TERMS, postings: int = POSTINGS) -> DataFrame:
    """``docs(doc_id, text)`` and ``items(item_id, text)`` to ``item_id, rank, doc_id, score``: each item's ``k`` highest scores above 0."""
    spark = docs.sparkSession
    named = materialise(items.select("item_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("item")), "items")
    asked = materialise(named.select("item", "text").mapInArrow(_item_terms, "item long, terms array<binary>").where("size(terms) > 0"), "asked")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # about ``most`` terms
        names = sorted({bytes(t) for r in rows for t in r["terms"]})
        numbers = {t: i for i, t in enumerate(names)}
        if not numbers:
            continue
        wanted = [(r["item"], np.array(sorted(numbers[bytes(t)] for t in r["terms"]), np.int64)) for r in rows]
        hits = materialise(texts.mapInArrow(_counter(numbers), "doc_id long, n long, terms array<int>, tfs array<long>"), "hits")
        documents, length = hits.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(names), np.int64)
        for r in hits.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
            frequency[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)
        found.append(hits.where("size(terms) > 0").mapInArrow(_searcher(wanted, weights, documents, length, k, postings), "item long, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").select(F.col("item_id").cast(items.schema["item_id"].dataType), "rank", "doc_id", "score")
    tops = found[0]
    for other in found[1:]:
        tops = tops.unionAll(other)
    ranked = tops.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, n, unnest(found) AS term FROM (SELECT doc_id, found, len(found) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents WHERE text IS NOT NULL) a) b),
whole AS (SELECT count(DISTINCT doc_id) AS documents_n, CAST(count(*) AS BIGINT) AS terms_n FROM words),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) q),
held AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weighed AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * documents_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, whole GROUP BY term, documents_n),
scored AS (
  SELECT a.item_id, h.doc_id, CAST(sum(g.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (100 - 50 + ((50 * h.n * e.documents_n) // e.terms_n))))) AS BIGINT) AS score
  FROM asked a JOIN held h USING (term) JOIN weighed g USING (term) CROSS JOIN whole e GROUP BY a.item_id, h.doc_id)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0) r WHERE place <= 50
"""
