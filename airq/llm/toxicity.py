"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

Over all labelled rows that may be learned from, the texts of either label that hold each word are counted; a word's
beginnings count what their words do. Terms, whole words or beginnings, are those that toxic texts hold far more often than
others (``LEAST_ODDS``, in log odds), by a likelihood ratio that no term of the table would reach by chance: twice the logarithm
of their number. Nothing else limits the lexicon. Its tries, ``TERMS`` terms in each, are intersected with the
automata of edit distance one and made deterministic, so that each word of each text is read once a trie, letter by
letter, and words that can match nothing are dropped at once. A hit weighs what
its term, its misspelling and its standing within quotation marks have told in a bounded sample of labelled rows (``SAMPLE`` of
either label, about, of which only the hits reach the driver); the best hit, their sum, the densest window of ``WINDOW`` words
and the share of quoted hits make the features of a logistic regression.

Null and empty texts, and texts without a hit, get the score of no hit. If no label of either kind can be learned
from, every score is 0. Texts of any length are read whole. Repeated rows are scored alike, and are one row of the sample; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_small, materialise

SAMPLE = 6000
#: Terms of one trie; there are as many tries as it takes.
TERMS = 500
WINDOW = 40
LEAST_ODDS = 2.5
#: Texts from which a kind of hit is weighed by itself.
LEAST_DOCS = 5
#: Labelled ids, of 12 bytes each, that may be broadcast; more of them are joined by a shuffle.
LABELS = 2_000_000
#: Words that a task holds before it passes their counts on.
HELD = 200_000
#: Letters from which a word may be misspelled, and a word's beginning.
EDIT_WORD, EDIT_BEGINNING = 5, 7
SHORTEST, LONGEST = 4, 9
THRESHOLD = 0.7
POINTS = 0x110000
OPENING, CLOSING, BOTH = "“«„‹", "”»›", '"'


@cache
def _word_points() -> np.ndarray:
    return np.array([chr(k).isalnum() for k in range(POINTS)])


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits."""
    edge = np.flatnonzero(np.diff(_word_points()[points].astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


class Automaton:
    """The lexicon's trie intersected with automata of at most one edit, as one table of states.

    ``hit[state]`` is 1 + 2 * term + edits where a word may end, else 0. A beginning has matched for good at the first letter at which it does, misspelled or not.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        letters = sorted({c for t, _ in terms for c in t})
        self.classes = np.zeros(max(map(ord, letters), default=0) + 2, np.int16)  # the last stands for all letters beyond
        for k, c in enumerate(letters):
            self.classes[ord(c)] = k + 1
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        edits = [0]  # edits that some term below allows
        for number, (term, beginning) in enumerate(terms):
            allowed, node = int(len(term) >= (EDIT_BEGINNING if beginning else EDIT_WORD)), 0
            edits[0] = max(edits[0], allowed)
            for c in term:
                if (k := letters.index(c) + 1) not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    ends.append([])
                    edits.append(0)
                node = children[node][k]
                edits[node] = max(edits[node], allowed)
            ends[node].append(number)

        def closed(found: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            for node, used in list(found):
                if not used and edits[node]:
                    # a beginning less its last letter is no misspelling of it
                    found.update((child, 1) for child in children[node].values() if edits[child] and not any(terms[t][1] for t in ends[child]))
            return frozenset((n, u) for n, u in found if not (u and (n, 0) in found))

        def best(found: frozenset[tuple[int, int]], beginning: bool) -> int:
            hits = [1 + 2 * t + u for n, u in found for t in ends[n] if terms[t][1] == beginning and (not u or len(terms[t][0]) >= (EDIT_BEGINNING if beginning else EDIT_WORD))]
            return min(hits, key=lambda h: ((h - 1) % 2, h), default=0)

        start = closed({(0, 0)})
        numbers, order = {frozenset(): 0, start: 1}, [frozenset(), start]
        table, hit = [[0] * (len(letters) + 1)], [0]
        sticky: dict[int, int] = {}
        while len(table) < len(order):
            found = order[len(table)]
            if isinstance(found, int):  # a beginning has matched
                table.append([len(table)] * (len(letters) + 1))
                hit.append(found)
                continue
            row = []
            for k in range(len(letters) + 1):
                after: set[tuple[int, int]] = set()
                for node, used in found:
                    if k in children[node]:
                        after.add((children[node][k], used))
                    if not used and edits[node]:
                        after.add((node, 1))
                        after.update((child, 1) for c, child in children[node].items() if c != k and edits[child])
                ahead = closed(after)
                if mark := best(ahead, True):
                    if mark not in sticky:
                        sticky[mark] = len(order)
                        order.append(mark)
                    row.append(sticky[mark])
                    continue
                if ahead not in numbers:
                    numbers[ahead] = len(order)
                    order.append(ahead)
                row.append(numbers[ahead])
            table.append(row)
            hit.append(best(found, False))
        self.table, self.hit = np.array(table, np.int32), np.array(hit, np.int32)

    def read(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each word its hit, or 0."""
        marks = np.zeros(len(starts), np.int32)
        alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        kinds = self.classes[np.minimum(points, len(self.classes) - 1)]
        while len(alive):
            state = self.table[state, kinds[at]]
            at = at + 1
            done = at >= stops[alive]
            marks[alive[done]] = self.hit[state[done]]
            going = ~done & (state > 0)
            alive, state, at = alive[going], state[going], at[going]
        return marks


def quoted(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether places stand within quotation marks: an odd number of plain ones before, or an open pair."""
    opened = np.isin(points, [ord(c) for c in OPENING]).astype(np.int64) - np.isin(points, [ord(c) for c in CLOSING])
    plain = points == ord(BOTH)
    if not opened.any() and not plain.any():
        return np.zeros(len(at), bool)
    odd = (np.cumsum(plain)[at] % 2 == 1) & (at < np.flatnonzero(plain)[-1] if plain.any() else False)
    return odd | (np.cumsum(opened)[at] > 0)


class Lexicon:
    """Automata over all terms, neighbours by spelling together."""

    def __init__(self, terms: list[tuple[str, bool]], each: int = TERMS):
        self.terms = sorted(terms)
        self.parts = [(at, Automaton(self.terms[at : at + each])) for at in range(0, len(self.terms), each)]

    def read(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each word its hit, 1 + 2 * term + edits, or 0; one without an edit goes before one with."""
        marks = np.zeros(len(starts), np.int64)
        for at, part in self.parts:
            found = part.read(points, starts, stops).astype(np.int64)
            better = (found > 0) & ((marks == 0) | (found % 2 > marks % 2))  # odd marks have no edit
            marks[better] = found[better] + 2 * at
        return marks


def hits(lexicon: Lexicon, text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's hits, ``4 * term + 2 * edits + quoted``, and the numbers of their words."""
    points = points_of(text)
    starts, stops = words_of(points)
    marks = lexicon.read(points, starts, stops)
    at = np.flatnonzero(marks)
    kinds = 2 * (marks[at] - 1) + quoted(points, starts[at]) if len(at) else np.zeros(0, np.int64)
    return kinds.astype(np.int64), at


class Model:
    """Lexicon, a weight for each kind of hit, and the regression's coefficients."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.lexicon = Lexicon(terms)
        self.weights = np.zeros(4 * len(terms) + 4)
        self.coefficients = np.zeros(5)

    def features(self, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = np.maximum(self.weights[kinds], 0)
        told = w > 0
        if not told.any():
            return np.array([1.0, 0, 0, 0, 0])
        at, w = at[told], w[told]
        dense = np.searchsorted(at, at + WINDOW, "left") - np.arange(len(at))
        return np.array([1.0, w.max(), np.log1p(w.sum()), np.log(dense.max()), (kinds[told] % 2).mean()])

    def score(self, text: str) -> float:
        z = self.features(*hits(self.lexicon, text)) @ self.coefficients
        return float(1 / (1 + np.exp(-z)))

    def fit(self, found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """Weigh the kinds of hits of labelled texts by their smoothed log odds, then regress."""
        size = len(self.weights)
        held = [np.bincount(np.concatenate([np.unique(k) for (k, _), v in zip(found, y, strict=True) if v == label] or [np.zeros(0, np.int64)]), minlength=size) for label in (0, 1)]
        n = [max(1, int((y == label).sum())) for label in (0, 1)]
        self.weights = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
        self.weights[held[0] + held[1] == 0] = 0.0
        for kind in np.flatnonzero((held[0] + held[1] < LEAST_DOCS) & (np.arange(size) % 4 != 0)):  # rarely seen: half of what the plain term tells
            self.weights[kind] = self.weights[kind - kind % 4] / 2
        x = np.array([self.features(*f) for f in found])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ self.coefficients))
            slope = x.T @ (p - y) + 0.01 * self.coefficients
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(x.shape[1]), slope)
            self.coefficients = self.coefficients - step
            if np.abs(step).max() < 1e-8:
                break


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: the crc32 of their id as text leaves no remainder of 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of either label hold each word, summed up over as many texts as fit."""
    held = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        for toxic, rows in enumerate(held):
            counts, none = pa.array(list(rows.values()), pa.int64()), pa.array(np.zeros(len(rows), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *((none, counts) if not toxic else (counts, none))], names=["word", "toxic", "other"])
            rows.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            points = points_of(text)
            low = points.tobytes().decode("utf-32-le", "surrogatepass")
            held[toxic].update({low[a:b] for a, b in zip(*map(np.ndarray.tolist, words_of(points)), strict=True) if b - a >= SHORTEST})
            if sum(map(len, held)) > HELD:
                yield from flush()
    yield from flush()


def choose(candidates: list[tuple[str, bool, int]]) -> list[tuple[str, bool]]:
    """Of terms with their counts those that tell something of their own, most frequent first.

    Of a word and its beginnings that are about as frequent, the longest stands for all.
    """
    kept: list[tuple[str, bool]] = []
    beginnings: set[str] = set()
    words: set[str] = set()
    under: dict[str, int] = {}  # the largest count of a kept term with that beginning
    for term, beginning, count in sorted(candidates, key=lambda c: (-c[2], -len(c[0]), c[1], c[0])):
        covered = any(term[:n] in beginnings for n in range(1, len(term) + 1)) or (beginning and under.get(term, 0) * 1.1 >= count) or (not beginning and term in words)
        if not covered:
            kept.append((term, beginning))
            (beginnings if beginning else words).add(term)
            for n in range(1, len(term) + 1):
                under[term[:n]] = max(count, under.get(term[:n], 0))
    return kept


def telling(words: DataFrame, toxic: int, other: int) -> DataFrame:
    """Of ``words(word, toxic, other)``, counts of texts, the terms ``(term, beginning, toxic)`` that tell; ``toxic`` and ``other`` texts there are in all."""
    short = words.select(F.explode(F.expr(f"transform(sequence({SHORTEST}, least({LONGEST}, char_length(word))), n -> left(word, n))")).alias("term"), F.lit(True).alias("beginning"), "toxic", "other")
    terms = words.select(F.col("word").alias("term"), F.lit(False).alias("beginning"), "toxic", "other").unionByName(short)
    terms = materialise(terms.groupBy("term", "beginning").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "terms")
    odds = F.log((F.col("toxic") + 0.5) / float(toxic + 1)) - F.log((F.col("other") + 0.5) / float(other + 1))
    many = F.col("toxic") + F.col("other")
    share = toxic / (toxic + other)
    surprise = [F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (many * float(p)))).otherwise(0.0) for c, p in (("toxic", share), ("other", 1 - share))]
    bound = 2 * np.log(max(2, terms.count()))
    return terms.where(odds >= LEAST_ODDS).where(2 * (surprise[0] + surprise[1]) >= float(bound)).select("term", "beginning", "toxic")


def _hits(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hits(lexicon, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)], batch.column(1)], names=["kinds", "places", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; None without labelled texts of both kinds."""
    known = labels.where(learnable(F.col("doc_id"))).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialise(known, "known")
    texts = join_small(docs.select("doc_id", "text").where("text is not null"), known, ["doc_id"], rows=LABELS)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    drawn = texts.select("toxic", "text", draw.alias("draw"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    words = materialise(texts.select("text", "toxic").mapInArrow(_words, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "words")
    model = Model(choose([tuple(r) for r in telling(words, sizes[1], sizes[0]).collect()]))
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    rows = drawn.where(F.col("draw") < share * float(1 << 40)).dropDuplicates(["toxic", "draw"]).select("text", "toxic").mapInArrow(_hits(model.lexicon), "kinds array<long>, places array<long>, toxic int").collect()
    if len({r["toxic"] for r in rows}) < 2:
        return None
    model.fit([(np.array(r["kinds"], np.int64), np.array(r["places"], np.int64)) for r in rows], np.array([r["toxic"] for r in rows]))
    return model


def _scorer(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") if model else 0.0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, held_out, score, predicted``, reading nothing but the text for a score."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")
