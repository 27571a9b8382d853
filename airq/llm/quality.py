"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. What a line looks like (``FEATURES``: its length, kinds of characters, words, how far it
repeats itself or earlier lines) is cut into ``BINS`` parts at quantiles of the sample; a line's bins and those of the lines before
and after it have weights, and so has each step from good or bad to good or bad. Forward and backward messages give each
line's probability of being good; their mean, weighted by the lines' lengths, is the text's raw quality, and a logistic curve
fitted on a held-back fifth of the sample makes it the score.

Labels say of whole texts only whether they are good. The field is fitted to them by expectation and maximisation: lines of
good texts are good; those of bad texts are bad at first, then, in each of ``ROUNDS`` further fits, as far as the field itself
thinks so among texts that hold at least one bad line. The sample is about ``SAMPLE`` texts of either label; of a text of more than
``WINDOW`` lines, so many consecutive ones, drawn by hash, are fitted to. Scores read every line of every text.

A null text is an empty one, and an empty text one empty line. If labels of one kind are missing, every score is ``UNSURE``. Texts
and lines of any length are read whole; repeated rows are scored alike and are one row of the sample; an empty table gives no rows;
other columns are ignored, whatever their names. Of several labels of an id the larger holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_small, materialise

SAMPLE, WINDOW = 2500, 200
BINS, ROUNDS, STEPS = 8, 2, 120
#: Labelled ids, of 12 bytes each, that may be broadcast; more of them are joined by a shuffle.
LABELS = 2_000_000
THRESHOLD, UNSURE = 0.3, 0.5
#: Penalty on squared weights, for each line of the sample.
PENALTY = 1e-4
#: Code points of a text that are classed at once.
PIECE = 1 << 20
KINDS = ("space", "lower", "upper", "digit", "stop", "dash", "mark")
FEATURES = ("length", "words", "word length", *KINDS, "marks a word", "capitals a word", "distinct words", "distinct pairs", "pairs seen before", "line seen before", "ends in a stop")


@cache
def _kind_of() -> np.ndarray:
    """The kind of each code point: white space, letters, digits, stops, dashes and quotes, all other marks."""

    def kind(k: int) -> int:
        c = chr(k)
        if c.isalpha():
            return 2 if c.isupper() else 1
        return 0 if c.isspace() else 3 if c.isdigit() else 4 if c in ".,;:?" else 5 if c in "-'\"()«»“”‘’„–—" else 6

    low = np.fromiter((kind(k) for k in range(0x3000)), np.uint8, 0x3000)
    return np.concatenate([low, [1]]).astype(np.uint8)  # what lies beyond counts as letters


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the lines' lengths."""
    lines = text.splitlines() or [""]
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    kinds = _kind_of()
    sizes = np.array([len(x) for x in lines], np.int64)
    counts = np.zeros((len(lines), len(KINDS)))
    for k in np.flatnonzero(sizes):
        for at in range(0, sizes[k], PIECE):
            points = np.frombuffer(lines[k][at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
            counts[k] += np.bincount(kinds[np.minimum(points, len(kinds) - 1)], minlength=len(KINDS))
    seen_lines: set[str] = set()
    seen_pairs: set[int] = set()
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        pairs = set(map(hash, zip(words, words[1:], strict=False)))
        out[k, -5:] = (
            len(set(words)) / n if n else 1,
            len(pairs) / (n - 1) if n > 1 else 1,
            len(pairs & seen_pairs) / len(pairs) if pairs else 0,
            n > 0 and line in seen_lines,
            n > 0 and words[-1][-1] in ".?!…:;",
        )
        out[k, 1] = math.log1p(n)
        seen_pairs |= pairs
        if n:
            seen_lines.add(line)
    n = np.maximum(np.expm1(out[:, 1]), 1)
    filled = np.maximum(sizes, 1)
    out[:, 0] = np.log1p(sizes)
    out[:, 2] = (sizes - counts[:, 0]) / n
    out[:, 3 : 3 + len(KINDS)] = counts / filled[:, None]
    at = 3 + len(KINDS)
    out[:, at], out[:, at + 1] = counts[:, 6] / n, counts[:, 2] / n
    return out, np.maximum(sizes, 1)


def expand(bins: np.ndarray) -> np.ndarray:
    """Each line's bins, then those of the line before and of the line after; a text's ends have a bin of their own."""
    own = bins + np.arange(bins.shape[1]) * (BINS + 1)
    width = bins.shape[1] * (BINS + 1)
    edge = BINS + np.arange(bins.shape[1]) * (BINS + 1)
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    return np.hstack([own, before + width, after + 2 * width])


def messages(unary: np.ndarray, step: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For one text, in logarithms' scores (a row a line, a column a state): marginals of lines and of steps, and the logarithm of the normaliser."""
    n = len(unary)
    # two states: plain numbers are faster than arrays
    s00, s01, s10, s11 = (float(x) for x in step.reshape(-1))
    forward = [0.0] * (2 * n)
    a, b = float(unary[0, 0] + ends[0]), float(unary[0, 1] + ends[1])
    forward[0:2] = (a, b)
    rows = unary.tolist()
    for k in range(1, n):
        a, b = rows[k][0] + _add(a + s00, b + s10), rows[k][1] + _add(a + s01, b + s11)
        forward[2 * k] = a
        forward[2 * k + 1] = b
    total = _add(a, b)
    back = [0.0] * (2 * n)
    a = b = 0.0
    for k in range(n - 1, 0, -1):
        u, v = rows[k][0] + a, rows[k][1] + b
        a, b = _add(s00 + u, s01 + v), _add(s10 + u, s11 + v)
        back[2 * k - 2] = a
        back[2 * k - 1] = b
    f, g = np.array(forward).reshape(n, 2), np.array(back).reshape(n, 2)
    marginals = np.exp(f + g - total)
    joint = np.exp(f[:-1, :, None] + step + (unary[1:] + g[1:])[:, None, :] - total)
    return marginals, joint, total


def _add(a: float, b: float) -> float:
    """The logarithm of the sum of two numbers given by their logarithms."""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class Model:
    """Cuts of the features, weights of their bins (for good against bad), of steps and ends, and the curve of the score."""

    def __init__(self, cuts: np.ndarray):
        self.cuts = cuts
        self.weights = np.zeros(3 * len(FEATURES) * (BINS + 1))
        self.step, self.ends = np.zeros((2, 2)), np.zeros(2)
        self.slope, self.level = 1.0, 0.0

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[k], rows[:, k], side="right") for k in range(rows.shape[1])], axis=1)

    def unary(self, active: np.ndarray) -> np.ndarray:
        good = self.weights[active].sum(axis=1)
        return np.stack([np.zeros(len(good)), good], axis=1)

    def marginals(self, rows: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        return messages(self.unary(expand(self.bins(rows))), self.step, self.ends)[0][:, 1]

    def raw(self, rows: np.ndarray, sizes: np.ndarray) -> float:
        return float(np.average(self.marginals(rows), weights=sizes))

    def score(self, text: str) -> float:
        return self.curve(self.raw(*features(text)))

    def curve(self, raw: float) -> float:
        z = self.slope * _logit(raw) + self.level
        return 1 / (1 + math.exp(-z)) if z > 0 else math.exp(z) / (1 + math.exp(z))

    def fit(self, texts: list[np.ndarray], said: list[np.ndarray], steps: int = STEPS) -> None:
        """Gradient steps (with momentum and a scale of each weight's own) on the likelihood of lines, ``said`` being how far each is good."""
        flat = np.vstack(texts)
        first = np.cumsum([0, *map(len, texts)])
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        lengths = np.array([len(texts[k]) for k in order])
        starts = first[:-1][order]
        truth = np.concatenate(said)
        inner = np.ones(len(flat), bool)
        inner[first[:-1]] = False
        n = len(flat)
        goal = np.bincount(flat.reshape(-1), np.repeat(truth, flat.shape[1]), len(self.weights))
        both = np.stack([1 - truth, truth], axis=1)
        goal_step = (both[:-1, :, None] * both[1:, None, :])[inner[1:]].sum(axis=0)
        goal_ends = both[first[:-1]].sum(axis=0)
        moment = [np.zeros_like(x) for x in (self.weights, self.step, self.ends)]
        square = [np.zeros_like(x) for x in moment]
        for round_ in range(1, steps + 1):
            marginals, joint = self._together(flat, starts, lengths)
            slopes = [
                (np.bincount(flat.reshape(-1), np.repeat(marginals[:, 1], flat.shape[1]), len(self.weights)) - goal) / n + PENALTY * self.weights,
                (joint - goal_step) / n + PENALTY * self.step,
                (marginals[first[:-1]].sum(axis=0) - goal_ends) / n + PENALTY * self.ends,
            ]
            for held, slope, m, v in zip((self.weights, self.step, self.ends), slopes, moment, square, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                held -= 0.1 * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.999**round_)) + 1e-8)

    def _together(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``messages`` of many texts at once, longest first: marginals of all lines, and the sum of all steps' marginals."""
        unary = self.unary(flat)
        forward, back = np.zeros((len(flat), 2)), np.zeros((len(flat), 2))
        forward[starts] = unary[starts] + self.ends
        active = [int((lengths > t).sum()) for t in range(int(lengths.max()))]
        for t in range(1, len(active)):
            at = starts[: active[t]] + t
            forward[at] = unary[at] + np.logaddexp(forward[at - 1][:, :1] + self.step[0], forward[at - 1][:, 1:] + self.step[1])
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            ahead = unary[at] + back[at]
            back[at - 1] = np.logaddexp(self.step[:, 0] + ahead[:, :1], self.step[:, 1] + ahead[:, 1:])
        ends = starts + lengths - 1
        by_place = np.argsort(starts)
        owner = np.repeat(by_place, lengths[by_place])  # texts lie end to end in the order of their starts
        total = np.logaddexp(forward[ends, 0], forward[ends, 1])[owner]
        marginals = np.exp(forward + back - total[:, None])
        inner = np.ones(len(flat), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        joint = np.exp(forward[at - 1][:, :, None] + self.step + (unary[at] + back[at])[:, None, :] - total[at][:, None, None]).sum(axis=0)
        return marginals, joint

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: tuple[float, float]) -> None:
        """Fit the field, then the score's curve on every fifth text; ``weights`` is what a text of label 0 and 1 counts there."""
        active = [expand(self.bins(r)) for r, _ in rows]
        fit = [k for k in range(len(rows)) if k % 5] or list(range(len(rows)))
        said = [np.full(len(active[k]), float(labels[k])) for k in fit]
        self.fit([active[k] for k in fit], said)
        for _ in range(ROUNDS):
            for place, k in enumerate(fit):
                if not labels[k]:
                    said[place] = self._given_one_bad(active[k])
            self.fit([active[k] for k in fit], said, STEPS // 2)
        held = [k for k in range(len(rows)) if k % 5 == 0]
        raw = np.array([_logit(self.raw(*rows[k])) for k in held])
        self._calibrate(raw, labels[held], np.array(weights)[labels[held]])

    def _given_one_bad(self, active: np.ndarray) -> np.ndarray:
        """How far each line is good, given that not all are."""
        unary = self.unary(active)
        marginals, _, total = messages(unary, self.step, self.ends)
        all_good = unary[:, 1].sum() + self.step[1, 1] * (len(active) - 1) + self.ends[1]
        p = min(math.exp(min(0.0, all_good - total)), 1 - 1e-9)
        return np.clip((marginals[:, 1] - p) / (1 - p), 0, 1)

    def _calibrate(self, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Newton's steps on a logistic curve of one variable, lightly held to (1, 0)."""
        x = np.stack([raw, np.ones(len(raw))], axis=1)
        w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weights * (p - labels)) + 0.5 * (w - prior)
            curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
            move = np.linalg.solve(curve, slope)
            w = w - np.clip(move, -1, 1)
        self.slope, self.level = max(float(w[0]), 0.05), float(w[1])


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def learnable(doc_id: Column) -> Column:
    """Rows whose label may be learned: the crc32 of their id as text leaves a remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and lengths of a text's lines; of long texts, of a window of lines drawn by the row's hash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            rows, sizes = [], []
            for text, draw in zip(part.column(0), part.column(2).to_pylist(), strict=True):
                found, lengths = features(text.as_py() or "")
                low = draw % (len(found) - WINDOW + 1) if len(found) > WINDOW else 0
                rows.append(found[low : low + WINDOW].tobytes())
                sizes.append(lengths[low : low + WINDOW].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(sizes, pa.binary()), part.column(1)], names=["rows", "sizes", "quality"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; None without labelled texts of both kinds."""
    known = labels.where(learnable(F.col("doc_id"))).where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = materialise(known, "known")
    texts = join_small(docs.select("doc_id", "text"), known, ["doc_id"], rows=LABELS)
    sizes = {r["quality"]: r["count"] for r in join_small(docs.select("doc_id"), known, ["doc_id"], rows=LABELS).groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("quality") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    drawn = texts.select("text", "quality", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("draw")).where(F.col("draw") < share * float(1 << 40))
    found = drawn.dropDuplicates(["quality", "draw"]).select("text", "quality", "draw").mapInArrow(_described, "rows binary, sizes binary, quality int").collect()
    found = sorted((bytes(r["rows"]), bytes(r["sizes"]), r["quality"]) for r in found)
    order = np.random.default_rng(5).permutation(len(found))
    rows = [(np.frombuffer(found[k][0], np.float32).reshape(-1, len(FEATURES)), np.frombuffer(found[k][1], np.int64)) for k in order]
    said = np.array([found[k][2] for k in order], np.int64)
    if len(set(said.tolist())) < 2:
        return None
    every = np.vstack([r for r, _ in rows])
    cuts = np.quantile(every, np.arange(1, BINS) / BINS, axis=0).T
    model = Model(np.ascontiguousarray(cuts))
    model.train(rows, said, tuple(sizes[k] / max(1, int((said == k).sum())) / (sizes[0] + sizes[1]) * len(said) for k in (0, 1)))
    return model


def _scorer(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                scores = [model.score(t.as_py() or "") if model else UNSURE for t in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, held_out, score, predicted``, reading nothing but the text for a score."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")
