"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of the hashed n-grams (one to three characters, white space and everything that is no
letter counting as one blank) are counted over all documents that may be learned from. The weights are trained
on a bounded sample of those with a language, drawn evenly by language, with follow-the-regularised-leader steps under an
elastic net; a held-back fifth of the sample sets the temperature that calibrates the probabilities.

The sample is about ``SAMPLE`` rows, but ``LEAST`` of each language, or all that it has, however many languages there are.
The n-grams are hashed to at most ``BITS`` bits, fewer where languages are so many that the weights would pass ``WEIGHTS``.

A null text, an empty one and one without letters are ``und`` with score 0, as is every text if nothing can be
learned from. Texts of any length are read whole; repeated rows are predicted alike and are one row of the sample; an empty
table gives no rows. ``identify`` ignores other columns, ``keep_identified`` keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import as_row, join_small, materialise, tidy

#: Bits of an n-gram's hash, at most and at least, and weights that a model holds but for the last.
BITS, BITS_LEAST, WEIGHTS = 16, 10, 1 << 24
GRAMS = 3
SAMPLE, LEAST = 3000, 20
#: Rows that a Python worker passes on at once.
ROWS_AT_ONCE = 1000
#: Code points that there can be.
POINTS = 0x110000
UNKNOWN = "und"
#: Follow-the-regularised-leader: step size, its offset, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
EPOCHS = 3


@cache
def letters() -> np.ndarray:
    """For each code point the letter that it counts as: its own number, or 0 if it is none."""
    return np.fromiter((k if chr(k).isalpha() else 0 for k in range(POINTS)), np.uint32, POINTS)


def grams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A text's hashed n-grams and their counts; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[points].astype(np.uint64)
    keep = (known > 0) | (np.concatenate([[1], known[:-1]]) > 0)  # one blank for a run of them
    known = np.concatenate([[0], known[keep], [0]]).astype(np.uint64)
    if not known.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled, found = np.zeros(len(known), np.uint64), []
    for n in range(1, GRAMS + 1):
        rolled = rolled[: len(known) - n + 1] * np.uint64(0x100000001B3) + known[n - 1 :]
        found.append(((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << bits)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def _frequencies(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                held[grams(text.as_py() or "", bits)[0]] += 1
                documents += 1
        ids = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(held[ids], documents))], names=["gram", "documents"])

    return run


def _counted(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t.as_py() or "", bits) for t in batch.column(1)]
            ids, counts = (pa.array([x[k].astype(np.uint32).tobytes() for x in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, counts], names=["lang", "ids", "counts"])

    return run


class Model:
    """Languages, inverse document frequencies, weights (a row an n-gram, a column a language) and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf, self.temperature = langs, idf.astype(np.float32), 1.0
        self.bits = int(np.log2(len(idf)))
        self.weights = np.zeros((len(idf), len(langs)), np.float32)

    def features(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[ids]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(ids, counts) @ self.weights[ids]

    def probabilities(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.logits(ids, counts).astype(np.float64) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """Follow the regularised leader over the rows, then calibrate on every fifth."""
        fit, held = [r for k, r in enumerate(rows) if k % 5], rows[::5]
        z, n = np.zeros(self.weights.shape), np.zeros(self.weights.shape)
        order = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for k in order.permutation(len(fit)):
                ids, counts, y = fit[k]
                zi, ni, x = z[ids], n[ids], self.features(ids, counts)
                w = np.where(np.abs(zi) <= L1, 0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
                p = x @ w
                p = np.exp(p - p.max())
                p /= p.sum()
                p[y] -= 1
                g = x[:, None] * p
                z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[ids] = ni + g * g
        self.weights = np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)
        logits = np.array([self.logits(i, c) for i, c, _ in held], np.float64).reshape(-1, len(self.langs))
        y = np.array([k for _, _, k in held], int)

        def loss(t: float) -> float:
            v = logits / t
            return float((np.log(np.exp(v - v.max(1, keepdims=True)).sum(1)) + v.max(1) - v[np.arange(len(y)), y]).mean())

        self.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss)) if len(y) else 1.0


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: the crc32 of their id as text leaves no remainder of 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Model | None:
    """A model of ``docs(doc_id, text, lang)``; None without any labelled text."""
    allowed = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(learnable(F.col("doc_id"))).where("text is not null")
    labelled = allowed.where("lang is not null")
    sizes = materialise(labelled.groupBy("lang").agg(F.count("*").alias("many")), "languages")
    classes = sizes.count()  # the model holds a column of weights for each, so they fit the driver
    if not classes:
        return None
    bits = int(min(BITS, max(BITS_LEAST, np.log2(WEIGHTS / classes))))
    rows = allowed.select("text").mapInArrow(tidy(_frequencies(bits)), "gram long, documents long").groupBy("gram").agg(F.sum("documents").alias("documents")).collect()  # at most 2**BITS + 1
    held, total = np.zeros(1 << bits), 0
    for r in rows:
        if r["gram"] < 0:
            total = r["documents"]
        else:
            held[r["gram"]] = r["documents"]
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40))
    wanted = float(max(least, sample / classes))
    share = sizes.select("lang", F.when(F.col("many") > 2 * least, F.lit(wanted) / F.col("many")).otherwise(F.lit(1.0)).alias("share"))
    drawn = join_small(labelled.select("lang", "text", draw.alias("draw")), materialise(share, "shares"), ["lang"]).where(F.col("draw") < F.col("share") * float(1 << 40))
    found = drawn.select("lang", "text", "draw").dropDuplicates(["lang", "draw"]).select("lang", "text").mapInArrow(tidy(_counted(bits)), "lang string, ids binary, counts binary").collect()
    found = sorted((r["lang"], bytes(r["ids"]), bytes(r["counts"])) for r in found if r["ids"])
    if not found:
        return None
    langs = sorted({k for k, _, _ in found})
    place = {k: n for n, k in enumerate(langs)}
    model = Model(langs, np.log((1 + total) / (1 + held)) + 1)
    examples = [(np.frombuffer(i, np.uint32).astype(np.int64), np.frombuffer(c, np.uint32), place[k]) for k, i, c in found]
    model.train([examples[k] for k in np.random.default_rng(11).permutation(len(examples))])
    return model


def _predictor(model: Model | None, field: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the language and its score to the columns but the last, which holds the text; or, with ``field``, to all, the last being a struct that holds the text under that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                last = batch.column(batch.num_columns - 1)
                langs, scores = [], []
                for text in last if field is None else last.field(field):
                    ids, counts = grams(text.as_py() or "", model.bits) if model else ((), ())
                    p = model.probabilities(ids, counts) if len(ids) else None
                    langs.append(UNKNOWN if p is None else model.langs[int(p.argmax())])
                    scores.append(0.0 if p is None else float(p.max()))
                kept = batch.num_columns - (field is None)
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:kept], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, held_out, lang_pred, score``, reading nothing but the text for a prediction."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(tidy(_predictor(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``least``, their ``lang`` set to it; other columns as they are."""
    model = train(docs.select("doc_id", "text", "lang"))
    rows = as_row(docs)
    said = rows.mapInArrow(tidy(_predictor(model, "text")), StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    said = said.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return said.select(F.col("row").withField("lang", F.col("lang_pred").cast(docs.schema["lang"].dataType)).alias("row")).select("row.*")
