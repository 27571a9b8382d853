"""Document fingerprints by consistent weighted sampling with gamma draws.

A text's terms are its pairs of neighbouring words (white space parts words; the last word stands alone), weighted by how often
they occur. For each term and each of ``SAMPLES`` places there are two gamma draws of shape 2, r and c, and a uniform
one, b, all by hash and so the same in every text. A term of weight w stands in a place at the step t = floor(ln w / r + b) of
a grid of logarithms, with the value c exp(-r (t - b + 1)); the place's sample is the term and step of the smallest value.
Two texts agree in a place with the probability of the generalised Jaccard similarity of their weights, which may be
fractions: the sum of the lesser weights over that of the greater ones (Ioffe's method).

**Order of the draws.** With these laws e = r b, f = r (1 - b) are independent exponential draws, and so are a = c exp(-f) and
c - a. So a, e and c - a are drawn, a first: it is the value at weight 1, and no smaller weight's value is below it. A term's
places share out the quantiles of a: each has one of as many equal parts, by a permutation that hangs on the term, and a
uniform draw within it. Each place so has its exponential draw, independent of those of other terms, which is all that the probability
above needs; and a term's places are known in about the order of their values.

**Draws that can't be the smallest are not made.** Of terms of weight 1 or less, only the parts of the smallest values are
drawn, up to ``REACH`` over the text's summed weights; of heavier terms all. Values beyond that limit are dropped, so a place that has
any left has its smallest. A text with an empty place (one in 2 x 10^8) is drawn whole in a second pass.

All of it is DataFrame operations. A task holds a text's words at once.

Null and empty texts are one empty term and so have equal fingerprints. A null id comes before all others.
Documents stand by id; where an id has several texts, each is fingerprinted, and the one of the smallest
hash is the predecessor's next text. Rows that repeat whole give as many equal rows. An empty table gives none.
Other columns are ignored, whatever their names.

``marks`` and what it calls draw in numpy what fits into one process, in the order of the formulas. No query runs them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, partitions

SAMPLES = 128
#: Terms of documents that are drawn for at once, words of a text that are read at once, and words whose hashes a worker remembers.
TERMS, WORDS, CACHE = 32_768, 1 << 18, 1 << 20
#: Terms whose draws are in hand at once, so that they stay in a processor's cache.
ROWS = 512
#: Bits of the table that r is taken from.
GAMMA_BITS = 14
#: Smallest values are looked for up to this over the summed weights; a place has none there with the probability exp(-REACH).
REACH = 24.0
#: Stands for a null id; smaller than all others.
NO_ID = -(1 << 63)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def gamma_table() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, in the middle of ``2**GAMMA_BITS`` equal parts, by Newton's steps."""
    q = (np.arange(1 << GAMMA_BITS) + 0.5) / (1 << GAMMA_BITS)
    x = np.sqrt(2 * q) - np.log1p(-q)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / (x * np.exp(-x)), x / 4)
    return x.astype(np.float32)


def _log_gamma(bits: np.ndarray, out: np.ndarray, room: np.ndarray, other: np.ndarray) -> None:
    """The logarithm of gamma draws of shape 2 into ``out``: of less the logarithm of two numbers between 0 and 1, of the upper 23 bits each."""
    for shift, to in ((41, out), (18, other)):
        np.right_shift(bits, np.uint64(shift), out=room)
        np.bitwise_and(room, np.uint64((1 << 23) - 1), out=room)
        np.copyto(to, room.view(np.int64), casting="unsafe")
        to += np.float32(0.5)
    out *= other
    out *= np.float32(2.0**-46)
    np.log(out, out=out)
    np.negative(out, out=out)
    np.log(out, out=out)


def keys(terms: np.ndarray, weights: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """For each term of a weight and each place a 64-bit key: the value, in an order that whole numbers keep, then 32 bits that name term and step.

    Everything is worked out in place, which takes half the time.
    """
    keyed = np.empty((len(terms), count), np.uint64)
    places = mix(np.arange(1, count + 1, dtype=np.uint64) * _ODD)
    logs, table = np.log(weights).astype(np.float32), gamma_table()
    out_, room_, r_, b_, value_ = (np.empty((min(ROWS, len(terms)), count), t) for t in (np.uint64, np.uint64, np.float32, np.float32, np.float32))
    order = np.argsort(logs != 0, kind="stable")  # most terms occur once; they need no step
    for at in range(0, len(terms), ROWS):
        here = order[at : at + ROWS]
        log = logs[here, None]
        out, room, r, b, value = (x[: len(here)] for x in (out_, room_, r_, b_, value_))
        h = mix(terms[here, None] ^ places)
        g = h >> np.uint64(29)
        g ^= h
        g *= _ODD
        np.right_shift(g, np.uint64(32), out=room)
        g ^= room
        np.right_shift(h, np.uint64(64 - GAMMA_BITS), out=room)
        np.take(table, room.view(np.int64), out=r, mode="clip")
        _log_gamma(g, value, room, b)  # ln c, whose small values decide, so it comes from no table
        np.bitwise_and(h, np.uint64((1 << 18) - 1), out=room)
        np.copyto(b, room.view(np.int64), casting="unsafe")
        b *= np.float32(2.0**-18)
        g >>= np.uint64(32)
        b -= np.float32(1)
        if log.any():
            t = np.floor(b + np.float32(1) + log / r)
            g += (t.astype(np.int64).astype(np.uint64) * _ODD) >> np.uint64(32)
            g &= np.uint64(0xFFFFFFFF)
            b -= t
        b *= r
        value += b  # ln c - r (t - b + 1)
        bits = value.view(np.uint32)
        sign = value.view(np.int32) >> np.int32(31)
        sign |= np.int32(-(1 << 31))
        bits ^= sign.view(np.uint32)
        np.copyto(out, bits)
        out <<= np.uint64(32)
        out |= g
        keyed[here] = out
    return keyed


def marks(terms: np.ndarray, weights: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """A weighted set's sample in each place, as 32 bits."""
    return keys(terms, weights, count).min(axis=0).astype(np.uint32)


class Words:
    """Words' hashes, remembered for a while."""

    def __init__(self):
        self.held: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.held) > CACHE:
            self.held.clear()
        held = self.held
        for word in set(words):
            if word not in held:
                held[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))

    def terms(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms and how often they occur."""
        found, last, at = [], None, 0
        while at < len(text) or not found:
            stop = at + 8 * WORDS
            while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
                stop += 1
            words = self.hashes(text[at:stop].split())
            at = stop
            if last is not None:
                words = np.concatenate([last, words])
            last = words[-1:]
            found.append(mix(mix(words[:-1].copy()) * _ODD + words[1:]))
        found.append(mix(mix(last.copy()) * _ODD + np.uint64(1)) if len(last) else np.ones(1, np.uint64))
        return np.unique(np.concatenate(found), return_counts=True)


def _printer(count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``id, hash, edited_sha256, text, edited`` (texts in UTF-8) to the first three and both texts' marks."""

    def of_group(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The marks of some weighted sets; draws are made once for equal terms of equal weights."""
        terms, weights = (np.concatenate(x) for x in zip(*sets, strict=True))
        _, first, place = np.unique(terms + weights.astype(np.uint64) * _ODD, return_index=True, return_inverse=True)
        best = [np.full(count, np.iinfo(np.uint64).max) for _ in sets]
        ends = np.cumsum([len(t) for t, _ in sets])
        for low in range(0, len(first), TERMS):  # several parts only where a single text is that long
            drawn = keys(terms[first[low : low + TERMS]], weights[first[low : low + TERMS]], count)
            for k, end in enumerate(ends):
                here = place[end - len(sets[k][0]) : end] - low
                here = here if len(first) <= TERMS else here[(here >= 0) & (here < len(drawn))]
                for part in range(0, len(here), 4096):
                    np.minimum(best[k], drawn[here[part : part + 4096]].min(axis=0), out=best[k])
        return [b.astype(np.uint32).view(np.int32) for b in best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()

        def finish(rows: list[tuple[int, int, str]], sets: list) -> pa.RecordBatch:
            found = of_group(sets)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * count + 1, count, dtype=np.int32)), pa.array(np.concatenate(found[k::2]))) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, *lists], names=["id", "hash", "edited_sha256", "marks", "edited_marks"])

        rows, sets, size = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                rows.append(tuple(batch.column(c)[k].as_py() for c in range(3)))
                sets += [words.terms(batch.column(c)[k].as_py() or b"") for c in (3, 4)]
                size += len(sets[-1][0]) + len(sets[-2][0])
                if size >= TERMS:
                    yield finish(rows, sets)
                    rows, sets, size = [], [], 0
        if rows:
            yield finish(rows, sets)

    return run


def _terms(text: str) -> Column:
    """A text's terms, as sorted hashes with repeats: pairs of words, and the last word alone."""
    white = " \t\n\v\f\r"
    words = F.split(F.trim(text, F.lit(white)), f"[{white}]+")
    hashes = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))))[0])


def weighted_terms(texts: DataFrame, by: list[str]) -> DataFrame:
    """``texts(*by, text)`` to a row for each of a text's distinct terms: ``by``, ``total`` (of all weights), ``term``, ``weight``."""
    sorted_ = texts.select(*by, _terms("text").alias("terms"))
    starts = F.transform(F.array("terms"), lambda a: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)), lambda i: i.isNotNull()))[0]
    runs = sorted_.select(*by, "terms", starts.alias("starts"))
    each = runs.select(*by, "terms", "starts", F.posexplode_outer("starts").alias("n", "start"))
    weight = F.coalesce(F.get("starts", F.col("n") + 1), F.size("terms")) - F.col("start")
    return each.select(*by, F.size("terms").cast("double").alias("total"), F.coalesce(F.get("terms", F.col("start")), F.lit(0)).alias("term"), weight.cast("double").alias("weight"))


def _uniform(*parts: str | Column) -> Column:
    """A number between 0 and 1, by hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def samples(sets: DataFrame, by: list[str], count: int = SAMPLES, reach: float | None = REACH) -> DataFrame:
    """``sets(*by, total, term, weight)``, each term of a set once, to ``by``, ``place`` and ``key``, whose lower 32 bits are the set's sample in that place.

    A place that no value within ``reach`` falls into has no row; without ``reach`` all have one.
    """
    bits = max((count - 1).bit_length(), 1)
    parts, mask, shift = 1 << bits, (1 << bits) - 1, (bits + 1) // 2
    drawn = F.lit(parts) if reach is None else F.when(F.col("total") * F.lit(1 / (reach * parts)) <= F.lit(1 / parts), F.lit(parts)).otherwise(F.ceil(F.lit(reach * parts) / F.col("total")).cast("int"))
    out = sets.select(*by, "term", "weight", drawn.alias("drawn"), F.xxhash64("term", F.lit(0)).alias("shape"))
    out = out.withColumn("part", F.explode_outer(F.sequence(F.lit(0), F.when(F.col("weight") <= 1, F.col("drawn")).otherwise(F.lit(parts)) - 1)))

    def bitsof(at: int) -> Column:
        return F.shiftrightunsigned("shape", at).bitwiseAND(F.lit(mask))

    # a permutation of the parts: products with odd numbers and shifted differences can be undone
    out = out.withColumn("x", (F.col("part").bitwiseXOR(bitsof(0)) * bitsof(15).bitwiseOR(F.lit(1))).bitwiseAND(F.lit(mask)))
    out = out.withColumn("x", (F.col("x").bitwiseXOR(F.shiftrightunsigned("x", shift)) * bitsof(30).bitwiseOR(F.lit(1))).bitwiseAND(F.lit(mask)))
    out = out.withColumn("place", (F.col("x").bitwiseXOR(F.shiftrightunsigned("x", shift)) + bitsof(45)).bitwiseAND(F.lit(mask)).cast("int"))
    if count < parts:
        out = out.where(F.col("place") < count)
    out = out.withColumn("u", (F.col("part") + _uniform("term", "part")) * F.lit(1 / parts))
    out = out.withColumn("a", F.greatest("u", -F.log(1 - F.col("u"))))  # the greater where the logarithm rounds to 0

    heavy = F.col("weight") != 1
    out = out.withColumn("e", F.when(heavy, -F.log(_uniform("term", "part", F.lit(1)))).otherwise(F.lit(0.0)))
    out = out.withColumn("r", F.when(heavy, F.col("e") + F.log1p(-F.log(_uniform("term", "part", F.lit(2))) / F.col("a"))).otherwise(F.lit(1.0)))  # f = ln(c / a)
    out = out.withColumn("t", F.when(heavy, F.floor((F.log("weight") + F.col("e")) / F.col("r"))).otherwise(F.lit(0)))
    out = out.withColumn("value", F.when(F.col("t") != 0, F.col("a") * F.exp(-F.col("r") * F.col("t"))).otherwise(F.col("a")))
    rank = F.least((F.col("value") / (1 + F.col("value")) * F.lit(2.0**31)).cast("long"), F.lit((1 << 31) - 1))
    name = F.when(F.col("t") == 0, F.col("term")).otherwise(F.xxhash64("term", "t")).bitwiseAND(F.lit((1 << 32) - 1))
    # no filter on values here: it would be pushed below what it is worked out from and make the code too long to be compiled
    within = (F.col("drawn") == parts) | (F.col("value") < F.col("drawn") * F.lit(1 / parts))
    key = F.when(within, F.shiftleft(rank, 32).bitwiseOR(name))
    return out.select(*by, "place", key.alias("key")).groupBy(*by, "place").agg(F.min("key").alias("key")).where("key is not null")


def sampled(both: DataFrame, count: int, reach: float | None) -> DataFrame:
    """``both(id, hash, edited_sha256, text, edited)`` to the first three and both texts' marks; ``whole`` tells whether all places have one."""
    by = ["id", "hash", "edited_sha256"]
    texts = both.select(*by, F.posexplode(F.array("text", "edited")).alias("which", "text"))
    found = samples(weighted_terms(texts, [*by, "which"]), [*by, "which"], count, reach)
    at = F.shiftleft((F.col("which") * count + F.col("place")).cast("long"), 32)
    lists = found.groupBy(*by).agg(F.sort_array(F.collect_list(at.bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 32) - 1))))).alias("found"))
    signed = F.expr("transform(found, x -> int(((x & 4294967295L) ^ 2147483648L) - 2147483648L))")
    lists = lists.select("id", "hash", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), signed.alias("found"))
    whole = F.size("found") == 2 * count
    return lists.select("id", "hash", "edited_sha256", F.slice("found", 1, count).alias("marks"), F.slice("found", count + 1, count).alias("edited_marks"), whole.alias("whole"))


def next_documents(ids: DataFrame) -> DataFrame:
    """``ids(id, ...)``, a row an id, with ``next_id``: the next larger id, after the largest the smallest.

    Ids are dealt by range; within a range the next row has it, and a range's last row takes the next range's first.
    """
    ranged = materialise(ids.repartitionByRange(partitions(ids.sparkSession), "id").withColumn("range", F.spark_partition_id()), "ranged")
    edges = ranged.groupBy("range").agg(F.min("id").alias("first"))  # a row a range
    later = Window.orderBy("range")
    edges = edges.select("range", F.coalesce(F.lead("first").over(later), F.min("first").over(Window.partitionBy())).alias("onward"))
    within = ranged.withColumn("next_id", F.lead("id").over(Window.partitionBy("range").orderBy("id")))
    return within.join(F.broadcast(edges), "range").withColumn("next_id", F.coalesce("next_id", "onward")).drop("range", "onward")


def fingerprints(docs: DataFrame, count: int = SAMPLES, reach: float | None = REACH) -> DataFrame:
    """``docs(doc_id, text)`` to a row per document: its fingerprint, that of its edited text and both likenesses.

    The edited text is the document with its last half replaced by as much of the next document's start.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), text.alias("text"))
    base = base.select("id", "text", F.xxhash64("text").alias("hash"))
    rows = materialise(base.groupBy("id", "hash").agg(F.count("*").alias("rows"), F.max(F.char_length("text")).cast("long").alias("n_chars")), "rows")
    ids = rows.groupBy("id").agg(F.min("hash").alias("first_hash"), F.max("n_chars").alias("longest"))
    order = materialise(next_documents(ids), "order")
    before = order.select(F.col("next_id").alias("id"), F.col("first_hash").alias("hash_before"), F.col("id").alias("id_before"), F.expr("longest div 2").alias("wanted"))
    places = order.select("id", "first_hash", "next_id").join(before, "id").select("id", "first_hash", "next_id", "id_before", "wanted")

    # a task groups all places of its texts, so it gets half as many texts as other tasks; both joins read the same shuffle, as places are dealt likewise
    tasks = 2 * partitions(base.sparkSession)
    whole = base.repartition(tasks, "id")
    if not rows.where("rows > 1").isEmpty():
        whole = whole.dropDuplicates(["id", "hash"])
    heads = whole.join(places.repartition(tasks, "id"), "id").where("(hash ^ first_hash) = 0").select(F.col("id_before").alias("id"), F.expr("left(text, int(wanted))").alias("head"))
    edited = F.concat(F.expr("left(text, char_length(text) - int(char_length(text) div 2))"), F.expr("left(head, int(char_length(text) div 2))"))
    both = whole.join(heads, "id").select("id", "hash", "text", edited.alias("edited"))
    both = both.select("id", "hash", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256"), "text", "edited")
    drawn = materialise(sampled(both, count, reach), "drawn")
    if not drawn.where("not whole").isEmpty():
        again = both.join(drawn.where("not whole").select("id", "hash"), ["id", "hash"], "leftsemi")
        drawn = materialise(drawn.where("whole").unionByName(sampled(again, count, None)), "drawn")
    drawn = drawn.drop("whole")
    known = drawn.join(rows, ["id", "hash"]).join(places.select("id", "first_hash", "id_before"), "id")
    signed = materialise(known.withColumn("first", F.col("hash") == F.col("first_hash")).drop("first_hash"), "signed")

    following = signed.where("first").select(F.col("id_before").alias("id"), F.col("marks").alias("next_marks"))
    out = signed.join(following, "id")
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", _hex("marks").alias("fingerprint"), _hex("edited_marks").alias("edited_fingerprint"),
        likeness("marks", "edited_marks").alias("near_edited"), likeness("marks", "next_marks").alias("near_next"),
    )


def _hex(marks: str) -> Column:
    return F.expr(f"array_join(transform({marks}, m -> lpad(lower(hex(m & 4294967295L)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """The share of places in which two fingerprints agree."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> int(x = y)), 0, (n, x) -> n + x) / double(size({a}))")
