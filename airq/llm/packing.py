"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Documents are tokenised once, on the executors, into pieces of at most one sequence. Only the histogram
of piece lengths (at most ``seq_len`` rows) reaches the driver, where lengths are placed longest first
into the emptiest pack that still has room; packs that look alike are one counted pattern. Each piece
then finds its pack by its rank among the pieces of its length.

Nulls and empty texts are documents of the end token alone; repeated rows are packed each on its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, partitions, tidy

SEQ_LEN = 2048
END_ID = 1
#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 400_000

#: Texts without such characters are split into words here; any other goes to the tokenizer whole.
OTHER = re.compile("[^\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\xa0-\\u012f\\u0131-\\u024f]")
#: The word pattern of the tokenizer file (a fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of a lower-casing, white-space-dropping word BPE file, remembering each word's ids.

    White space always parts words in such files, so a text's ids are its words' ids in order. Words
    not seen before go to the ``tokenizers`` library together; its tokens that end a word part them again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.words.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        for token, k in self.words.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        parts = [WORDS.findall(w) for w in words]
        flat = [p if p.isascii() else p.encode().decode("latin1").translate(self.letters) for p in chain.from_iterable(parts)]
        ids = np.array(self.words.encode_batch_fast([" ".join(flat)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(flat):
            raise ValueError("the vocabulary does not end every word with </w>")
        stop = np.concatenate([[0], last])[np.cumsum([0, *map(len, parts)])]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + stop[:-1]])
        self.counts = np.concatenate([self.counts, np.diff(stop)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids for each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, words = [], []
        for k, text in enumerate(texts):
            if not OTHER.search(text) and "<|" not in text:
                plain.append(k)
                words.append(text.lower().split())
            else:
                out[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.index) > CACHE_WORDS:
            self.forget()
        if unseen := list(set(chain.from_iterable(words)) - self.index.keys()):
            self._learn(unseen)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        counts = self.counts[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.starts[at] - total[:-1], counts) + np.arange(total[-1])]
        for k, part in zip(plain, np.split(ids, total[np.cumsum(list(map(len, words)))[:-1]] if words else []), strict=True):
            out[k] = part
        return out


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _cutter(path: str, seq_len: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    rows += [(doc_id, s, min(seq_len, len(ids) - s), zlib.crc32(ids[s : s + seq_len].tobytes()), len(ids)) for s in range(0, len(ids), seq_len)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return tidy(cut)


def cut_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """``docs(doc_id, text)`` to one row per piece of at most ``seq_len`` ids."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cutter(tokenizer_path, seq_len), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_histogram(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, list[int]]]:
    """Patterns ``(packs, lengths)``: every length of the histogram placed, longest first, into the shortest pack with room.

    A step uses up whole patterns but for one, and opens one at most, so there are at most two patterns per length.
    """
    by_used: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (fits := [u for u in by_used if u + length <= seq_len]):
            used = min(fits)
            packs, lengths = by_used[used].pop()
            if packs > left:
                by_used[used].append((packs - left, lengths))
                packs = left
            if not by_used[used]:
                del by_used[used]
            by_used.setdefault(used + length, []).append((packs, [*lengths, length]))
            left -= packs
        each = seq_len // length  # in a new pack the next of this length follow, as long as they fit
        for packs, many in ((left // each, each), (1, left % each)):
            if packs and many:
                by_used.setdefault(length * many, []).append((packs, [length] * many))
    return [p for used in sorted(by_used) for p in by_used[used]]


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows ``(length, first rank, first sequence, offset)`` by length and rank."""
    rows, taken, sequence = [], {}, 0
    for packs, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + packs
            offset += length
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _placer(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 45) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            slot = table[np.searchsorted(keys, (length << 45) | rank, "right") - 1]
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return place


def pack_pieces(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialised pieces ``(doc_id, start, length, ids_crc32, doc_tokens)``.

    Ranks are dealt within buckets of each length, so a length that many pieces share is not one task.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most seq_len rows
    table = slots(pack_histogram(counts, seq_len))
    share = max(16, min(20_000, sum(counts.values()) // (4 * partitions(spark))))
    buckets = spark.createDataFrame([(k, -(-n // share)) for k, n in counts.items()], "length long, buckets int")
    keyed = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "buckets"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = keyed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(within)).join(first, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - 1).alias("rank"))
    return ranked.mapInArrow(_placer(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Tokenise, cut and pack ``docs(doc_id, text)``: one row per piece, with its sequence and its offset there."""
    return pack_pieces(materialise(cut_documents(docs, tokenizer_path, seq_len), "pieces"), seq_len)
