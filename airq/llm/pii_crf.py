"""Personal data: base patterns, and a skip-chain conditional random field that makes labels agree across a document.

The patterns find e-mail addresses, IP addresses, card and phone numbers. Their spans and all other tokens with
digits or an @, plain or written out, or that repeat the name of an address, are the nodes of a document's graph. Neighbouring nodes are joined
by chain edges, and distant ones that repeat or resemble each other (same digits, same text but for case and
written-out signs, an address and its name) by skip edges. The field's potentials (shapes to labels, neighbours to each other,
and how far either kind of skip edge asks for the same label) are trained together by pseudo-likelihood on a bounded sample:
each node's label given its neighbours'. The patterns' spans are the labels; a node that no pattern found but that a skip
edge ties to one is left out, as nobody knows its label. Nodes are also shown masked, without their shape, and so
is one more occurrence of each span, written in another way: so the field learns what an occurrence that the
patterns miss can only learn from the others. Loopy message passing then labels the nodes that no pattern matched, in
documents with and without spans; nodes with a belief of at least ``BELIEF`` are added. Spans of the patterns are observed and
always stay.

Null and empty texts have no spans. Repeated rows are read alike, and are one row of the sample; an empty table gives no rows;
other columns, whatever their names, are ignored by ``find`` and kept by ``redact``. Groups of similar nodes are joined to
their first and their previous member, so edges grow with the nodes, however long a text is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy

KINDS = ("email", "ip", "card", "phone")
#: Rows that a Python worker rewrites at once.
ROWS_AT_ONCE = 1000
#: Texts that the field is trained on, about.
SAMPLE = 4000
BELIEF = 0.9
#: Kinds of skip edges: same digits or text, a name alone.
SAME, NAME = 0, 1
ROUNDS = 25
#: Steps of the training, their size, and the penalty on squared weights.
STEPS, RATE, PENALTY = 300, 0.1, 1e-4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D\"'<>\[\]{},;]+")
_TELLING = re.compile(r"[0-9@]")
_CANDIDATE = re.compile(r"[0-9@]|\(at\)|_at_", re.I)

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, leftmost and not overlapping within a kind, ordered by start and kind."""
    out: list[Span] = []
    if not _TELLING.search(text):
        return out
    at, free = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        while domain and start > free and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            free = domain.end()
            out.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shape(said: str) -> np.ndarray:
    """What a token looks like, as numbers."""
    digits, letters = len(_DIGITS.sub("", said)), sum(c.isalpha() for c in said)
    parts = [len(p) for p in re.split(r"[^0-9]+", said) if p]
    return np.array([
        1, "@" in said, said.startswith("+"), digits in range(10, 16), digits in range(14, 20), 4 <= digits < 10, 0 < digits < 4, digits > 19, letters == 0, letters > digits,
        len(parts) == 4 and max(parts) <= 3 and letters == 0, said.count(".") == 3, "(" in said, len(said) > 20, "=" in said or "://" in said, " at " in said or "(at)" in said,
        digits in range(14, 20) and _luhn(_DIGITS.sub("", said)), len(parts) == 4 and all(int(p) <= 255 for p in re.findall("[0-9]{1,3}", said)),
    ], np.float64)


def nodes(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """``(start, end, label)`` in order; the label of a span is 1 + its kind, that of another candidate 0."""
    if not _CANDIDATE.search(text):
        return []
    taken = [(a, b, 1 + k) for a, k, b in spans]
    names = {text[a:b].split("@")[0].casefold() for a, k, b in spans if k == 0}
    covered, stops = sorted((a, b) for a, b, _ in taken), 0
    at = 0
    for m in _TOKEN.finditer(text):
        while at < len(covered) and covered[at][0] <= m.start():
            stops = max(stops, covered[at][1])
            at += 1
        if m.start() < stops or (at < len(covered) and covered[at][0] < m.end()):
            continue
        said = m[0].rstrip(".:!?()")
        if said and (_CANDIDATE.search(said) or said.casefold() in names):
            taken.append((m.start(), m.start() + len(said), 0))
    return sorted(taken)


def skip_edges(said: list[str]) -> list[tuple[int, int, int]]:
    """Joins nodes that repeat or resemble each other, each with the first and the previous of its group."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    out = []
    for k, one in enumerate(said):
        folded = one.casefold()
        for sign, long in (("@", ("(at)", "[at]", "_at_")), (".", ("(dot)", "[dot]", "_dot_"))):
            for word in long:
                folded = folded.replace(word, sign)
        digits = _DIGITS.sub("", one)
        keys = [("t" + folded, SAME)]
        if len(digits) >= 9:
            keys.append(("d" + digits[-9:], SAME))
        name = folded.split("@")[0]
        if len(name) >= 4 and not name.isdigit():
            keys.append(("n" + name, NAME))
        joined: dict[int, int] = {}
        for key, kind in keys:
            for other in {first.get(key), last.get(key)} - {None}:
                joined[other] = min(kind, joined.get(other, kind))
            first.setdefault(key, k)
            last[key] = k
        out += [(other, k, kind) for other, kind in joined.items()]
    return out


def rewritten(said: str, label: int) -> str:
    """An occurrence of a span as people write it where they don't want it found."""
    if label == 1:
        return said.replace("@", "(at)")
    return said.replace(".", "[.]") if label == 2 else _DIGITS.sub("", said)


class Field:
    """The trained potentials: shapes to labels, neighbours to each other, and for either kind of skip edge what agreeing is worth."""

    def __init__(self) -> None:
        self.unary = np.zeros((len(shape("")), 1 + len(KINDS)))
        self.chain = np.zeros((1 + len(KINDS),) * 2)
        self.skip = np.zeros(2)

    def agreement(self, kind: int) -> np.ndarray:
        return np.eye(1 + len(KINDS)) * self.skip[kind]

    def fit(self, documents: list[tuple[list[str], list[int]]]) -> None:
        """Maximise the pseudo-likelihood of the labels that are known."""
        many = 1 + len(KINDS)
        shapes, before, after, tied, truth, weight = [], [], [], [], [], []
        hidden = shape("") * 0
        hidden[0] = 1
        for said, labels in documents:
            n = len(said)
            extra = [k for k in range(n) if labels[k]]  # each span once more, in another spelling, as the chain's end
            said = [*said, *(rewritten(said[k], labels[k]) for k in extra)]
            labels = [*labels, *(labels[k] for k in extra)]
            ties = np.zeros((len(said), 2, many))
            unsure = np.zeros(len(said), bool)
            for a, b, kind in skip_edges(said):
                ties[a, kind, labels[b]] += 1
                ties[b, kind, labels[a]] += 1
                unsure[a] |= not labels[a] and bool(labels[b])
                unsure[b] |= not labels[b] and bool(labels[a])
            for k in np.flatnonzero(~unsure):
                seen = shape(said[k]) if k < n else hidden
                left = labels[k - 1] if 0 < k < n else -1
                right = labels[k + 1] if k < n - 1 else -1
                for x in [seen, hidden] if k < n else [seen]:
                    shapes.append(x)
                    before.append(left)
                    after.append(right)
                    tied.append(ties[k])
                    truth.append(labels[k])
        if not truth:
            return
        x, y = np.array(shapes), np.eye(many)[truth]
        one = np.eye(many + 1)[:, :many]  # -1, no neighbour, is a row of zeros
        before, after, tied = one[before], one[after], np.array(tied)
        weight = 1 / np.maximum(1, y.sum(0))[truth]  # every label has one voice
        weight = (0.5 * weight / weight.sum() + 0.5 / len(y))[:, None]
        parts = [self.unary, self.chain, self.skip]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, STEPS + 1):
            z = x @ self.unary + before @ self.chain + after @ self.chain.T
            z += np.einsum("nkl,k->nl", tied, self.skip)
            p = np.exp(z - z.max(1, keepdims=True))
            wrong = weight * (p / p.sum(1, keepdims=True) - y)
            slopes = [x.T @ wrong, before.T @ wrong + wrong.T @ after, np.einsum("nkl,nl->k", tied, wrong)]
            for value, slope, m, v in zip(parts, slopes, first, second, strict=True):
                slope = slope + PENALTY * value
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def beliefs(self, said: list[str], labels: list[int]) -> np.ndarray:
        """Each node's label probabilities by loopy sum-product messages, halved into the old ones."""
        n, many = len(said), self.chain.shape[0]
        own = np.array([shape(s) for s in said]) @ self.unary
        seen = np.array(labels) > 0
        own[seen] = -1e3
        own[np.flatnonzero(seen), np.array(labels)[seen]] = 0
        edges = [(k, k + 1, self.chain) for k in range(n - 1)] + [(a, b, self.agreement(kind)) for a, b, kind in skip_edges(said)]
        a = np.array([e[0] for e in edges] + [e[1] for e in edges], int)
        b = np.array([e[1] for e in edges] + [e[0] for e in edges], int)
        if not len(a):
            return np.exp(own - np.logaddexp.reduce(own, 1, keepdims=True))
        table = np.array([e[2] for e in edges] + [e[2].T for e in edges])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(a), many))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, b, message)
            sent = np.logaddexp.reduce((total[a] - message[back])[:, :, None] + table, axis=1)
            sent = 0.5 * message + 0.5 * (sent - sent.max(1, keepdims=True))
            moved = np.abs(sent - message).max()
            message = sent
            if moved < 1e-3:
                break
        total = own.copy()
        np.add.at(total, b, message)
        return np.exp(total - np.logaddexp.reduce(total, 1, keepdims=True))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The patterns' spans, and all spans."""
        base = base_spans(text)
        found = nodes(text, base)
        if all(label for _, _, label in found):
            return base, base
        p = self.beliefs([text[a:b] for a, b, _ in found], [label for _, _, label in found])
        added = [(a, int(v.argmax()) - 1, b) for (a, b, label), v in zip(found, p, strict=True) if not label and v.argmax() and v.max() >= BELIEF]
        return base, sorted([*base, *added])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t, nodes(t, base_spans(t))) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([[t[a:b] for a, b, _ in n] for t, n in rows], pa.list_(pa.string())), pa.array([[k for _, _, k in n] for _, n in rows], pa.list_(pa.int64()))], names=["said", "labels"]
        )


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from about ``sample`` different texts with digits or an @, drawn by their hash."""
    field = Field()
    telling = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("draw"))
    texts = telling.select("draw").distinct().count()
    drawn = telling.where(F.col("draw") < float(1 << 40) * min(1.0, sample / max(1, texts))).dropDuplicates(["draw"]).select("text")
    rows = drawn.mapInArrow(tidy(_labelled), "said array<string>, labels array<long>").collect()
    field.fit(sorted((r["said"], r["labels"]) for r in rows if r["said"]))
    return field


def _finder(field: Field) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [field.spans(t.as_py() or "") for t in batch.column(1)]
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([written(every) for _, every in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, a row a row."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_finder(field)), f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or what overlapping spans cover, replaced by its first kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redactor(field: Field, place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = [t and redacted(t, field.spans(t)[1]) for t in batch.column(place).to_pylist()]
                yield batch.set_column(place, batch.schema.names[place], pa.array(texts, batch.schema.types[place]))

    return run


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by its kind, and ``n_chars`` counted anew where there is one."""
    done = docs.mapInArrow(tidy(_redactor(field, docs.columns.index("text"))), docs.schema)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
