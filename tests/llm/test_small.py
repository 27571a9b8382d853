"""Each operator on small tables with nulls, empty and repeated rows, against plain computations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from airq.llm import embed_neardup, fingerprint, langid, mixing, ngram_join, packing, pii_crf, token_rollup, toxicity
from airq.llm.common import join_small, materialise
from airq.llm.graph import connected_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, size int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One TWO"), (4, "  ")]
    for k in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "x" + str(k)
        rows.append((10 + k, " ".join(w)))
    return [*rows, rows[6], (99, "long " * 9000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, None if k == 11 else "en", None if k % 7 == 0 else f"s{k % 3}", 1) for k, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 51), (51, 50), (7, 7), (None, 3)], "a long, b long")
    found = {r.v: r.component for r in connected_components(edges).collect()}
    assert found == {k: 1 for k in range(1, 31)} | {50: 50, 51: 50}


def test_ngram_join(docs, none, texts):
    sets = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect())
    assert got == sorted((k, len(sets[k]), root[k]) for k, _ in texts)
    assert ngram_join.components(none).count() == 0


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    by_sequence = {}
    for r in rows:
        ids = np.array([*whole.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_pack_histogram():
    rng = random.Random(1)
    counts = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(300)}
    patterns = packing.pack_histogram(counts)
    placed = {}
    for packs, lengths in patterns:
        assert sum(lengths) <= 2048
        for n in lengths:
            placed[n] = placed.get(n, 0) + packs
    assert placed == counts and len(patterns) <= 2 * len(counts)
    assert packing.pack_histogram({512: 9}) == [(1, [512]), (2, [512] * 4)]


def test_mixing(docs, none, texts):
    rows = mixing.copies(docs).collect()
    assert len(rows) == len(texts) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum({r.target for r in rows}) - 1.5 * total) < 1e-6 * total or len({r.target for r in rows}) < 4
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() >= len([r for r in rows if r.taken])
    assert mixing.copies(none).count() == 0


def test_fingerprints(docs, none, texts):
    rows = fingerprint.fingerprints(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(k for k, _ in texts)
    same = {}
    for r in rows:
        assert same.setdefault(dict(texts)[r.doc_id] or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprint.fingerprints(none).count() == 0


def test_fingerprint_accuracy(spark, none):
    rng = random.Random(4)
    said = {}
    for k in range(0, 120, 2):  # pairs of neighbouring ids, from short to long, unlike to different degrees
        w = words(rng, rng.choice([3, 20, 100, 400, 3000])).split() * rng.choice([1, 2])
        said[k], said[k + 1] = " ".join(w), " ".join(rng.choice(w) if rng.random() < k / 600 else x for x in w)
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(said.items()), "doc_id long, text string")).collect()}
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 8 * 128 for r in got.values())

    def weights(text):
        w = text.split()
        return Counter(zip(w, [*w[1:], None]))

    errors = []
    for k in range(0, 120, 2):
        a, b = weights(said[k]), weights(said[k + 1])
        errors.append(got[k].near_next - (a & b).total() / (a | b).total())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_samples_agree_as_often_as_weights_say():
    """Fractional weights against exact generalised Jaccard, place by place over many places."""
    rng = np.random.default_rng(7)
    for scale in (1e-3, 1.0, 50.0):
        terms = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a = rng.gamma(0.5, scale, 60) * (rng.random(60) < 0.8)
        b = np.where(rng.random(60) < 0.5, a, a * rng.uniform(0.2, 3, 60)) * (rng.random(60) < 0.9)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = [fingerprint.marks(terms[w > 0], w[w > 0], 8192) for w in (a, b)]
        assert abs((got[0] == got[1]).mean() - exact) < 0.02
        # a term is sampled in proportion to its weight
        drawn = fingerprint.keys(terms[a > 0], a[a > 0], 8192).argmin(axis=0)
        assert np.abs(np.bincount(drawn, minlength=(a > 0).sum()) / 8192 - a[a > 0] / a.sum()).max() < 0.02


def test_draws_follow_their_laws():
    """A weight's smallest value is an exponential one of that rate."""
    for w in (0.3, 1.0, 7.5):
        key = fingerprint.keys(np.arange(1, 200, dtype=np.uint64) * np.uint64(7919), np.full(199, w), 256)
        bits = (key >> np.uint64(32)).astype(np.uint32)
        value = np.exp(np.where(bits >> np.uint32(31), bits ^ np.uint32(0x80000000), ~bits).astype(np.uint32).view(np.float32).astype(float)).ravel()
        assert abs(value.mean() * w - 1) < 0.03 and abs((value * w < 0.1).mean() - 0.0952) < 0.005 and abs((value * w < 2).mean() - 0.8647) < 0.01


def test_fingerprints_run_no_python(docs, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refused)
    assert "Python" not in fingerprint.fingerprints(docs)._jdf.queryExecution().toString()


def plain_marks(text, count=128):
    """All draws of all terms, one by one."""
    import math

    import xxhash

    def hashed(*parts):  # numbers that are counted are of 32 bits, hashes and steps of 64
        h = 42
        for x in parts:
            h = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else (x[0] & (1 << 64) - 1).to_bytes(8, "little") if isinstance(x, tuple) else x.to_bytes(4, "little"), h)
        return h

    words = [hashed(w) for w in text.encode().split() or [b""]]
    terms = Counter([hashed((x,), (y,)) for x, y in itertools.pairwise(words)] + [hashed((words[-1],))])
    best = [(1 << 64, None)] * count
    for term, weight in terms.items():
        shape = hashed((term,), 0)
        for part in range(count):
            x = ((part ^ shape & 127) * (shape >> 15 & 127 | 1)) & 127
            x = ((x ^ x >> 4) * (shape >> 30 & 127 | 1)) & 127
            place = ((x ^ x >> 4) + (shape >> 45 & 127)) & 127
            u, e, d = ((hashed((term,), part, *more) >> 11) * 2.0**-53 + 2.0**-54 for more in ((), (1,), (2,)))
            a = -math.log(1 - (part + u) / count)
            e, c = -math.log(e), a - math.log(d)  # r b, and c
            r = e + math.log(c / a)
            b = e / r
            t = math.floor(math.log(weight) / r + b)
            value = c * math.exp(-r * (t - b + 1))
            best[place] = min(best[place], (value, (hashed((term,), (t,)) if t else term) & 0xFFFFFFFF))
    return "".join(f"{mark:08x}" for _, mark in best)


def test_fingerprints_by_brute_force(spark):
    """Texts with and without repeats against all of their draws by the formulas; a short reach leaves places empty, which a second pass fills."""
    rng = random.Random(9)
    texts = ["", " \t\n", "one", " one\x0btwo\f", "a " * 500 + "b", words(rng, 300), " ".join(rng.choices(["x", "y", "z", "zz"], k=400)), words(rng, 900) + " the end" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {k: plain_marks(t) for k, t in enumerate(texts)}
    for reach in (fingerprint.REACH, 1.5):
        rows = fingerprint.fingerprints(docs, reach=reach).collect()
        assert {r.doc_id: r.fingerprint for r in rows} == plain
        for r in rows:
            text, following = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
            edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.edited_fingerprint == plain_marks(edited)
    short = fingerprint.sampled(docs.selectExpr("doc_id as id", "0L as hash", "unhex('00') as edited_sha256", "text", "text as edited"), 128, 1.5)
    assert short.where("not whole").count() > 0  # so there was something to fill


def test_native_samples_of_fractional_weights(spark):
    """The rate of equal samples is generalised Jaccard, and a term is sampled in proportion to its weight."""
    rng = np.random.default_rng(5)
    for scale in (1e-3, 1.0, 50.0):
        terms = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)]
        a = rng.gamma(0.5, scale, 60) * (rng.random(60) < 0.8)
        b = np.where(rng.random(60) < 0.5, a, a * rng.uniform(0.2, 3, 60)) * (rng.random(60) < 0.9)
        rows = [(n, float(w.sum()), t, float(x)) for n, w in enumerate((a, b)) for t, x in zip(terms, w, strict=True) if x > 0]
        sets = spark.createDataFrame(rows, "n int, total double, term long, weight double")
        near = fingerprint.samples(sets, ["n"], 8192).collect()
        assert len(near) == 2 * 8192 and sorted(near) == sorted(fingerprint.samples(sets, ["n"], 8192, None).collect())
        got = [{r.place: r.key & 0xFFFFFFFF for r in near if r.n == n} for n in (0, 1)]
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(sum(got[0][p] == got[1][p] for p in range(8192)) / 8192 - exact) < 0.02
        # weights below 1 move steps, and so names; those of one weight alone are the term's own
        ones = spark.createDataFrame([(0, 60.0, t, 1.0) for t in terms], "n int, total double, term long, weight double")
        drawn = Counter(r.key & 0xFFFFFFFF for r in fingerprint.samples(ones, ["n"], 8192).collect())
        assert set(drawn) <= {t & 0xFFFFFFFF for t in terms} and max(abs(x / 8192 - 1 / 60) for x in drawn.values()) < 0.01


def test_terms_in_parts(monkeypatch):
    rng = random.Random(3)
    texts = ["", "  ", "one", "one two", " a b\tc\n\na b ", words(rng, 700)]
    whole = [fingerprint.Words().terms(t.encode()) for t in texts]
    monkeypatch.setattr(fingerprint, "WORDS", 1)
    parts = [fingerprint.Words().terms(t.encode()) for t in texts]
    assert all((a == b).all() for x, y in zip(whole, parts, strict=True) for a, b in zip(x, y, strict=True))
    counts = [Counter(zip(w, [*w[1:], None])).total() or 1 for w in (t.split() for t in texts)]
    assert [int(c.sum()) for _, c in whole] == counts and (whole[0][0] == whole[1][0]).all()
    monkeypatch.setattr(fingerprint, "TERMS", 50)  # draws in parts as well
    run = fingerprint._printer(128)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(6)), pa.array(["x"] * 6), pa.array([t.encode() for t in texts]), pa.array([t.encode() for t in texts[::-1]])], names=list("abcde"))
    got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    plain = [fingerprint.marks(t, c.astype(float)).view(np.int32).tolist() for t, c in whole]
    assert [r["marks"] for r in got] == plain and [r["edited_marks"] for r in got] == plain[::-1]


def embeddings(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, pivots int")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_neardup.near_duplicates(df).collect()), key=str)


def linked(rows):
    """Links, components and what is kept by brute force, vectors scaled before they are squared."""
    unit = {}
    for n, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / max(map(abs, v))
            unit[n] = (label, len(v)), x / np.linalg.norm(x)
    links = {n: [m for m in unit if m != n and unit[m][0] == unit[n][0] and unit[m][1] @ unit[n][1] >= 0.93] for n in unit}
    root = list(range(len(rows)))
    for _ in rows:
        for n, found in links.items():
            for m in found:
                root[n] = root[m] = min(root[n], root[m])
    least = {}
    for n, r in enumerate(root):
        least[r] = min([least[r], rows[n][0]] if r in least else [rows[n][0]])
    return sorted(((i, len(links.get(n, ())), least[root[n]], i == least[root[n]]) for n, (i, _, _) in enumerate(rows)), key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    rows = [(k, (base[k % 12] + 0.05 * rng.normal(size=16)).tolist(), k % 12 % 2) for k in range(240)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, rows[0][1], None), (305, [1.0, 2.0], 0), (306, [], 0), (307, [None, 1.0], 0), rows[5]]
    assert embeddings(spark, rows) == linked(rows)
    assert embeddings(spark, []) == []


def test_embeddings_of_many_lengths_and_sizes(spark):
    """80 lengths of one linked pair each, and vectors whose squares are beyond double precision."""
    rng = np.random.default_rng(1)
    rows = []
    for n in range(2, 82):
        v = rng.normal(size=n)
        rows += [(2 * n, v.tolist(), 1), (2 * n + 1, (v * 3).tolist(), 1)]
    v = rng.normal(size=30)
    rows += [(1000, (v * 1e200).tolist(), 1), (1001, (v * 1e-200).tolist(), 1), (1002, (-v * 1e200).tolist(), 1), (1003, (v * 1e300).tolist(), 1), (1004, v.tolist() * 500, 1)]
    assert embeddings(spark, rows) == linked(rows)


def test_embeddings_with_pivots(spark, monkeypatch):
    """Enough vectors for pivots, from the table or, beyond the bound on them, made from the length; recall of 0.9 or more, no false link, components of found links."""
    rng = np.random.default_rng(2)
    rows: list = []
    for k in range(1600):
        v = rng.normal(size=24) if k % 4 == 0 else np.array(rows[k - k % 4][1]) + 0.2 * rng.normal(size=24)
        rows.append((k, v.tolist(), k // 4 % 2))
    true = linked(rows)
    for room in (embed_neardup.PIVOT_BYTES, 0):
        monkeypatch.setattr(embed_neardup, "PIVOT_BYTES", room)
        got = embeddings(spark, rows)
        assert all(a[1] <= b[1] for a, b in zip(got, true, strict=True))
        assert sum(a[1] for a in got) >= 0.9 * sum(b[1] for b in true)


def test_language(spark, none):
    rng = random.Random(5)
    say = {"aa": lambda: words(rng, 30), "bb": lambda: " ".join("".join(rng.choices("pqrstuvw", k=5)) for _ in range(30))}
    rows = [(k, say[lang](), lang, "s", 1) for k in range(200) for lang in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame([*rows, (900, None, "aa", "s", 1), (901, "123 !", "aa", "s", 1)], DOCS)
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    assert all(got[k].lang_pred == lang and got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, lang, _, _ in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert langid.identify(none, langid.train(none)).count() == 0
    assert langid.keep_identified(df, 0.4).count() == 200


def test_languages_beyond_counts_and_planes(spark):
    """More languages than any list of the largest would hold, and letters beyond the second plane."""
    rows = [(k, f"{chr(0x4E00 + k % 700) * 5} {chr(0x4E00 + k % 700) * 3}", f"l{k % 700}", "s", 1) for k in range(1400)]
    rows += [(5000, chr(0x30001) * 4, "zz", "s", 1), (5001, chr(0x30001) * 4, "zz", "s", 1)]
    df = spark.createDataFrame([*rows, rows[0]], DOCS)
    model = langid.train(df)
    assert len(model.langs) > 500 and model.bits < 16
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert got[5000] != "und"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def test_toxicity_automaton():
    lexicon = toxicity.Lexicon([("idiot", False), ("scum", False), ("loweirn", True)])
    term = {t: k for k, (t, _) in enumerate(lexicon.terms)}
    for said, (of, edits) in {"idiot": ("idiot", 0), "idot": ("idiot", 1), "idiiot": ("idiot", 1), "ibiot": ("idiot", 1), "idio": ("idiot", 1), "idiots": ("idiot", 1), "odoit": (None, 0), "scum": ("scum", 0), "scam": (None, 0), "loweirnen": ("loweirn", 0), "loveirnen": ("loweirn", 1), "x": (None, 0), chr(0x10FFFF): (None, 0)}.items():
        points = toxicity.points_of(said)
        assert [0 if of is None else 1 + 2 * term[of] + edits] == lexicon.read(points, np.array([0]), np.array([len(points)])).tolist(), said


def test_toxicity_automaton_against_brute_force():
    """Whole words of a lexicon of 900, cut into several tries, by edit distance."""
    rng = random.Random(4)
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(4, 8))) for _ in range(900)})
    lexicon = toxicity.Lexicon([(t, False) for t in terms], 200)
    assert len(lexicon.parts) > 2
    for _ in range(400):
        said = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        mark = int(lexicon.read(toxicity.points_of(said), np.array([0]), np.array([len(said)]))[0])
        close = [t for t in terms if len(t) >= toxicity.EDIT_WORD and one_edit(said, t)]
        if said in terms:
            assert mark % 2 and lexicon.terms[(mark - 1) // 2][0] == said
        else:
            assert (mark > 0) == bool(close) and (not mark or lexicon.terms[(mark - 1) // 2][0] in close)


def test_toxicity_quotes():
    points = toxicity.points_of('a "b c" d “e f” g')
    starts, _ = toxicity.words_of(points)
    assert toxicity.quoted(points, starts).tolist() == [False, True, True, False, True, True, False]


def test_toxicity(spark, none):
    rng = random.Random(8)
    slurs = ["".join(rng.choices("klmnopqrst", k=7)) for _ in range(360)]  # more terms than any list of the most frequent would hold
    rows, labels = [], []
    for k in range(28_800):
        toxic = k % 8 == 0
        w = words(rng, 12).split()
        if toxic:
            w[rng.randrange(12)] = slurs[k // 8 % 360]
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(toxic)))
    df, known = spark.createDataFrame([*rows, rows[0], (None, "x", None, None, 1), (9900, None, None, None, 1), (9901, "", None, None, 1)], DOCS), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, known)
    assert len(model.lexicon.terms) > 300
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert sum(got[k].predicted == v for k, v in labels) >= 28_500 and got[9900].predicted == got[9901].predicted == 0
    assert toxicity.score(none, toxicity.train(none, known)).count() == 0


def test_toxicity_windows_tell_quotes_from_abuse(spark):
    """A word that quotations hold without being abuse, and abuse as such."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(1200):
        w = words(rng, 30).split()
        if k % 4 == 0:
            w[3] = w[9] = "zonkers"
        elif k % 40 == 1:
            w[5] = '"zonkers"'
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(k % 4 == 0)))
    df, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, toxicity.train(df, known)).collect()}
    assert sum(got[k] == v for k, v in labels) >= 1190


def patterns(text):
    """The contract's patterns, one after the other, plainly."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        out += [(m.start(), 2, m.end())] if 14 <= len(digits) <= 19 and doubled % 10 == 0 else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_patterns():
    rng = random.Random(2)
    for k in range(9000):
        letters = ("a1@.+- (9-x%4", "0123456789.", "4111 -0", "+1 ().-23456789")[k % 4]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii_crf.base_spans(text) == patterns(text), text


def test_pii(spark, docs, none):
    said = {1: "a@b.cd 4111111111111111 10.1.2.3 and +1 (456) 555-2186", 2: None, 3: "", 4: "no data", 5: "é 4111 1111 1111 1111, 7 " * 300}
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in [*said.items(), (1, said[1])]], "doc_id long, text string, spans string, n_chars int")
    field = pii_crf.train(df)
    for r in pii_crf.find(df, field).collect():
        base = patterns(said[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        written = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and set(written.split(",")) <= set(r.spans.split(","))
    assert pii_crf.find(docs, field).count() == docs.count() and pii_crf.find(none, field).count() == 0
    assert pii_crf.redacted("a@b.cd 4111111111111111", pii_crf.base_spans("a@b.cd 4111111111111111")) == "[email] [card]"


def test_pii_field():
    """Repeated entities teach the skip edges; without them nothing is added."""
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        phone = "+1 (" + "".join(rng.choices("123456789", k=3)) + ") 555-" + "".join(rng.choices("0123456789", k=4))
        parts = [phone, phone, *(str(rng.randint(1, 10 ** rng.randint(1, 8))) for _ in range(rng.randint(0, 4)))]
        rng.shuffle(parts)
        texts.append(" ".join(f"{words(rng, 2)} {p}" for p in parts))
    field = pii_crf.Field()
    rows = [(t, pii_crf.nodes(t, pii_crf.base_spans(t))) for t in texts]
    field.fit([([t[a:b] for a, b, _ in n], [k for *_, k in n]) for t, n in rows])
    assert field.skip[pii_crf.SAME] > 1
    one = "ring +1 (456) 555-2186 or 1-456-555-2186 today"
    found = pii_crf.nodes(one, pii_crf.base_spans(one))
    said, labels = [one[a:b] for a, b, _ in found], [k for *_, k in found]
    tied = field.beliefs(said, labels)[1]
    field.skip[:] = 0
    alone = field.beliefs(said, labels)[1]
    assert tied.argmax() == 4 and tied[4] > alone[4] + 0.2 and alone[4] < pii_crf.BELIEF
    assert field.spans(one) == (pii_crf.base_spans(one),) * 2
    field.skip[:] = 9
    assert [one[a:b] for a, _, b in field.spans(one)[1]] == ["+1 (456) 555-2186", "1-456-555-2186"]


def test_pii_beliefs_are_exact_on_trees():
    """Message passing against enumeration of all labellings of a document whose graph has no loop."""
    field, rng = pii_crf.Field(), np.random.default_rng(5)
    field.unary, field.chain, field.skip = rng.normal(size=field.unary.shape), rng.normal(size=field.chain.shape), np.array([2.0, 0.7])
    said, labels = ["a@b.cd", "17", "+1 555 2", "x9"], [1, 0, 0, 0]
    assert pii_crf.skip_edges(said) == []
    own = np.array([pii_crf.shape(s) for s in said]) @ field.unary
    total = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        if y[0] == 1:
            p = np.exp(sum(own[k, v] for k, v in enumerate(y) if k) + sum(field.chain[a, b] for a, b in itertools.pairwise(y)))
            total[np.arange(4), y] += p
    assert np.allclose(field.beliefs(said, labels), total / total.sum(1, keepdims=True), atol=1e-3)
    pair = ["17", "17"]  # a chain and a skip edge between two nodes are a loop in name only: their potentials add up
    own = np.array([pii_crf.shape(s) for s in pair]) @ field.unary
    joint = np.exp(own[0][:, None] + own[1][None, :] + field.chain + field.agreement(pii_crf.SAME))
    assert np.abs(field.beliefs(pair, [0, 0])[0] - joint.sum(1) / joint.sum()).max() < 0.2


def test_rollup(spark, docs, none):
    rollup = token_rollup.Rollup(spark)
    assert rollup.totals().count() == 0
    empty = F.lit(None).cast("struct<source: string, lang: string, tokenizer: string, tokens: bigint>")
    inserts = docs.select(empty.alias("before"), token_rollup.image("v1", F.length("text")).alias("after"))
    for _ in range(2):
        rollup.commit("a", inserts)
    again = token_rollup.Rollup(spark, rollup.path)  # as after a restart
    assert again.totals().agg(F.sum("documents")).first()[0] == docs.count()
    again.write(inserts)  # interrupted before the log names it
    assert again.totals().agg(F.sum("documents")).first()[0] == docs.count()
    again.commit("b", docs.select(token_rollup.image("v1", F.length("text")).alias("before"), empty.alias("after")))
    assert rollup.totals().count() == 0
    rollup.commit("b", inserts.limit(0))
    assert again.totals().agg(F.sum("documents")).first()[0] == docs.count()
    assert token_rollup.maintained(none, TOKENIZER, BYTES).count() == 0


def test_token_counts(spark, docs, texts):
    """Against counting every text that no smaller id has with the library."""
    encoding, first, true = token_rollup.encoding(BYTES), {}, {}
    for k, t in texts:
        first[t or ""] = min(k, first.get(t or "", k))
    for r in docs.collect():
        if r.doc_id == first[r.text or ""]:
            n, total = true.get((r.source, r.lang), (0, 0))
            true[r.source, r.lang] = n + 1, total + len(encoding.encode_ordinary(r.text or ""))
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in token_rollup.maintained(docs.withColumn("key", F.lit(1)), TOKENIZER, BYTES).collect()}
    assert got == true


def test_long_white_space_is_counted_whole(spark, monkeypatch):
    bytes_ = token_rollup.encoding(BYTES)
    rng = random.Random(6)
    texts = ["", " ", "\n" * 30] + ["".join(rng.choice([" " * rng.randint(1, 9), "\n \t" * rng.randint(1, 4), "\x1c\x1f", "\u00a0\u2003" * 4, "word", "12", "!?", "'s", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    monkeypatch.setattr(token_rollup, "LONG_SPACE", re.compile(token_rollup.LONG_SPACE.pattern.replace("4096", "3")))
    assert [token_rollup.token_count(bytes_, t) for t in texts] == [len(bytes_.encode_ordinary(t)) for t in texts]
    monkeypatch.undo()
    long = [" " * 1_000_000, "\n" * 1_000_000, "a" + " \n\t" * 400_000 + "b", "x " + " " * 1_500_000 + "'s y" + "\n" * 10_000]
    table = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(long)], "doc_id long, text string, source string, lang string")
    got = {r.tokenizer: r.tokens for r in token_rollup.maintained(table, TOKENIZER, BYTES).collect()}
    plain = [len(bytes_._encode_single_piece(t)) for t in long[:2]]
    assert got["bytes-2"] == sum(token_rollup.token_count(bytes_, t) for t in long) and [token_rollup.token_count(bytes_, t) for t in long[:2]] == plain


def test_commits_at_once_get_their_own_numbers(spark):
    import threading

    rollup = token_rollup.Rollup(spark)
    empty = F.lit(None).cast("struct<source: string, lang: string, tokenizer: string, tokens: bigint>")
    changes = spark.range(10).select(empty.alias("before"), F.struct(F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit("v").alias("tokenizer"), F.col("id").alias("tokens")).alias("after"))
    threads = [threading.Thread(target=rollup.commit, args=(f"b{k}", changes)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.number for r in rollup._log().collect()) == [0, 1, 2, 3]
    assert [(r.documents, r.tokens) for r in rollup.totals().collect()] == [(40, 180)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_small_side_beyond_the_bound_is_never_broadcast(spark, how):
    """Spark takes salted rows for one of their copies; a table that its files hold in less than the threshold was sent out in 32."""
    big = spark.range(400).select((F.col("id") % 7).alias("key"), "id").withColumn("key", F.when(F.col("id") > 50, F.col("key")))
    small = materialise(spark.range(5).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value")), "small")
    within, beyond = (join_small(big, small, ["key"], how, rows=n) for n in (5, 4))
    assert Counter(map(tuple, beyond.collect())) == Counter(map(tuple, within.collect())) != Counter()
    assert "Broadcast" in within._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in beyond._jdf.queryExecution().executedPlan().toString()


def test_texts_counted_twice_are_joined_without_a_broadcast(spark, docs, monkeypatch):
    """Token counts beyond the bound: the same totals, and the table of repeated texts is merged."""
    totals, joined = token_rollup.maintained(docs, TOKENIZER, BYTES).collect(), []
    monkeypatch.setattr(token_rollup, "join_small", lambda *a: joined.append(join_small(*a, rows=0)) or joined[-1])
    assert Counter(map(tuple, token_rollup.maintained(docs, TOKENIZER, BYTES).collect())) == Counter(map(tuple, totals)) != Counter()
    assert joined and all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df in joined)
