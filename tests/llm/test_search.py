"""Lexical search, hard negatives and quality against plain computations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from airq.llm import lexical, negatives, quality

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item long, score double, terms string"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k):
    """The definition, document by document."""
    held = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for (doc, c), size in zip(held, sizes, strict=True):
            total = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * n // length))) for t in set(TERM.findall(fold(text))) if t in c)
            if total > 0:
                scores.append((-total, doc is None, doc or 0, doc))
        out += [(item, place + 1, doc, -s) for place, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["Word%d" % k for k in range(60)] + ["ÉTÉ", "été", "x_y", "naïve", "a1"]
    weights = [1 / (1 + k) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for k in range(300)]
    docs += [(300, None), (301, ""), (302, "  \n"), (None, docs[3][1]), (None, "word0 a1"), docs[5], docs[5], (5, "WORD7 word7!"), (303, "word1 " * 300_000 + "naïve"), (-4, docs[9][1])]
    items = [(0, "word3 WORD3, word9 naïve"), (1, None), (2, "..."), (3, "word0 word1 word2 word3 word4 word5 word6"), (3, "a1"), (None, "ÉTÉ été"), (9, "nowhere"), (10, "word0")]
    return docs, items


def test_search(spark, corpus):
    docs, items = corpus
    table = spark.createDataFrame([(*d, 1, 0.5, "t") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k, most, postings in ((7, 500_000, 1 << 20), (7, 4, 64), (50, 6, 1000)):
        found = lexical.search(table, asked, k, most, postings).collect()
        assert order([tuple(r) for r in found]) == order(ranked(docs, items, k))


def test_search_of_nothing(spark, corpus):
    docs, items = corpus
    table, asked = spark.createDataFrame([(*d, 1, 0.5, "t") for d in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")
    for d, i in ((table.where("false"), asked), (table, asked.where("false")), (table.where("text is null"), asked)):
        found = lexical.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.isEmpty()


def lists(rng, documents, terms, alike):
    """Impacts at random, or in orders that are alike in all lists."""
    sizes = rng.integers(1, terms, documents) if not alike else np.full(documents, terms)
    held = np.concatenate([np.sort(rng.choice(terms, s, replace=False)) for s in sizes])
    impacts = np.repeat(np.arange(documents), sizes) + rng.integers(1, 60, len(held)) if alike else rng.integers(1, 12, len(held))
    return lexical.Index(rng.permutation(documents), sizes, held, impacts, terms)


def test_best_positions_stop_no_later_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(lexical, "STEP", 2)
    rng = np.random.default_rng(2)
    earlier = 0
    for k in range(200):
        index = lists(rng, 400, 6, k % 2)
        wanted = np.sort(rng.choice(6, rng.integers(1, 6), replace=False))
        depths, results = [], []
        for tight in (True, False):
            best = lexical.Best(5)
            depths.append(index.search(wanted, best, tight))
            results.append((best.scores.tolist(), best.ids.tolist()))
        totals = Counter()
        for doc, first, size in zip(index.ids, index.first, index.sizes, strict=True):
            totals[int(doc)] = sum(int(v) for t, v in zip(index.held[first : first + size], index.impacts[first : first + size], strict=True) if t in wanted)
        plain = sorted((-s, d) for d, s in totals.items() if s > 0)[:5]
        assert results[0] == results[1] == ([-s for s, _ in plain], [d for _, d in plain])
        assert depths[0] <= depths[1] and not index.seen.any() and not index.met.any() and not index.asked.any()
        earlier += depths[0] < depths[1]
    assert earlier > 0  # direct accesses move best positions beyond what was read in order


def test_an_equal_threshold_does_not_stop():
    """All documents have the same score: the smallest ids win, wherever the lists have them."""
    n = 500
    index = lexical.Index(np.arange(n)[::-1].copy(), np.ones(n, int), np.zeros(n, int), np.full(n, 3), 1)
    best = lexical.Best(4)
    assert index.search(np.array([0]), best) >= n and best.ids.tolist() == [0, 1, 2, 3]


def test_long_texts_in_pieces(monkeypatch):
    text = ("Ab, c_d éÉ" * 50).encode()
    whole = [t for part in lexical.terms(text) for t in part]
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert [t for part in lexical.terms(text) for t in part] == whole == [t.encode() for t in TERM.findall(fold(text.decode()))]


def usable(row):
    return row[1] is not None and row[2] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def mined(rows, every=10, positives=5, negatives_=5):
    """The definition, pair by pair, in whole numbers of any size."""
    held = []
    for k, (vec, x, label) in enumerate(r for r in rows if usable(r)):
        whole = [math.floor(256 * v) if abs(v) < 1e15 else 256 * int(v) for v in x]
        held.append((k, vec, (label + 1) % 10 if vec is not None and vec % 7 == 0 else label, whole))

    def score(a, b):
        return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a[3], b[3], strict=True))))

    key = lambda p: (-p[0], p[1][1] is None, p[1][1] or 0, p[1][0])
    out = []
    for a in held:
        if a[1] is None or a[1] % every:
            continue
        scored = [(score(a, b), b) for b in held if b is not a and len(b[3]) == len(a[3])]
        for ps, p in sorted([s for s in scored if s[1][2] == a[2]], key=key)[:positives]:
            hard = [s for s in scored if s[1][2] != a[2] and 80 * ps <= 100 * s[0] <= 100 * ps]
            out += [(a[1], p[1], rank + 1, b[1], ps, s) for rank, (s, b) in enumerate(sorted(hard, key=key)[:negatives_])]
    return out


VECTORS = "vec_id long, embedding array<double>, label int, row string, place int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[rng.integers(6)] + 0.4 * rng.normal(size=8)).round(2).tolist(), int(rng.integers(3))) for k in range(500)]
    rows += [(500 + k, rng.normal(size=3).tolist(), 1) for k in range(30)]  # another length
    rows += [(600, None, 1), (610, [1.0] * 8, None), (620, [float("nan")] + [1.0] * 7, 1), (630, [None] + [1.0] * 7, 1), (640, [float("inf")] * 8, 2), (650, [0.0] * 8, 1), (660, [], 1), (670, [], 1), (680, [], 2)]
    rows += [rows[10], rows[10], (10, rows[11][1], 2), (None, rows[20][1], rows[20][2]), (None, rows[21][1], 0)] + [(700 + k, rows[30][1], k % 3) for k in range(20)]  # ties
    return rows


def test_hard_negatives(spark, vectors):
    table = spark.createDataFrame([(*r, "r", 1) for r in vectors], VECTORS).repartition(4)
    plain = order(mined(vectors))
    assert len(plain) > 300
    for tree, size in ((1024, 32 << 20), (4, 3000)):
        found = negatives.mine(table, every=10, tree=tree, round_bytes=size).collect()
        assert order([tuple(r) for r in found]) == plain
    assert negatives.mine(table.where("false")).isEmpty() and negatives.mine(table.where("vec_id % 100 <> 0")).isEmpty()


def test_very_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=3) * 10.0 ** rng.choice([0, 5, 7, 9, 200])).tolist(), int(rng.integers(2))) for k in range(150)]
    rows += [(1000, [1e308, -1e308, 1e308], 0), (1001, [1e308, -1e308, 1e308], 1)]
    found = negatives.mine(spark.createDataFrame([(*r, "r", 1) for r in rows], VECTORS), every=10)
    assert order([tuple(r) for r in found.collect()]) == order(mined(rows))


def test_bounds_hold_and_save_work():
    """Along the tree only some rows are scored, and none that matters is missed."""
    rng = np.random.default_rng(6)
    points = np.repeat(rng.normal(size=(5, 16)), 20, axis=0) + 0.02 * rng.normal(size=(100, 16))
    order_, parents, edges = negatives.spanning_tree(negatives.scale(points))
    assert parents[0] == -1 and all(0 <= p < k for k, p in enumerate(parents) if k)
    rows = [{"label": 0, "embedding": points[k].tolist(), "row": k, "parent": int(p), "edge": e} for k, p, e in zip(order_, parents, edges, strict=True)]
    tree = negatives.Tree(rows, {k: k for k in range(100)})
    batch = negatives.Rows(rng.normal(size=(400, 16)))
    exact = batch.scaled @ negatives.scale(points).T
    scored, at = 0, 150_000
    for number, chosen, scores in tree.walk(batch, lambda n, low, high: high >= at):
        assert (scores == exact[chosen, number]).all()
        assert set(np.flatnonzero(exact[:, number] >= at)) <= set(chosen.tolist())
        scored += len(chosen)
    assert scored < 0.5 * 400 * 100


def prose(rng):
    return ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(400)]


def good_line(rng, words):
    return " ".join(rng.choices(words, k=rng.randint(8, 40))).capitalize() + "."


def bad_line(rng, words, kind):
    some = rng.choices(words, k=rng.randint(8, 30))
    return " | ".join(some) if kind == 0 else " ".join(w.upper() + "!!" for w in some) if kind == 1 else " ".join([some[0]] * 30)


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(9)
    words = prose(rng)
    rows = []
    for k in range(900):
        bad = k % 4 == 0
        lines = [good_line(rng, words) for _ in range(rng.randint(1, 6))]
        if bad:
            kind = rng.randrange(3)
            lines = lines[: rng.randint(0, 1)] + [bad_line(rng, words, kind) for _ in range(rng.randint(2, 6))]
        rows.append((k, "\n".join(lines), int(not bad)))
    return rows


def test_quality(spark, judged):
    odd = [(5000, None), (5001, ""), (5002, "\n\n"), (None, judged[1][1]), (5003, "\n".join([bad_line(random.Random(1), prose(random.Random(9)), 1)] * 20_000)), (5004, "\n".join(["A line of words."] * 30_000)), (1, judged[1][1])]
    docs = spark.createDataFrame([(k, t, 1.5) for k, t, _ in judged] + [(*o, 1.5) for o in odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, q) for k, _, q in judged] + [(k, None) for k in (1, 2)] + [(5001, 7), (None, 0)], "doc_id long, quality int")
    found = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(found) == len(judged) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    held = [(k, q) for k, _, q in judged if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k, _ in held) and sum(r.held_out for r in found if r.doc_id is not None and r.doc_id < 900) >= len(held) and len(held) > 100
    assert sum(got[k].predicted == q for k, q in held) >= 0.97 * len(held)
    assert len({round(r.score, 12) for r in found if r.doc_id in (None, 1)}) == 1 and got[5003].predicted == 0
    nothing = quality.train(docs, labels.where("quality = 1"))
    assert nothing is None and {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.where("false"), None).isEmpty()


def test_a_bad_line_in_a_good_text(spark, judged):
    """Marginals tell lines apart, which no label ever did, and lines' lengths weigh them."""
    model = quality.train(spark.createDataFrame([(k, t) for k, t, _ in judged], "doc_id long, text string"), spark.createDataFrame([(k, q) for k, _, q in judged], "doc_id long, quality int"))
    rng = random.Random(10)
    words = prose(rng)
    lines = [good_line(rng, words) for _ in range(4)] + [bad_line(rng, words, 1) for _ in range(3)]
    rows, sizes = quality.features("\n".join(lines))
    p = model.marginals(rows)
    assert (p[:4] > 0.5).all() and (p[4:] < 0.5).all()
    assert math.isclose(model.raw(rows, sizes), sum(a * len(x) for a, x in zip(p, lines, strict=True)) / sum(map(len, lines)))


def test_messages_are_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        unary, step, ends = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        lines, steps, total = np.zeros((n, 2)), np.zeros((max(n - 1, 0), 2, 2)), 0.0
        for mask in range(2**n):
            y = [mask >> k & 1 for k in range(n)]
            p = math.exp(ends[y[0]] + sum(unary[k, y[k]] for k in range(n)) + sum(step[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            for k in range(n):
                lines[k, y[k]] += p
            for k in range(n - 1):
                steps[k, y[k], y[k + 1]] += p
        marginals, joint, log_total = quality.messages(unary, step, ends)
        assert np.allclose(marginals, lines / total) and np.allclose(joint, steps / total) and math.isclose(log_total, math.log(total))


def test_the_fit_follows_the_likelihood():
    """What many texts at once give is what each gives alone, and the steps raise the likelihood."""
    rng = np.random.default_rng(12)
    model = quality.Model(np.tile(np.arange(1, quality.BINS) / quality.BINS, (len(quality.FEATURES), 1)))
    rows = [rng.random((n, len(quality.FEATURES)), dtype=np.float32) for n in (3, 1, 7, 2, 5)]
    active = [quality.expand(model.bins(r)) for r in rows]
    said = [(r[:, 0] > 0.5).astype(float) for r in rows]
    model.weights, model.step, model.ends = rng.normal(size=len(model.weights)) * 0.1, rng.normal(size=(2, 2)), rng.normal(size=2)
    flat = np.vstack(active)
    first = np.cumsum([0, *map(len, active)])[:-1]
    by_length = sorted(range(5), key=lambda k: -len(active[k]))
    marginals, joint = model._together(flat, first[by_length], np.array([len(active[k]) for k in by_length]))
    alone = [quality.messages(model.unary(a), model.step, model.ends) for a in active]
    assert np.allclose(marginals, np.vstack([m for m, _, _ in alone])) and np.allclose(joint, sum(j.sum(axis=0) for _, j, _ in alone))

    def likelihood():
        out = 0.0
        for a, y in zip(active, said, strict=True):
            unary, (_, _, total) = model.unary(a), quality.messages(model.unary(a), model.step, model.ends)
            y = y.astype(int)
            out += model.ends[y[0]] + unary[np.arange(len(y)), y].sum() + model.step[y[:-1], y[1:]].sum() - total
        return out

    before = likelihood()
    model.fit(active, said)
    assert likelihood() > before and likelihood() > -1


def test_features_of_pieces(monkeypatch):
    text = "Some LINE, 12!\n\n" + "abc | déf " * 40
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PIECE", 11)
    assert all(np.allclose(a, b) for a, b in zip(whole, quality.features(text), strict=True)) and len(whole[0]) == 3


def test_scores_by_label_only(spark):
    """Equal texts score alike whatever else their rows say."""
    groups = defaultdict(set)
    docs = spark.createDataFrame([(k, f"text {k % 3}\n" * 3) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(30)], "doc_id long, quality int")
    for r in quality.score(docs, quality.train(docs, labels)).collect():
        groups[r.doc_id % 3].add(r.score)
    assert all(len(v) == 1 for v in groups.values())
