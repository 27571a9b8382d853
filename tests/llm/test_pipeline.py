"""The pipeline's stages on a table of hard cases, and the whole run against plain Python where that can say it."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from airq.llm import mixing, ngram_join, packing, pii_crf, pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, row int, key string, _size int, facts map<string, int>"
LETTERS = {"aa": "abcdefghij", "bb": "qrstuvwxyz"}


def say(rng, lang, n):
    return " ".join("".join(rng.choices(LETTERS[lang], k=4)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for k in range(160):
        lang = ("aa", "bb")[k % 2]
        out.append((k, say(rng, lang, rng.randint(20, 60)), lang, ("web", "book", None)[k % 3]))
    for k in range(20):  # near copies: one word in forty
        w = out[k][1].split()
        w[-1] = "changed"
        out.append((500 + k, " ".join(w), out[k][2], "web"))
    out += [out[3], out[3], (3, say(rng, "bb", 40), "bb", "book"), (None, out[5][1], "bb", None), (None, say(rng, "aa", 30), "aa", "web")]
    out += [(900, None, "aa", "web"), (901, "", "aa", "web"), (902, "12 34 !", None, "web"), (None, None, None, None), (903, say(rng, "aa", 20_000), None, "book")]
    out += [(910, say(rng, "aa", 15) + " jo@mail.example.com 4111111111111111 +1 (456) 555-2186 and 10.1.2.3", "aa", "web"), (911, say(rng, "bb", 25), "bb", None)]
    return [(*r, len(r[1] or ""), 0.5, k % 2, "k", 9, {"a": 1}) for k, r in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return Counter((r.doc_id, r.text, r.source, r.score, r.key) for r in df.collect())


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def one_of_each(rows):
    """The rows (id, text, rest) that stay, by brute force."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
    best = {}
    for r, s, row in zip(root, sets, rows, strict=True):
        if s:
            best[r] = min(best.get(r, (2,)), (row[0] is None, row[0] or 0))
    return best, root, sets


def test_language_id(spark, docs, none, rows):
    kept = pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    got = plain(kept)
    true = Counter((r[0], r[1], r[3], r[5], r[7]) for r in rows if re.search(r"[a-z]", r[1] or ""))
    assert got == true
    assert all(r.lang == ("aa" if set(r.text) & set("abcdefghij") - set("changed") else "bb") for r in kept.where("doc_id < 160").collect())
    assert pipeline.language_id(spark, none, "").count() == 0


def test_near_duplicates(spark, docs, none, rows):
    kept = pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    best, root, sets = one_of_each(rows)
    got = kept.collect()
    assert sum(not shingles(r.text) for r in got) == sum(not s for s in sets)  # rows without words all stay
    by_set = {}
    for r, s in zip(root, sets, strict=True):
        by_set[s] = r
    found = Counter(by_set[shingles(r.text)] for r in got if shingles(r.text))
    assert found == Counter(best.keys())  # one row of each component
    assert all((r.doc_id is None, r.doc_id or 0) == best[by_set[shingles(r.text)]] for r in got if shingles(r.text))
    assert sum(r.doc_id == 3 for r in got) == 2  # unlike texts of one id
    assert pipeline.near_duplicates(spark, none, "").count() == 0


def test_near_duplicates_of_one_id(spark):
    """Three rows of one id, two of them alike: two stay."""
    rng = random.Random(1)
    a, b = say(rng, "aa", 30), say(rng, "bb", 30)
    rows = [(1, a, 1), (1, b, 2), (1, b, 3), (2, a, 4), (None, b, 5)]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(r.text for r in got) == sorted([a, b]) and all(r.doc_id == 1 for r in got)


@pytest.mark.parametrize(("maps", "bits"), [(2048, 1 << 15), (1, 8)])
def test_near_duplicates_beyond_what_may_be_broadcast(spark, docs, monkeypatch, maps, bits):
    """Keys of rows to drop aren't sent out, only bitmaps of one size; with bits that many keys share the result is the same."""
    within = plain(ngram_join.keep_one(docs))
    for name, value in (("DROPPED_ROWS", 0), ("MAPS", maps), ("MAP_BITS", bits)):
        monkeypatch.setattr(ngram_join, name, value)
    kept = ngram_join.keep_one(docs)
    assert plain(kept) == within
    sent = [line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert sent and all("map#" in line for line in sent)


def test_personal_data(spark, docs, none, rows):
    done = pipeline.personal_data(spark, docs, "")
    assert done.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.n_chars, r.source) for r in done.collect())
    field = pii_crf.train(docs.select("text"))
    true = [(r[0], r[1] and pii_crf.redacted(r[1], field.spans(r[1])[1]), r[3]) for r in rows]
    assert got == Counter((k, t, None if t is None else len(t), s) for k, t, s in true)
    assert any("[email] [card] [phone] and [ip]" in (t or "") for _, t, _ in true)
    assert pipeline.personal_data(spark, none, "").count() == 0


def test_source_mix(spark, docs, none, rows):
    mixed = pipeline.source_mix(spark, docs, "")
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixing.copies(docs.select("doc_id", "text", "source")).join(docs.select("doc_id"), "doc_id", "left_semi").collect():
        if r["size"]:
            taken[r.doc_id, r["size"]] = r.taken // r["size"]
    got = Counter((r.doc_id, r.text) for r in mixed.collect())
    for (k, text), times in Counter((r[0], r[1]) for r in rows if r[0] is not None and r[1] and r[1].strip()).items():
        assert got[k, text] == times * taken[k, len(text.split())], k
    assert max(got.values()) <= 2 * max(Counter((r[0], r[1]) for r in rows).values())
    assert pipeline.source_mix(spark, none, "").count() == 0


def test_equal_hashes_are_taken_together(spark):
    rows = [(1, "one two three", "s")] * 9 + [(k, "four five six", "t") for k in range(2, 5)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 1").collect()
    assert len(got) == 9 and len({r.taken for r in got}) == 1


def test_sequences(spark, docs, none, rows):
    packed = pipeline.sequences(spark, docs, "").collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r[0] for r in rows)
    ends = {}
    for r in packed:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in ends.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(pieces[-1]) <= packing.SEQ_LEN
    assert pipeline.sequences(spark, none, "").count() == 0


def test_run(spark, docs, tmp_path):
    """The whole run is its stages one after the other, and reruns agree."""
    docs.drop("facts").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, pipeline.run(spark, str(tmp_path)).collect()))
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, step, "").collect()
        step = spark.createDataFrame(rows, step.schema)
    last = pipeline.STAGES[-1][1](spark, step, "").collect()
    pieces = lambda found: Counter((r[0], r[1], r[2], r[3], r[4]) for r in found)
    assert pieces(got.elements()) == pieces(map(tuple, last))
    assert step.where(F.col("text").contains("mail.example.com")).isEmpty()


def test_every_python_task_of_the_stages_gives_memory_back(spark, monkeypatch):
    from airq.llm import common, langid, ngram_join, pii_crf

    tidied, real = [], common.tidy
    for module in (langid, ngram_join, pii_crf):
        monkeypatch.setattr(module, "tidy", lambda run: tidied.append(1) or real(run))
    docs = spark.createDataFrame([(k, f"some words of a text number {k}", "en", "a") for k in range(40)], "doc_id long, text string, lang string, source string")
    ngram_join.components(docs)
    assert len(tidied) == 2
    pii_crf.redact(docs, pii_crf.train(docs.select("text")))
    assert len(tidied) == 4
    langid.keep_identified(docs, 0.4)
    assert len(tidied) == 7
