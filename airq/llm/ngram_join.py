"""All documents whose sets of word shingles have a Jaccard similarity of at least a threshold: a token-group matrix join.

1. Every text becomes its set of hashed shingles; equal sets are one set from here on. Shingles that only one
   set has are counted but not carried: of a set that can have a partner, at least 80 % are held by others too.
2. Such sets are dealt into groups of similar ones: sets with a minimum hash in common are compared with the
   one of them whose tokens most sets hold, and those linked, directly or by way of others, form a group.
3. The matrix of tokens and parts: sets of one minimum hash, cut where they hold many tokens, are a part, which
   keeps the union of its tokens. By the prefix rule, partners share one of their rarest tokens; for each part
   found so that holds sets of another group, the overlap of a set with the part's union bounds its overlap with
   every member, and only where the bound reaches what the threshold asks is the part opened and those compared.

Sets within one group are connected already, so no pairs are made there; between groups no link is lost.

Null and empty texts have no shingles and link with nothing; repeated rows are equal sets; a null id can belong
to a component but never names it unless no other can. Texts of any length are read whole. An empty table gives no rows.
``components`` ignores other columns, ``keep_one`` keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_row, join_small, materialise, partitions, row_hash, tidy
from .graph import connected_components
from .shingles import WORDS, set_hash, shingle_sets

#: Similarity asked for, in hundredths.
PERCENT = 80
#: Rows that are read at once, and how many sets of them may have a shingle before it is summed up there and then shuffled.
ROWS_AT_ONCE, HOT = 1000, 32
#: Tokens of a group's part, about.
GROUP_TOKENS = 8_000
#: Bytes of text for each partition of tokens, which a task sorts in memory.
PARTITION_BYTES = 8 << 20
#: Sets that meet one part in one task.
OPENED = 64
#: Keys of rows to drop that may be broadcast; with more of them, bitmaps of this many times ``MAP_BITS`` bits (8 MB) tell which rows may be concerned.
DROPPED_ROWS, MAPS, MAP_BITS = 200_000, 2048, 1 << 15
#: Minimum hashes by which sets are brought together.
ROUNDS = 4

PAIR, HOT_PAIR, HOT_SUM, DOCUMENT = range(4)
ROWS = "kind int, id long, token long, n long"


def _rows(kind: int, ids: np.ndarray, tokens: np.ndarray, n: np.ndarray, mask: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids, pa.int64(), mask=mask), pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], names=["kind", "id", "token", "n"]
    )


def _shingled(words: int):
    """Rows of a batch: its documents, and each distinct set's tokens, those of very common tokens apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids, sets, sizes, new_ids, new_sets = batch.column(0), [], [], [], []
                for shingles in shingle_sets([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], words):
                    key = set_hash(shingles)
                    sets.append(key)
                    sizes.append(len(shingles))
                    if len(shingles) and key not in seen:
                        seen.add(key)
                        new_ids.append(key)
                        new_sets.append(shingles)
                known = ids.is_null().to_numpy(zero_copy_only=False)
                yield _rows(DOCUMENT, ids.fill_null(0).to_numpy(), np.array(sets, np.int64), np.array(sizes, np.int64), known)
                if not new_sets:
                    continue
                tokens = np.concatenate(new_sets).view(np.int64)
                owners = np.repeat(np.array(new_ids, np.int64), list(map(len, new_sets)))
                found, counts = np.unique(tokens, return_counts=True)
                hot, summed = found[counts > HOT], counts[counts > HOT]
                apart = np.isin(tokens, hot) if len(hot) else np.zeros(len(tokens), bool)
                yield _rows(PAIR, owners[~apart], tokens[~apart], np.ones((~apart).sum(), np.int64))
                yield _rows(HOT_PAIR, owners[apart], tokens[apart], np.zeros(apart.sum(), np.int64))
                yield _rows(HOT_SUM, np.zeros(len(hot), np.int64), hot, summed)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's tokens those that several sets have, with how many; other rows pass."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        passing = (kind == DOCUMENT) | (kind == HOT_PAIR)
        if passing.any():
            yield batch.filter(pa.array(passing))
        rest = batch.filter(pa.array(~passing))
        ids, tokens, n = (rest.column(c).to_numpy() for c in ("id", "token", "n"))
        kept.append((np.where(rest.column("kind").to_numpy() == HOT_SUM, 0, ids), tokens, n * np.where(rest.column("kind").to_numpy() == HOT_SUM, -1, 1)))
    if not kept:
        return
    ids, tokens, n = (np.concatenate(x) for x in zip(*kept, strict=True))
    kept.clear()
    order = np.argsort(tokens)
    ids, tokens, n = ids[order], tokens[order], n[order]
    if not len(tokens):
        return
    first = np.flatnonzero(np.diff(tokens, prepend=~tokens[0]))
    often = np.repeat(np.add.reduceat(np.abs(n), first) > 1, np.diff(np.append(first, len(tokens))))
    ids, tokens, n = ids[often], tokens[often], n[often]
    order = np.lexsort((ids, tokens))
    ids, tokens, n = ids[order], tokens[order], n[order]
    repeats = np.zeros(len(ids), bool)  # a set that several partitions had
    repeats[1:] = (n[1:] > 0) & (n[:-1] > 0) & (ids[1:] == ids[:-1]) & (tokens[1:] == tokens[:-1])
    ids, tokens, n = ids[~repeats], tokens[~repeats], n[~repeats]
    if not len(tokens):
        return
    first = np.flatnonzero(np.diff(tokens, prepend=~tokens[0]))
    sums = np.add.reduceat(np.abs(n), first)
    each = np.repeat(sums, np.diff(np.append(first, len(tokens))))
    pairs = (n > 0) & (each > 1)
    yield _rows(PAIR, ids[pairs], tokens[pairs], each[pairs])
    hot = np.add.reduceat((n < 0).astype(np.int64), first) > 0
    yield _rows(HOT_SUM, np.zeros(hot.sum(), np.int64), tokens[first][hot], sums[hot])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` of sets those at or over the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    both = both.withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def _groups(sets: DataFrame, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` that gather similar sets: each set with the most central one of the same minimum hash."""
    rounds = F.posexplode(F.expr(f"transform(sequence(0, {ROUNDS - 1}), k -> array_min(transform(tokens, t -> xxhash64(t, k))))")).alias("round", "key")
    keys = materialise(sets.select("id", "central", rounds), "keys")
    leaders = keys.groupBy("round", "key").agg(F.max(F.struct("central", "id"))["id"].alias("b"), F.count("*").alias("many")).where("many > 1").drop("many")
    pairs = keys.join(leaders, ["round", "key"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    return materialise(_linked(pairs, sets, percent), "gathered")


def _across(sets: DataFrame, gathered: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components of the sets gathered so far, found by way of the token-group matrix."""
    placed = sets.join(connected_components(gathered).withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.withColumn("alike", F.expr("array_min(transform(tokens, t -> xxhash64(t, 0)))"))
    held = placed.groupBy("alike").agg(F.ceil(F.sum(F.size("tokens")) / GROUP_TOKENS).alias("parts"))
    placed = placed.join(held, "alike").withColumn("part", F.xxhash64("alike", F.pmod(F.xxhash64("id"), F.col("parts"))))
    placed = materialise(placed.select("id", "n", "tokens", "component", "part"), "placed")

    # of two partners the larger has a common token among its 20 % rarest, the smaller among its 11 % rarest
    own = f"n - ({percent} * n + 99) div 100 + 1"
    short = f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1"
    prefixes = placed.select("id", "n", "component", "part", F.posexplode(F.expr(f"slice(tokens, 1, int(size(tokens) - n + {own}))")).alias("place", "token"), (F.expr(f"size(tokens) - n + {short}")).alias("short"))
    several = prefixes.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    prefixes = materialise(prefixes.join(several, "token"), "prefixes")
    index = prefixes.where("place < short").groupBy("token", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    queries = prefixes.select("token", "id", "component", "n")
    met = queries.join(index, "token").where(f"(low <> component OR high <> component) AND least <= n AND 100 * most >= {percent} * n")
    found = materialise(met.select("id", F.col("part").alias("other")).distinct(), "found")

    parts = placed.groupBy(F.col("part").alias("other")).agg(F.collect_list(F.struct("component", "n", "tokens")).alias("members"))
    parts = parts.withColumn("union", F.array_distinct(F.flatten("members.tokens")))
    # a part that many sets open is copied, so that none of its copies meets more than about OPENED of them
    loads = materialise(found.groupBy("other").agg(F.ceil(F.count("*") / OPENED).cast("int").alias("slots")), "loads")
    found = join_small(found, loads, ["other"]).withColumn("slot", F.pmod(F.xxhash64("id", F.lit("slot")), "slots").cast("int")).drop("slots")
    parts = parts.join(loads, "other").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    opened = found.join(placed.select("id", "n", "tokens", "component"), "id").join(parts, ["other", "slot"])
    opened = opened.where(f"size(array_intersect(tokens, union)) >= ({percent} * n + 99) div 100")
    similar = f"""filter(members, m -> m.component <> component AND 100 * least(n, m.n) >= {percent} * greatest(n, m.n)
        AND (100 + {percent}) * size(array_intersect(tokens, m.tokens)) >= {percent} * (n + m.n))"""
    linked = opened.select(F.col("component").alias("a"), F.expr(f"array_distinct(transform({similar}, m -> m.component))").alias("b")).where("size(b) > 0")
    return linked.select("a", F.explode("b").alias("b"))


def components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_shingles, component_id`` (the smallest id reachable by links), a row a row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_shingled(words)), ROWS)
    place = F.when(F.col("kind").isin(PAIR, HOT_SUM), F.col("token")).otherwise(F.xxhash64("id", "token"))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    rows = materialise(rows.repartition(max(partitions(spark), size // PARTITION_BYTES), place).mapInArrow(tidy(_shared), ROWS), "shared")
    documents = rows.where(F.col("kind") == DOCUMENT).select(F.col("id").alias("doc_id"), F.col("token").alias("id"), F.col("n"))

    hot = materialise(rows.where(F.col("kind") == HOT_SUM).select("token", F.col("n").alias("hot")), "hot")
    pairs = join_small(rows.where(F.col("kind").isin(PAIR, HOT_PAIR)).select("id", "token", "n"), hot, ["token"], "left")
    ordered = F.transform(F.array_sort(F.collect_set(F.struct(F.coalesce("hot", "n").alias("held"), "token"))), lambda x: x["token"])
    sizes = documents.groupBy("id").agg(F.max("n").alias("n"))
    central = F.sum(F.log(F.coalesce("hot", "n")))
    sets = pairs.groupBy("id").agg(ordered.alias("tokens"), central.alias("central")).join(sizes, "id").where(f"100 * size(tokens) >= {percent} * n")
    sets = materialise(sets.select("id", "n", (F.col("central") / F.col("n")).alias("central"), "tokens"), "sets")

    gathered = _groups(sets, percent)
    across = materialise(_across(sets, gathered, percent), "across")
    found = connected_components(gathered.union(across))

    least = documents.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    least = least.join(found.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = materialise(least, "least")
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(names, "component").select("id", "component_id")
    empty = documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return join_small(documents.where("n > 0"), materialise(named, "named"), ["id"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` less near duplicates: of each component the row of the smallest id stays.

    Rows are told apart by a hash of all their columns, not by id, so unlike texts of one id both stay; of rows that
    are equal throughout, one stays. Ids that are null come last. Rows without words all stay.
    """
    rows = as_row(docs, key=row_hash(docs))
    found = components(rows.select(F.col("key").alias("doc_id"), "row.text"), percent, words).where("n_shingles > 0")
    found = materialise(found.groupBy(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).agg(F.count("*").alias("many")), "found")
    shared = materialise(found.groupBy("component").agg(F.count("*").alias("texts")).where("texts > 1").select("component"), "shared")
    held = materialise(join_small(found, shared, ["component"]).select("key", "component"), "held")
    ids = join_small(rows.select("key", F.col("row.doc_id").alias("id")).distinct(), held, ["key"])
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key"))["key"].alias("first"))
    gone = held.join(first, "component").where("key <> first").select("key", F.lit(True).alias("gone"))
    again = found.groupBy("key").agg(F.sum("many").alias("many")).where("many > 1").select("key", F.lit(False).alias("gone"))
    marks = materialise(gone.unionByName(again).groupBy("key").agg(F.max("gone").alias("gone")), "marks")
    rest = None
    if marks.count() > DROPPED_ROWS:
        apart = _maybe(rows, marks)
        rest = apart.where("not maybe").select("row.*")
        rows = apart.where("maybe").select("row", "key", F.monotonically_increasing_id().alias("deal"))  # by which equal rows are salted
    marked = join_small(rows, marks, ["key"], "left", DROPPED_ROWS)
    kept = marked.where("gone is null").select("row.*")
    if not marks.where("not gone").isEmpty():
        kept = kept.unionByName(marked.where("not gone").groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
    return kept if rest is None else kept.unionByName(rest)


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` and whether their ``key``, a hash, may be one of ``keys``: bits in bitmaps of one size for any number of keys, so that only these rows need a shuffle."""
    place = F.pmod("key", F.lit(MAPS * MAP_BITS))
    map_, bit = F.shiftright(place, MAP_BITS.bit_length() - 1).alias("map"), place.bitwiseAND(MAP_BITS - 1).alias("bit")
    maps = keys.select(map_, bit).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))  # at most MAPS rows of 4 KB
    found = rows.select("*", map_, bit).join(F.broadcast(maps), "map", "left")
    maybe = F.expr("getbit(cast(conv(hex(substring(bits, int(bit div 8) + 1, 1)), 16, 10) as long), int(bit % 8)) = 1")
    return found.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("map", "bit", "bits")
