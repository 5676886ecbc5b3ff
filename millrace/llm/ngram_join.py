"""Exact Jaccard join of documents on their sets of five-word shingles, down to connected components.

Equal sets collapse first, so copies cost one set. Two sets with Jaccard of at least t share at least
k of their first n - ceil(t n) + k elements, whatever the common order. So, size-aware:

- Small sets, up to a boundary, enumerate the subsets of two of these first elements (k = 2), which
  hardly ever meet by chance.
- Large sets scan the inverted lists of single elements. Small sets that could link with a
  large one, as they have t times the boundary and more, are in these lists too.

The boundary is where the cost of the subsets, summed over the corpus's sizes, passes that of the
lists. The order puts shingles that many documents share last, so lists stay short unless their
documents are much alike. In each list the documents are first compared with a few of them, the same
few in all lists that hold them, which connects groups of near copies without their pairs; then only
pairs are compared that are still in different components: those of short lists one by one, those of
long lists in blocks of sets, whose overlaps are one product of matrices. Every pair of a list is
thereby linked, already connected, or refuted. Links are kept as forests, so they are not many more
than sets. Lists that a thousandth of all sets may share are known by their elements' counts and are
salted: no task sees such a list whole.

For a large set k grows with its size. Of two sets, the one whose first elements end sooner in the
order has at least its k of them in common with the other's. So a set with too few elements that it
shares with anyone leaves the lists, which shortens the others', and before the sets of a pair are
brought together its common list elements are counted: too few, and the lists alone refute it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bounded, drop, fresh, join_skewed, map_batches, texts, trim, written

#: How many list elements a set must share, in hundredths of its size: longer lists, but hardly a chance meeting survives.
SHARED = 8
#: Words of a shingle and the least Jaccard similarity in hundredths.
WORDS, PERCENT = 5, 75
#: A shingle that so many documents share is put late in the order. So many shingles are known as such, the most
#: frequent ones, at most; any choice gives the same links.
FREQUENT, MOST_FREQUENT = 8, 500_000
#: Shingles whose counts a task holds at a time, words whose hashes a worker remembers, digests that a task knows to be listed.
HELD, CACHE_ENTRIES, SEEN = 2_000_000, 200_000, 200_000
#: A list that may hold 1/HOT of all sets, and HOT sets at least, is cut into SALTS parts for whatever needs a list's sets together.
HOT, SALTS = 1000, 64
#: Ids that are broadcast when texts are looked up again; beyond this they are joined by shuffle.
FEW_IDS = 1_000_000
#: Lists up to SHORT are compared pair by pair. Of longer ones the documents are compared with HUBS of theirs
#: first, and what is left in blocks of BLOCK sets and BLOCK_ELEMENTS elements, COLUMNS elements at a time.
HUBS, SHORT, BLOCK, BLOCK_ELEMENTS, COLUMNS = 16, 48, 512, 1 << 18, 8192
#: Links and nodes that a task's forest holds at a time.
FOREST = 1_000_000
#: The largest boundary that is considered.
MOST_SMALL = 64

MULTIPLIER, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def shingles(text: str, hashes: Hashes) -> np.ndarray:
    """The set's 64-bit hashes, ascending. Fewer words than a shingle's make one element, none make no element."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=len(words))], dtype=np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - WORDS + 1
    h = codes[:n]
    for k in range(1, WORDS):
        h = h * MULTIPLIER + codes[k : k + n]
    return np.unique(mixed(h))


def digest(found: np.ndarray) -> bytes | None:
    return hashlib.md5(found.tobytes(), usedforsecurity=False).digest() if len(found) else None


def short(key: bytes | None) -> int | None:
    """A digest's first half: what the lists carry. Both halves are told apart before sets are compared."""
    return None if key is None else int.from_bytes(key[:8], "little", signed=True)


def first_elements(found: np.ndarray, count: int, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first elements in the common order, by rank (0 unless frequent), then by hash; and their ranks."""
    ranks = np.zeros(len(found), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        ranks = np.where(frequent[at] == found, rank[at], 0)
        if ranks.any():
            order = np.argsort(ranks, kind="stable")
            found, ranks = found[order], ranks[order]
    return found[:count], ranks[:count]


def least_shared(n: int) -> int:
    """k of a set in the lists."""
    return 1 + SHARED * n // 100


def keys(found: np.ndarray, boundary: int, frequent: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The subsets and list elements under which a set can meet the sets that it links with, and the least rank of each one's elements."""
    n = len(found)
    if n < 2:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # links with equal sets only
    single = np.uint64(1)  # the lowest bit tells elements from subsets
    slack = n - -(-percent * n // 100)
    shared = least_shared(n)
    first, ranks = first_elements(found, slack + max(2, shared), frequent, rank)
    out, least = [], []
    if n <= boundary:
        i, j = np.triu_indices(min(n, slack + 2), 1)
        low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        out.append(mixed(low * MULTIPLIER + mixed(high ^ MIX_1)) & ~single)
        least.append(np.minimum(ranks[i], ranks[j]))
    if 100 * n > percent * boundary:
        out.append(first[: slack + shared] | single)
        least.append(ranks[: slack + shared])
    return np.concatenate(out), np.concatenate(least)


def best_boundary(sizes: dict[int, int], shared: float, percent: int) -> int:
    """sizes: sets by size. shared: how many other sets a list's element is expected to bring, on average."""
    best, least = 1, math.inf
    for boundary in range(1, MOST_SMALL + 1):
        cost = 0.0
        for n, count in sizes.items():
            slack = n - -(-percent * n // 100)
            if n <= boundary:
                cost += count * (slack + 2) * (slack + 1) / 2 * (1 + shared * shared)
            if 100 * n > percent * boundary:
                cost += count * (slack + least_shared(n)) * (1 + shared)
        if cost < least:
            best, least = boundary, cost
    return best


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written: (id, n, digest) of each row, and (element, n) of elements that a task met in several different sets."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, digest binary, element bigint"
    arrow = arrow_schema(docs.sparkSession, schema)

    def table(ids, n, digests, elements):
        size = max(len(n), 1)
        fill = lambda x, f: x if x is not None else pa.nulls(size, f.type)
        return pa.RecordBatch.from_arrays([fill(x, f).cast(f.type) for x, f in zip((ids, n, digests, elements), arrow, strict=True)], schema=arrow)

    def run(batches):
        hashes, seen, held, total = Hashes(), set(), [], 0

        def counts():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n > 1], n[n > 1]
            if len(found):
                yield table(None, pa.array(n.astype(np.int64)), None, pa.array(found.view(np.int64)))

        for batch in batches:
            n, digests = [], []
            for text in texts(batch):
                found = shingles(text, hashes)
                key = digest(found)
                n.append(len(found))
                digests.append(key)
                if key is not None and key not in seen:
                    seen.add(key)
                    held.append(found)
                    total += len(found)
            if n:
                yield table(batch.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), None)
            if total > HELD:
                yield from counts()
                held, total = [], 0
                seen.clear()
        if held:
            yield from counts()
        del hashes, seen, held
        trim()

    return written(bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema), "shingles")


def listed(docs: DataFrame, boundary: int, frequent: np.ndarray, rank: np.ndarray, hot_from: int, percent: int, text_col: str) -> DataFrame:
    """(key, salt, h, n): each different set of a task, by its digest's first half, under all its keys; salt is 0 but for keys of rank ``hot_from`` and more."""
    schema = "key bigint, salt int, h bigint, n int"
    arrow = arrow_schema(docs.sparkSession, schema)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))  # at most MOST_FREQUENT entries

    def run(batches):
        hashes, seen = Hashes(), set()
        frequent, rank = shared.value
        for batch in batches:
            out, ranks, h, n = [], [], [], []
            for text in texts(batch, text_col):
                found = shingles(text, hashes)
                key = digest(found)
                if key is None or key in seen:
                    continue
                seen.add(key)
                key_, rank_ = keys(found, boundary, frequent, rank, percent)
                out.append(key_)
                ranks.append(rank_)
                h.append(short(key))
                n.append(len(found))
            if out:
                lengths = [len(x) for x in out]
                h = np.repeat(np.array(h, dtype=np.int64), lengths)
                salt = np.where(np.concatenate(ranks) >= hot_from, 1 + h % SALTS, 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(h), pa.array(np.repeat(np.array(n, dtype=np.int32), lengths))], schema=arrow)
            if len(seen) > SEEN:  # a set that is listed twice meets itself only
                seen.clear()
        del hashes, seen
        trim()

    return bounded(docs.select(text_col)).mapInArrow(run, schema)


def same_size(a: str, b: str, percent: int):
    """Whether two sets are near enough in size to link."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def shared_at_least(n: str):
    return 1 + F.floor(F.col(n) * SHARED / 100)


def met(lists: DataFrame) -> DataFrame:
    """Lists of two sets and more, without their single ones; parts of a salted list stay as they are."""
    in_list = Window.partitionBy("key", "salt")
    return lists.withColumns({"low": F.min("h").over(in_list), "high": F.max("h").over(in_list)}).where("low <> high or salt > 0").drop("low", "high")


def thinned(lists: DataFrame, boundary: int, percent: int, rounds: int = 2) -> DataFrame:
    """The lists (key, salt, h, n) without sets that share too little with all others together to link with one.

    A partner has percent of the set's size at least, so the two have the k of that size in common.
    Sets that still meet in subsets stay. Any number of rounds keeps every link.
    """
    of_set = Window.partitionBy("h")
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) * SHARED / 100)
    for _ in range(rounds):
        stays = (F.sum((F.col("key") % 2 != 0).cast("int")).over(of_set) >= least) | (F.col("n") <= boundary)
        before, lists = lists, lists.withColumn("stays", stays).where("stays").drop("stays")
        lists = written(met(lists), "lists")
        drop(before)
    return lists


def at_all_salts(rows: DataFrame) -> DataFrame:
    """Few rows by key, once for each salt that a list's parts can have: a join by (key, salt) then leaves the parts of a hot list apart."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS))))


def ranked(lists: DataFrame) -> DataFrame:
    """The lists with their length and the place of each set by its hash, the same order in all lists. Places beyond HUBS of salted lists are HUBS + 1.

    Short lists are of one part (salt 0), however they came.

    Of a salted list each part gives its first sets, and the list's first are found among these.
    """
    ordered = (F.xxhash64("h"), F.col("h"))
    lengths = lists.where("salt > 0").groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    salted = lists.where("salt > 0").join(at_all_salts(lengths), ["key", "salt"])
    part = Window.partitionBy("key", "salt").orderBy(*ordered)
    first = salted.where(F.col("length") > SHORT).withColumn("part", F.row_number().over(part)).where(F.col("part") <= HUBS).drop("part")
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*ordered))).where(F.col("place") <= HUBS)
    rest = salted.where(F.col("length") > SHORT).join(first.select("key", "h", "place"), ["key", "h"], "left").withColumn("place", F.coalesce("place", F.lit(HUBS + 1)))
    whole = Window.partitionBy("key")
    others = lists.where("salt = 0").unionByName(salted.where(F.col("length") <= SHORT).withColumn("salt", F.lit(0)).select(lists.columns))
    others = others.withColumns({"place": F.row_number().over(whole.orderBy(*ordered)), "length": F.count(F.lit(1)).over(whole)})
    return others.unionByName(rest)


def not_refuted(pairs: DataFrame, lists: DataFrame, boundary: int, percent: int) -> DataFrame:
    """The pairs (h_a, h_b, n_a, n_b) that have as many list elements in common as a link needs.

    A link needs ``need`` common elements, so a set may lack n - need of the other's. The set whose
    first n - ceil(t n) + k elements end sooner must have all but these in common with the other's.
    Pairs of small sets meet in subsets and are let through.
    """
    elements = lists.where("key % 2 <> 0").select("key", "h")
    both = pairs.where(F.greatest("n_a", "n_b") > boundary).join(elements.withColumnRenamed("h", "h_a"), "h_a").join(elements.withColumnRenamed("h", "h_b"), ["h_b", "key"])
    common = both.groupBy("h_a", "h_b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.count(F.lit(1)).alias("common"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    least = F.least(*(shared_at_least(c) + need - F.ceil(F.col(c) * percent / 100) for c in ("n_a", "n_b")))
    small = pairs.where(F.greatest("n_a", "n_b") <= boundary)
    return common.where(F.col("common") >= least).select("h_a", "h_b").unionByName(small.select("h_a", "h_b"))


def sets_of(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written: (h, digest, elements) of the classes (rep, h), once each: the sets of the documents with their ids, and of those without an id where a class has no other."""
    wanted = classes.where("rep is not null").select(F.col("rep").alias("id")).distinct()
    if wanted.count() <= FEW_IDS:
        wanted = F.broadcast(wanted)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = slim.join(wanted, "id", "left_semi")
    if not classes.where("rep is null").isEmpty():
        found = found.unionByName(slim.where("id is null"))

    def make():
        hashes = Hashes()

        def each(batch: pa.RecordBatch) -> dict:
            sets = [shingles(x, hashes) for x in texts(batch)]
            digests = [digest(x) for x in sets]
            return {"h": [short(x) for x in digests], "digest": digests, "elements": [x.tobytes() for x in sets]}

        return each

    sets = written(map_batches(found.select("text"), make, "h bigint, digest binary, elements binary"), "sets")
    if sets.count() == classes.count():
        return sets
    once = written(sets.dropDuplicates(["digest"]), "sets")  # ids or rows are repeated
    drop(sets)
    return once


class Forest:
    """Components of links as they come: which links connect what was apart."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def connects(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[x] = y
        return x != y


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), by digest, that connect the sets of those pairs (h_a, h_b) that have the similarity.

    The pairs of a set h_a meet in one task, and of the links there only a forest is kept: of a set's
    links to hubs that are connected already one stays, so links are not many more than sets.
    """
    one = sets.select(F.col("h").alias("h_a"), F.col("digest").alias("a"), F.col("elements").alias("e_a"))
    other = sets.select(F.col("h").alias("h_b"), F.col("digest").alias("b"), F.col("elements").alias("e_b"))
    joined = pairs.join(other, "h_b").join(one, "h_a").where("a <> b").select("a", "b", "e_a", "e_b")
    arrow = arrow_schema(pairs.sparkSession, "a binary, b binary")

    def run(batches):
        forest = Forest()
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("e_a"), batch.column("e_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and forest.connects(a, b))
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], schema=arrow)
            if len(forest.parent) > FOREST:  # a few links more, the same components
                forest = Forest()
        del forest
        trim()

    return bounded(joined).mapInArrow(run, "a binary, b binary")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of x with each of y."""
    of_x, of_y = (np.repeat(np.arange(len(z)), [len(e) for e in z]) for z in (x, y))
    all_x, all_y = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(all_x, all_y)
    out = np.zeros((len(x), len(y)), dtype=np.float64)
    for start in range(0, len(shared), COLUMNS):
        part = shared[start : start + COLUMNS]
        tables = []
        for rows, elements, count in ((of_x, all_x, len(x)), (of_y, all_y, len(y))):
            at = np.minimum(np.searchsorted(part, elements), len(part) - 1)
            hit = part[at] == elements
            table = np.zeros((count, len(part)), dtype=np.float32)
            table[rows[hit], at[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def blocks_of(placed: DataFrame) -> DataFrame:
    """placed (cluster, root, digest, n), with ``block``: the sets of a cluster in blocks, those of a component together.

    A block has about BLOCK sets and BLOCK_ELEMENTS elements at most. Components beyond that have blocks
    of their own; others are dealt out by hash. Nothing is ordered, so no cluster meets in one task.
    """
    sizes = placed.groupBy("cluster", "root").agg(F.sum(F.greatest(F.lit(1 / BLOCK), F.col("n") / BLOCK_ELEMENTS)).alias("size"))
    small = sizes.where(F.col("size") <= 1).groupBy("cluster").agg(F.ceil(F.sum("size")).alias("parts"))
    own = F.concat(F.lit("o"), F.hex("root"), F.lit("."), F.pmod(F.xxhash64("digest"), F.ceil("size")).cast("string"))
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.coalesce("parts", F.lit(1))).cast("string"))
    named = sizes.join(small, "cluster", "left").select("cluster", "root", "size", "parts")
    return placed.join(named, ["cluster", "root"]).select("cluster", "digest", "root", F.when(F.col("size") > 1, own).otherwise(shared).alias("block"))


def compared_in_blocks(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) that connect sets of long lists (key, salt, h, root, place) across components, as far as a block pair needs them.

    Sets that long lists connect are one cluster, and a cluster is cut into blocks. Blocks meet in pairs
    if a list has sets of both, unless these lie in one component.
    """
    digests = classes.select("h", "digest")
    hubs = members.where("place = 1").select("key", F.col("h").alias("hub"))
    together = members.join(at_all_salts(hubs), ["key", "salt"]).where("h <> hub").select("h", "hub").distinct()
    together = together.join(digests, "h").select("hub", F.col("digest").alias("a")).join(digests.withColumnRenamed("h", "hub"), "hub").select("a", F.col("digest").alias("b"))
    cluster = components(forest_of(together)).select(F.col("node").alias("digest"), F.col("root").alias("cluster"))
    placed = written(blocks_of(members.select("h", "root").distinct().join(digests, "h").join(cluster, "digest").join(sets.select("digest", (F.length("elements") / 8).alias("n")), "digest").select("cluster", "digest", "root", "n")), "placed")
    # Blocks by list, with the least and the greatest root that the list has there.
    by_list = members.select("key", "h").join(digests, "h").join(placed, "digest").groupBy("key", "cluster", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    by_list = written(by_list, "blocks")
    x, y = (by_list.select("key", "cluster", *(F.col(c).alias(f"{c}_{z}") for c in ("block", "low", "high"))) for z in "xy")
    needed = x.join(y, ["key", "cluster"]).where("block_x <= block_y and least(low_x, low_y) <> greatest(high_x, high_y)").select("cluster", "block_x", "block_y").distinct()
    needed = written(needed, "block-pairs")
    sides = [needed.withColumn("block", F.col("block_x")), needed.where("block_x <> block_y").withColumn("block", F.col("block_y"))]
    dealt = placed.join(sides[0].unionByName(sides[1]), ["cluster", "block"]).join(sets.select("digest", "elements"), "digest")

    def compare(table: pa.Table) -> pa.Table:
        block, here = np.array(table.column("block").to_pylist()), table.column("block_x")[0].as_py()
        elements = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
        digests, roots = table.column("digest").to_pylist(), table.column("root").to_pylist()
        number: dict[bytes, int] = {}
        root = np.array([number.setdefault(r, len(number)) for r in roots])
        size = np.array([len(e) for e in elements])
        rows = np.flatnonzero(block == here)
        others = np.flatnonzero(block != here)
        others = others if len(others) else rows
        common = overlaps([elements[i] for i in rows], [elements[i] for i in others])
        hit = 100 * common >= percent * (size[rows][:, None] + size[others][None, :] - common)
        forest, a, b = Forest(), [], []
        for i, j in zip(*np.nonzero(hit & (root[rows][:, None] != root[others][None, :])), strict=True):
            if forest.connects(int(root[rows[i]]), int(root[others[j]])):
                a.append(digests[rows[i]])
                b.append(digests[others[j]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    out = written(dealt.groupBy("cluster", "block_x", "block_y").applyInArrow(compare, "a binary, b binary"), "links")
    drop(placed, by_list, needed)
    return out


def forest_of(links: DataFrame) -> DataFrame:
    """Fewer of the links (a, b), with the same components: in each task a forest of its own."""
    arrow = arrow_schema(links.sparkSession, "a binary, b binary")

    def run(batches):
        forest = Forest()
        for batch in batches:
            keep = [forest.connects(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], schema=arrow)
            if len(forest.parent) > FOREST:
                forest = Forest()

    return links.select("a", "b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b) the least node of its component.

    Least labels go along links, and each label then becomes its own label's label, so even a long
    chain takes few rounds. Each round is written; sums of changes are all that the driver sees.
    """
    edges = written(links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))), "edges")
    roots = written(edges.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root")).withColumn("changed", F.lit(True)), "roots")
    while not roots.where("changed").isEmpty():
        heard = edges.join(roots, "node").groupBy(F.col("to").alias("node")).agg(F.min("root").alias("heard"))
        nearer = written(roots.join(heard, "node").select("node", F.least("root", "heard").alias("near"), "root"), "nearer")
        beyond = nearer.select(F.col("node").alias("near"), F.col("near").alias("beyond"))
        root = F.least("near", F.coalesce("beyond", "near"))
        following = written(nearer.join(beyond, "near", "left").select("node", root.alias("root"), (root != F.col("root")).alias("changed")), "roots")
        drop(roots, nearer)
        roots = following
    drop(edges)
    return roots.select("node", "root")


def membership(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: (id, n, digest) of each row, and (digest, root, component_id) of each different set; equal roots are one component."""
    both = profile(docs, id_col, text_col)
    each, several = both.where("element is null").select("id", "n", "digest"), both.where("element is not null").select("element", "n")
    reps = written(each.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")

    top = several.groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "element").limit(MOST_FREQUENT).toPandas()
    top["element"] = top["element"].to_numpy(np.int64).view(np.uint64)
    top = top.sort_values("element")
    frequent, rank = top["element"].to_numpy(), 1 + np.log2(top["n"].to_numpy(np.float64)).astype(np.int64)
    small = {r.n: r.sets for r in reps.where(F.col("n") <= 2 * MOST_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("sets")).collect()}
    elements, n_sets = reps.agg(F.sum("n"), F.count(F.lit(1))).first()
    boundary = best_boundary(small, float((top["n"] - 1).sum()) / max(1, elements or 0), percent)
    hot_from = 1 + int(math.log2(max(HOT, n_sets / HOT)))

    rows = listed(docs, boundary, frequent, rank, hot_from, percent, text_col)
    lists = thinned(written(met(rows).distinct(), "lists"), boundary, percent)
    classes = written(with_short(reps).join(lists.select("h").distinct(), "h", "left_semi").select("rep", "digest", "h"), "listed-classes")
    sets = sets_of(docs, classes, id_col, text_col)

    members = written(ranked(lists), "members")
    hubs = members.where((F.col("place") <= HUBS) | (F.col("length") <= SHORT))
    hubs = hubs.where("salt = 0").unionByName(at_all_salts(hubs.where("salt > 0").drop("salt")).where("salt > 0"))
    a, b = (x.select("key", "salt", "place", *(F.col(c).alias(f"{c}_{y}") for c in ("h", "n"))).withColumnRenamed("place", f"place_{y}") for x, y in ((members, "a"), (hubs, "b")))
    # The order of places is the same in all lists, so a pair is always met as (later, earlier).
    meeting = a.join(b, ["key", "salt"]).where((F.col("place_b") < F.col("place_a")) & same_size("n_a", "n_b", percent))
    pairs = written(meeting.select("h_a", "n_a", "h_b", "n_b").distinct(), "pairs")
    unrefuted = written(not_refuted(pairs, lists, boundary, percent), "unrefuted")
    drop(pairs)
    links = written(linked(unrefuted, sets, percent), "links")
    drop(unrefuted, lists)

    # What is left are long lists whose sets are not all connected yet.
    extra = []
    long_lists = members.where(F.col("length") > SHORT)
    if not long_lists.isEmpty():
        roots = components(links).withColumnRenamed("node", "digest")
        placed = classes.select("h", "digest").join(roots, "digest", "left").select("h", F.coalesce("root", "digest").alias("root"))
        rooted = written(long_lists.join(placed, "h").select("key", "salt", "h", "root", "place"), "rooted-lists")
        mixed_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        open_lists = written(rooted.join(at_all_salts(mixed_), ["key", "salt"], "left_semi"), "open-lists")
        if not open_lists.isEmpty():
            extra = [compared_in_blocks(open_lists, classes, sets, percent)]
        drop(rooted, open_lists)
    every = links.unionByName(extra[0]) if extra else links
    roots = components(every)
    drop(members, sets, classes, links, *extra)

    rooted = written(reps.select("digest", "rep").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = written(join_skewed(rooted.select("digest", "root"), least, "root").select("digest", "root", "component_id"), "components")
    each = written(each, "rows")
    drop(both, reps, rooted)
    return each, of_class


def groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row of docs: the least id that links lead to, its own included.

    Null and empty texts, and those of spaces alone, have empty sets and link with nothing. Repeated
    rows and copies have equal sets, so they link. A null id is never a component's id unless the
    component has no other. An empty table gives an empty result; other columns play no part. Sets are
    compared by 64-bit hashes of their elements, so chance could merge two elements of a pair of
    documents once in some 10^12 pairs.
    """
    each, of_class = membership(docs, percent, id_col, text_col)
    out = join_skewed(each, of_class, "digest")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def with_short(reps: DataFrame) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> dict:
            return {"rep": batch.column("rep"), "digest": batch.column("digest"), "h": [short(x) for x in batch.column("digest").to_pylist()]}

        return each

    return map_batches(reps.select("rep", "digest"), make, f"rep {dict(reps.dtypes)['rep']}, digest binary, h bigint")


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, whole, for each component: one with the component's id.

    Null, empty and blank texts link with nothing and all stay. Of rows that are repeated whole, and of
    rows without an id that are alike, one stays; a row without an id goes if a row with one is like it.
    An id that stands at several unlike texts is no fault: each text is judged by its own component, so
    only rows that are a copy of another go. An empty table stays empty. Other columns stay as they are,
    whatever their names.
    """
    each, of_class = membership(docs, percent, id_col, text_col)
    found = written(join_skewed(each, of_class, "digest").select("id", "digest", "root", "component_id"), "found")
    several = written(found.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "several")
    gone = found.where("id <> component_id").select("id").distinct()
    apart = written(gone.unionByName(several).distinct(), "apart")
    small = lambda table: F.broadcast(table) if table.count() <= FEW_IDS else table
    key = docs[id_col]
    kept = docs.where(key.isNotNull()).join(small(apart), key == apart["id"], "left_anti")
    if several.isEmpty() and found.where("id is null").isEmpty():
        return kept
    # Rows whose id does not tell them apart are judged by their own texts.
    digest_col, root_col, component_col = fresh(docs, "digest", "root", "component")
    unsure = docs.where(key.isNull()).unionByName(docs.join(small(several), key == several["id"], "left_semi"))

    def make():
        hashes = Hashes()

        def each_(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in docs_columns} | {digest_col: [digest(shingles(x, hashes)) for x in texts(batch, text_col)]}

        return each_

    docs_columns = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{digest_col}` binary"])
    judged = written(map_batches(unsure, make, schema), "unsure")
    known = of_class.select(F.col("digest").alias(digest_col), F.col("root").alias(root_col), F.col("component_id").alias(component_col))
    judged = judged.join(known, digest_col, "left")
    alone = judged.where(F.col(digest_col).isNull())
    ones = judged.where(F.col(digest_col).isNotNull() & F.col(id_col).eqNullSafe(F.col(component_col))).dropDuplicates([root_col])
    return kept.unionByName(alone.select(docs_columns)).unionByName(ones.select(docs_columns))
