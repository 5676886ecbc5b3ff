"""The Jaccard join, mixing and language-model scores against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import common, mixing, ngram_join, suffix_tree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def slow_groups(texts, percent=75):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, groups=25, size=12):
    """Groups of near copies at all distances, chains among them, and passages that unlike texts share."""
    rnd, texts = random.Random(seed), {}
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    for _ in range(groups):
        text = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 6, 8, 9, 12, 20, 40, 90, 200]))]
        if rnd.random() < 0.3:
            text += passage
        for _ in range(rnd.randrange(1, size)):
            texts[len(texts)] = " ".join(text)
            text = list(text)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                at = rnd.randrange(len(text) + 1)
                text[at : at + rnd.choice([0, 1])] = [rnd.choice(words)]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_against_all_pairs(spark, monkeypatch, seed):
    if seed == 2:  # nearly all comparisons are left to the blocks
        monkeypatch.setattr(ngram_join, "HUBS", 1)
        monkeypatch.setattr(ngram_join, "SHORT", 2)
        monkeypatch.setattr(ngram_join, "BLOCK", 8)
        monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", 300)
        monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    if seed == 3:  # lists of two sets and more are salted
        monkeypatch.setattr(ngram_join, "HOT", 1)
        monkeypatch.setattr(ngram_join, "FREQUENT", 2)
        monkeypatch.setattr(ngram_join, "SALTS", 3)
        monkeypatch.setattr(ngram_join, "HUBS", 2)
        monkeypatch.setattr(ngram_join, "SHORT", 4)
    texts = copies(seed, 60, 30)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df).collect()}
    assert got == slow_groups(texts)


@pytest.mark.parametrize("boundary", [1, 7, 64])
def test_any_boundary_and_order_meets_all_links(boundary):
    """Any two sets that link share a key, whatever the boundary and whatever counts as frequent."""
    texts, hashes = copies(3), ngram_join.Hashes()
    sets = {i: ngram_join.shingles(t, hashes) for i, t in texts.items()}
    common_ones, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    frequent, rank = common_ones[n > 3], n[n > 3].astype(np.int64)
    keyed = {i: set(ngram_join.keys(s, boundary, frequent, rank, 75)[0].tolist()) for i, s in sets.items()}
    links = 0
    for a in sets:
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if x != y and 100 * len(x & y) >= 75 * len(x | y):
                links += 1
                assert keyed[a] & keyed[b]
    assert links > 20


def test_overlaps():
    rnd = np.random.default_rng(1)
    x, y = ([np.unique(rnd.integers(0, 60, n)).astype(np.uint64) for n in rnd.integers(1, 50, 20)] for _ in "xy")
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert ngram_join.overlaps(x, y).tolist() == want


def test_boundary_follows_cost():
    assert ngram_join.best_boundary({4: 1000, 100: 10}, shared=5.0, percent=75) < ngram_join.best_boundary({4: 1000, 100: 10}, shared=0.01, percent=75) or ngram_join.best_boundary({4: 1000}, 0.5, 75) >= 1


def test_one_of_each(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(5, text, "en", "s", 1), (3, text.upper(), "en", "s", 1), (3, text.upper(), "en", "s", 1), (9, "other words", "en", "s", 1), (None, text, "en", "s", 1), (7, None, "en", "s", None), (8, "", "en", "s", 0)]
    out = ngram_join.one_of_each(spark.createDataFrame(rows, DOCS))
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [3, 7, 8, 9]


def test_one_of_each_keeps_every_text_of_a_repeated_id(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(20)) for c in "ABCDE"}
    rows = [(3, "A"), (5, "A"), (5, "B"), (7, "B"), (8, "A"), (8, "C"), (None, "A"), (None, "D"), (None, "D"), (11, "E"), (11, "E"), (12, None), (12, None)]
    out = ngram_join.one_of_each(spark.createDataFrame([(i, text.get(t), "en", "s", 1) for i, t in rows], DOCS).repartition(3))
    assert sorted(((r["doc_id"], (r["text"] or "-")[0]) for r in out.collect()), key=str) == sorted([(3, "A"), (5, "B"), (8, "C"), (None, "D"), (11, "E"), (12, "-"), (12, "-")], key=str)


def test_a_null_id_links_what_stands_on_both_sides(spark):
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[i : i + 80]) for i in (0, 9, 18)]  # only neighbours link
    rows = [(5, chain[0], "en", "s", 0), (None, chain[1], "en", "s", 0), (9, chain[2], "en", "s", 0)]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(5, 5), (None, 5), (9, 5)}


def test_a_forest_has_the_components_of_its_links(spark):
    rnd = random.Random(4)
    links = [(bytearray([rnd.randrange(60)]), bytearray([rnd.randrange(60, 80)])) for _ in range(400)]
    df = spark.createDataFrame(links, "a binary, b binary").coalesce(1)
    fewer = ngram_join.forest_of(df)
    roots = lambda x: {bytes(r["node"]): bytes(r["root"]) for r in ngram_join.components(x).collect()}
    assert fewer.count() < 80 and roots(fewer) == roots(df)


def test_long_chains_have_one_component(spark):
    links = spark.createDataFrame([(bytearray([i]), bytearray([i + 1])) for i in range(100)] + [(bytearray([200]), bytearray([201]))], "a binary, b binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in ngram_join.components(links).collect()}
    assert set(roots.values()) == {bytes([0]), bytes([200])} and len(roots) == 103


def test_skewed_joins_keep_all_rows(spark):
    big = common.written(spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 50 = 1, null, cast(id as string))) as k"), "big")
    small = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    out = common.join_skewed(big, small, "k")
    assert out.columns == ["id", "k", "v"] and out.count() == 3000 and out.where("v = 1").count() == 1000 and out.where("v = 2").count() == 1


# --- mixing ---


def slow_targets(sizes):
    """sizes: source -> words. The contract's rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def mixable(seed):
    rnd = random.Random(seed)
    rows = []
    for s in ["a", "b", "é", "Z", None, "tiny", ""]:
        for _ in range(rnd.choice([1, 20, 300])):
            rows.append((len(rows), " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 1, 30, 200]))), "en", s, 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rows = mixable(seed)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    want, taken, largest = slow_targets(sizes), collections.Counter(), collections.Counter()
    for i, text, _, source, _ in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (len(text.split()), sizes[source]) and r["target"] == pytest.approx(want[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert {i: r["taken"] for i, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(df.coalesce(1)).collect()}


def test_many_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "IN_BIN", 4)
    rows = [(i, "w " * (1 + i % 9), "en", "ab"[i % 2], 0) for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    out["source"] = ["ab"[i % 2] for i in out["doc_id"]]
    by = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by["target"] - by["taken"]).abs().max() <= 5


def test_mixed_takes_no_rows_without_words(spark, docs):
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate([None, "", " \n", "a b c d", "e f", "g h i"] * 3)]
    table = spark.createDataFrame(rows, DOCS)
    full = common.written(mixing.keyed(table, 1), "t")
    for weights in ((1, 1), (9, 1)):  # a source that is taken once more, and one that stands twice
        made = mixing.repeated(full, *mixing.plan(full.select("__row", "__s", "source", "doc_id", "__size", "__h"), weights=weights))
        plan = {r["doc_id"]: r["__times"] for r in made.collect()}
        assert max(plan.values()) == 2 and all(not plan[i] for i in range(18) if i % 6 < 3)
    out = mixing.mixed(table).collect()
    assert out and all((r["text"] or "").split() for r in out)
    assert all(r["repetitions"] == 0 for r in mixing.mix(table).collect() if not r["size"])
    assert all((r["text"] or "").encode().split() for r in mixing.mixed(docs).collect())


def test_mixed_repeats_whole_rows(spark):
    df = spark.createDataFrame(mixable(4), DOCS)
    want = {r["doc_id"]: r["repetitions"] for r in mixing.mix(df).collect()}
    got = collections.Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    assert got == {i: n for i, n in want.items() if n}


# --- language model ---


def corpus(seed, n=300):
    rnd, words = random.Random(seed), [f"w{i}" for i in range(50)]
    pairs = {w: rnd.sample(words, 2) for w in words}
    out = []
    for i in range(n):
        text = [rnd.choice(words)]
        for _ in range(rnd.randrange(1, 60)):
            text.append(rnd.choice(pairs.get(text[-1], words)) if rnd.random() < 0.8 else rnd.choice([*words, f"rare{rnd.randrange(999)}"]))
        out.append((i, " ".join(text).title(), "en", "s", 0))
    return out


def test_scores(spark):
    rows = corpus(1)
    got = suffix_tree.scores(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    tokens = {i: t.lower().split() + [None] for i, t, *_ in rows}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    c = collections.Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    gained = 0.0
    for r in got:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        gained += (r["score"] - r["base_score"]) * r["held_out"]
    assert gained > 200  # contexts tell much here


@pytest.mark.parametrize("hot", [1, 30, 1000])
def test_chunks_buckets_and_hot_contexts_do_not_matter(spark, monkeypatch, hot):
    """With hot = 1 no context is dealt out by the next word, with 1000 nearly all are."""
    df = spark.createDataFrame(corpus(2), DOCS)
    want = {r["doc_id"]: r["score"] for r in suffix_tree.scores(df).collect()}
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 700)
    monkeypatch.setattr(common, "ARROW_ROWS", 8)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.scores(df.repartition(4)).collect()}
    assert got == pytest.approx(want, rel=2e-4)


def test_every_word_is_a_symbol_and_contexts_need_no_share(spark):
    """Words of far less than a thousandth of the tokens, and a passage that occurs twice, are learned."""
    rnd = random.Random(7)
    passage = [f"only{i}" for i in range(30)]
    rows = [(i, " ".join(f"filler{rnd.randrange(40)}" for _ in range(200)), "en", "s", 0) for i in range(400)]
    train = [i for i in range(1000, 1020) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    held = [i for i in range(2000, 2050) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    shuffled = rnd.sample(passage, 30)
    rows += [(i, " ".join(x), "en", "s", 0) for i, x in ((train[0], passage), (train[1], passage), (held[0], passage), (held[1], shuffled))]
    got = {r["doc_id"]: r for r in suffix_tree.scores(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got[held[0]]["n_known"] == got[held[1]]["n_known"] == 31
    assert got[held[0]]["score"] - got[held[1]]["score"] > 60


def slow_scores(texts):
    """id -> score, by the definition: contexts with all their counts, from the root up."""
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    tokens = {i: ["", *t.lower().split(), None] for i, t in texts.items()}  # "" is the start, None the end
    c = collections.Counter(w for i, ws in tokens.items() if i not in held for w in ws[1:])
    whole, after = sum(c.values()) + 0.5 * (len(c) + 1), collections.defaultdict(collections.Counter)
    for i in set(tokens) - held:
        for at in range(1, len(tokens[i])):
            for k in range(1, min(suffix_tree.DEPTH, at) + 1):
                after[tuple(tokens[i][at - k : at])][tokens[i][at]] += 1
    states = {(): None}

    def p(context, word):
        if not context:
            return (c[word] + 0.5) / whole
        n, suffix = after[context], p(context[1:], word)
        weight = max(suffix_tree.PRIOR, len(n))
        return (n[word] + weight * suffix) / (sum(n.values()) + weight)

    for context in sorted(after, key=len):
        n, total = after[context], sum(after[context].values())
        if total < suffix_tree.LEAST or context[1:] not in states:
            continue
        many, once = [w for w in n if n[w] > 1], sum(x == 1 for x in n.values())
        before = {w: p(context[1:], w) for w in many}
        divergence = sum(2 * n[w] * math.log(n[w] / (total * before[w])) for w in many)
        if once:
            divergence += 2 * once * math.log(once / (total * max(1e-12, 1 - sum(before.values()))))
        free = max(1, len(many) + (once > 0) - 1)
        if divergence > free + suffix_tree.DEVIATIONS * math.sqrt(2 * free):
            states[context] = None
    out = {}
    for i, ws in tokens.items():
        out[i] = 0.0
        for at in range(1, len(ws)):
            best = ()
            for k in range(1, min(suffix_tree.DEPTH, at) + 1):
                if tuple(ws[at - k : at]) not in states:
                    break
                best = tuple(ws[at - k : at])
            out[i] += math.log10(p(best, ws[at]))
    return out, len(states)


@pytest.mark.parametrize("hot", [1, 40, 1000])
def test_scores_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 2000)
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 3000)
    rows = corpus(3)
    rows += [(1000 + i, rows[7][1], "en", "s", 0) for i in range(40)] + [(2000, "again " * 500, "en", "s", 0), (2001, "", "en", "s", 0), (2002, "again", "en", "s", 0)]
    got = {r["doc_id"]: r["score"] for r in suffix_tree.scores(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    want, states = slow_scores({i: t for i, t, *_ in rows})
    words = {i: len(t.split()) + 1 for i, t, *_ in rows}
    assert states > 60 and got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) / words[i] for i in want) <= 0.5 / suffix_tree.PARTS + 1e-6


def test_probabilities_after_a_state_sum_to_one():
    n, p = np.array([5.0, 1, 0, 0, 3]), np.array([0.1, 0.2, 0.3, 0.15, 0.25])
    assert suffix_tree.smooth(n, p, n.sum(), 3).sum() == pytest.approx(1)


def test_chance_makes_no_states():
    rnd = np.random.default_rng(2)
    p = np.full(50, 0.02)
    sums = [suffix_tree.summed(rnd.multinomial(2000, p).astype(float), p, np.zeros(50, dtype=int), 1) for _ in range(200)]
    assert sum(suffix_tree.judged(x)[0] for x in sums) <= 4


def test_messages_round_trip():
    rnd = np.random.default_rng(3)
    columns = [rnd.integers(0, 1 << bits, 1000).astype(np.uint64) for bits in (1, 8, 20, 47, 63)] + [np.zeros(1000, dtype=np.uint64)]
    assert all((a == b).all() for a, b in zip(columns, suffix_tree.unpacked(suffix_tree.packed(*columns), 6), strict=True))
    assert [len(x) for x in suffix_tree.unpacked(suffix_tree.packed(np.zeros(0, np.uint64)), 1)] == [0]
    p = rnd.random(100)
    assert np.allclose(suffix_tree.from_parts(suffix_tree.in_parts(p)), p, rtol=4e-4)


def test_a_context_does_not_reach_into_another_text():
    sequence, since = np.array([5, 6, 7, 8, 9]), suffix_tree.inside(np.array([3, 2]))
    assert suffix_tree.preceding(sequence, since, 1, 1, 0).tolist() == [1, 5, 6, 1, 8]
    assert suffix_tree.preceding(sequence, since, 2, 1, 0).tolist() == [0, 1, 5, 0, 1]


def test_a_third_of_all_rows_alike(spark):
    """Copies, one source: hot groups change nothing."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, text if i % 3 == 0 else f"{text} {i} {i + 1} {i + 2} {i + 3} {i + 4}", "en", "s" if i % 3 else "t", 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df).collect()}
    assert got == slow_groups({i: t for i, t, *_ in rows})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(" \t\x0b\x1c\x85\xa0aBÀé日", max_size=20)), max_size=12), st.integers(0, 3), st.integers(1, 5))
def test_words_of_batches_are_those_of_the_texts(texts, skip, step):
    column = pa.array(["Before", " X y ", None, *texts], pa.string()).slice(skip)
    found = [suffix_tree.split(column.slice(i, step)) for i in range(0, max(1, len(column)), step)]
    vocabulary, numbers, counts = suffix_tree.joined(found)
    want = [(x or "").encode().lower().split() for x in column.to_pylist()]
    assert counts.tolist() == [len(x) for x in want] and [vocabulary[i] for i in numbers.tolist()] == [w for x in want for w in x]
    assert len(set(vocabulary)) == len(vocabulary)


def test_hashes_are_grouped_as_numpy_does():
    rng = np.random.default_rng(4)
    for keys in (np.zeros(0), rng.integers(0, 5, 40), rng.integers(0, 2**62, 1000)[rng.integers(0, 1000, 5000)] * 2, (1 << 62) + rng.integers(0, 1 << 14, 9000)):  # the last differ in low bits alone
        keys = np.array([int(k) for k in keys], dtype=np.uint64)
        index, inverse = suffix_tree.grouped(keys)
        assert all((a == b).all() for a, b in zip((index, inverse), np.unique(keys, return_index=True, return_inverse=True)[1:], strict=True))
        buckets = np.sort(keys % np.uint64(7))
        assert suffix_tree.dealt(buckets) == [(int(b), slice(int(x), int(x + n))) for b, x, n in zip(*np.unique(buckets, return_index=True, return_counts=True), strict=True)]
