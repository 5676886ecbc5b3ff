"""Packing: patterns against enumeration, the fit against its conditions, best fit against a plain one, whole tables against the library."""

import json
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement
from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import entry, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(1, 24), min_size=1), st.integers(1, 4))
def test_patterns_are_all_there_is(lengths, parts):
    found = [tuple(v for v in row if v) for row in packing.patterns(np.array(sorted(lengths)), 24, parts).tolist()]
    wanted = {tuple(sorted(c, reverse=True)) for n in range(1, parts + 1) for c in combinations_with_replacement(sorted(lengths), n) if sum(c) == 24}
    assert len(found) == len(set(found)) and set(found) == wanted


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_fit_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    counts, weight = rng.integers(0, 30, 25).astype(float), np.arange(25) / 24
    counts[0] = 0
    columns = packing.patterns(np.flatnonzero(counts), 24, 3)
    if not len(columns):
        return
    x = packing.nonnegative(columns, counts, weight)
    left = counts - np.bincount(columns.ravel(), np.repeat(x, 3), 25)
    gain = ((weight**2 * left)[columns] * (columns > 0)).sum(axis=1)
    assert (x >= 0).all() and gain.max() <= 1e-2 and np.abs(gain[x > 1e-6]).max(initial=0) <= 1e-2


def plain_best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, r in enumerate(room) if r >= n), key=lambda i: room[i], default=None)
        if at is None:
            room.append(size - n)
        else:
            room[at] -= n
    return len(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_and_plan_hold_every_piece(lengths):
    counts = np.bincount(lengths, minlength=21)
    for made in (packing.best_fit(counts, 20), packing.plan(counts, 20)):
        held = Counter()
        for own, n in made:
            assert sum(own) <= 20 and n > 0
            for length in own:
                held[length] += n
        assert held == Counter(lengths)
    assert sum(n for _, n in packing.best_fit(counts, 20)) == plain_best_fit(lengths, 20)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(1, 1025, 40_000), minlength=1025) + np.bincount(rng.integers(1, 300, 20_000), minlength=1025)
    bound = -(-int((np.arange(1025) * counts).sum()) // 1024)
    assert bound <= sum(n for _, n in packing.plan(counts, 1024)) <= bound + 10


def check(rows, by_text, size, end):
    """Pieces tile the documents of by_text, all sequences are gapless."""
    pieces, spots = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["doc_id"] in by_text:
            pieces[r["doc_id"]].append(r)
        spots[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(by_text)
    for doc_id, text in by_text.items():
        ids = np.array([*LIBRARY.encode(text, add_special_tokens=False).ids, end], dtype="<u4").tobytes()
        own = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == size for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and 0 < r["length"] <= size and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert 4 * at == len(ids) and len(own) == -(-at // size)
    for found in spots.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size
    return len(spots)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = entry.queries()["op11_pattern_packing"](spark, sf_dir).collect()
    n = check(rows, {r["doc_id"]: r["text"] or "" for r in docs.collect()}, 1024, 2)
    assert n <= 1.01 * sum(r["length"] for r in rows) / 1024 + 3


def test_odd_rows(spark, docs):
    rows = packing.packed(docs, PATH, size=64, keep_ids=True).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    twins = {d for (d, _), n in texts.items() if n > 1}
    check(rows, {d: t or "" for d, t in texts if d not in twins}, 64, 2)
    assert all(sum(r["doc_id"] == d and r["piece"] == 0 for r in rows) == 2 for d in twins)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_sequences_hold_what_was_placed(spark, docs):
    placed = packing.packed(docs, PATH, size=64)
    whole = packing.sequences(placed).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in placed.collect()) and all(4 * r["n_tokens"] == len(r["ids"]) <= 256 for r in whole)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text("the inga \n\t", max_size=60), st.text("aéß日語'  \x1c\x85 1.!<|>", max_size=60), st.sampled_from(["a<|endoftext|>  b", " <|endoftext|>"])), max_size=6))
def test_ids_like_the_library(texts):
    wanted = [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert packing.tokens(PATH).packed(texts) == wanted


def test_texts_are_encoded_whole_by_ranks():
    own = packing.Tokens(PATH, packing.by_ranks(PATH))
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    batch = ["".join(f"a{c}1 {c}! {c} " for c in points[i : i + 1024]) for i in range(0, len(points), 1024)]
    assert own.packed(batch) == own.each(batch) and not own.known
    long = [" " * 2_000_000 + "x", "a" + "\n" * 1_500_000, "b <|endoftext|>  c"]
    assert own.packed(long) == own.each(long)


def test_ranks_are_used_only_where_they_give_the_ids(tmp_path):
    file = json.loads(Path(PATH).read_text())
    vocab = {t: i for t, i in file["model"]["vocab"].items() if i < 256}
    small = {"ab": 256, "abc": 257, "bc": 258}

    def says(merges, **more):
        model = file["model"] | {"vocab": vocab | small, "merges": merges} | more
        (tmp_path / "x.json").write_text(json.dumps(file | {"model": model}))
        packing.by_ranks.cache_clear()
        return packing.by_ranks(str(tmp_path / "x.json"))

    assert says([["a", "b"], ["ab", "c"], ["b", "c"]]) and says(["a b", "ab c", "b c"])
    assert not says([["a", "b"], ["a", "bc"], ["b", "c"]])  # a and bc never come to stand side by side
    assert not says([["b", "c"], ["ab", "c"], ["a", "b"]])  # not in the order of ids
    assert not says([["a", "b"], ["ab", "c"]]) and not says([["a", "b"], ["ab", "c"], ["b", "c"]], dropout=0.1)
