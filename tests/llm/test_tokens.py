"""Byte-level BPE against the library, token counts against a plain greedy search."""

import hashlib
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, tokencount

PATTERN = public_tokenizers.PATTERN
NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]
LIBRARY = {n: tiktoken.Encoding(n, pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(n)), special_tokens={}) for n in NAMES}
ENCODER = {n: bpe.encoder(public_tokenizers.path(n), PATTERN) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_every_token_is_its_own_encoding(name):
    e = ENCODER[name]
    assert all(len(t) == 1 or e.split(i) for t, i in e.ranks.items())


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(NAMES), st.one_of(st.text("abehint \n", max_size=80), st.text("aéß日語'  \x1c\x85 \t1.!", max_size=60), st.text("the and ing", max_size=200)))
def test_like_the_library(name, text):
    ids = ENCODER[name].encode(text)
    assert ids == LIBRARY[name].encode_ordinary(text)
    assert ENCODER[name].packed(text) == array("I", ids).tobytes() and ENCODER[name].decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 9_000, "\n" * 999 + "x", "thethe" * 3000, "'s're don't", "", "<|endoftext|>"])
@pytest.mark.parametrize("name", NAMES)
def test_long_runs(name, text):
    assert ENCODER[name].encode(text) == LIBRARY[name].encode_ordinary(text)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_id = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in bpe.digests(docs, public_tokenizers.path(NAMES[0]), PATTERN).collect():
        ids = LIBRARY[NAMES[0]].encode_ordinary(by_id[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()


def greedy(word, vocabulary):
    """Pieces by longest match, 0 if there are none; the first carries the mark."""
    text, at, pieces = tokencount.MARK + word, 0, 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in vocabulary), None)
        if end is None:
            return 0
        at, pieces = end, pieces + 1
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.text("abcd", min_size=1, max_size=12))
def test_counts_like_greedy_search(starts, insides, word):
    vocabulary = {tokencount.MARK + s for s in starts} | insides
    assert tokencount.Automaton(vocabulary | {tokencount.MARK}).count(word) == greedy(word, vocabulary | {tokencount.MARK})
    assert tokencount.Automaton(vocabulary).count(word) == greedy(word, vocabulary)


def test_counts_of_the_table(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = tokencount.pieces_of(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000")
    by_id = {r["doc_id"]: r["text"].encode().split() for r in docs.collect()}
    known = {w: greedy(w.decode(), vocabulary) for ws in by_id.values() for w in ws}
    for r in tokencount.token_counts(docs, path).collect():
        pieces = [known[w] for w in by_id[r["doc_id"]]]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(pieces), sum(pieces) + pieces.count(0), pieces.count(0))


def test_a_full_memo_keeps_what_is_asked_for_again():
    """A memo that was emptied whole when it was full encoded frequent words anew each time."""
    from millrace.llm.bpe import Memo

    made = []
    memo = Memo(10, lambda key: made.append(key) or key)
    for i in range(1, 100):
        assert memo[0] == 0 and memo[i] == i
    assert made.count(0) == 1 and len(memo) + len(memo.old) <= 10
