"""Periodic runs against brute force, in one piece and by ranges of lags, and against SQL."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import runs


def plain(words):
    """(start, length, period) of all runs: for every period, stretches that cannot be extended and have no smaller period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        for s in range(n - q):
            if s and words[s - 1] == words[s - 1 + q]:
                continue
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            part = words[s:e]
            if e - s >= max(12, 2 * q) and not any(part[k:] == part[:-k] for k in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(found), *longest, longest[1] and 1000 * longest[1] // longest[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


WORDS = st.one_of(
    st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.sampled_from("abc"), max_size=60),
    st.tuples(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 9), st.lists(st.sampled_from("abc"), max_size=5)).map(lambda x: x[0] + x[1] * x[2] + x[3]),
)


@settings(max_examples=400, deadline=None)
@given(WORDS, st.integers(1, 40))
def test_runs_like_brute_force(words, each):
    ids = runs.word_ids([w.encode() for w in words])
    whole = runs.smallest(runs.stretches(ids, 1, len(ids)))
    assert [tuple(r) for r in whole.tolist()] == plain(words)
    parts = [runs.stretches(ids, a, b) for a, b in runs.lag_ranges(len(ids), each)]
    assert parts == [] and not len(whole) or (runs.smallest(np.concatenate(parts)) == whole).all()


def test_many_lags_at_once_in_small_blocks(monkeypatch):
    ids = np.array([0, 1, 2] * 30 + [3] * 40 + list(range(9)), dtype=np.int32)
    whole = runs.stretches(ids, 1, len(ids)).tolist()
    monkeypatch.setattr(runs, "HELD", 1)
    assert runs.stretches(ids, 1, len(ids)).tolist() == whole


def some(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    texts = [" ".join(f"w{(i * 7 + d) % (11 + d)}" for i in range(40 + 9 * d)) for d in range(8)]
    made = list(zip(ids, texts, strict=True)) + [(1, "a b " * 30 + "c d e " * 20), (2, "x"), (3, "x\u0085y\x1cz " * 12), (None, "q " * 50), (5, None), (6, ""), (7, "a b\n" * 6), (7, "a b\n" * 6)]
    return spark.createDataFrame(made, "doc_id long, text string"), made


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rows_in_one_piece_and_by_ranges(spark):
    docs, made = some(spark)
    wanted = sorted((expected(*m) for m in made), key=str)
    assert rows(runs.runs(docs)) == wanted
    assert rows(runs.runs(docs, work=50)) == wanted  # every text of more than ten words goes by ranges
    assert docs.where(runs.long_text("text", 50)).count() > 8


def test_unchanged_words(spark):
    docs, made = some(spark)
    found = {r["doc_id"]: r["n_runs"] for r in runs.runs(docs, change=None).where("doc_id is not null").collect()}
    assert found == {d: len(plain((t or "").encode().split())) for d, t in made if d is not None}
