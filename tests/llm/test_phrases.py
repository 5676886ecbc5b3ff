"""Phrases against brute force, with hot prefixes, small chunks and branches that go on from batch to batch."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from millrace.llm import entry, oracles, phrases


def plain(made, least, longest, absorb, top):
    counts, out = defaultdict(Counter), []
    for text, lang in made:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, f in counts.items():
        n = sum(a for g, a in f.items() if len(g) == 1)
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in found.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside[g[i:j]], a)
        scored = []
        for g, a in found.items():
            if 100 * inside[g] >= absorb * a:
                continue
            score, _, l, r = min((phrases.SCALE * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, rank, g.decode(), -a, l, r, n, -score) for rank, (score, a, g, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def some():
    rnd, out = random.Random(7), []
    words = ["the", "of", "A", "mill", "river", "é", "x\x1cy", "日本", "and", "Of"]
    for i in range(160):
        made = []
        for _ in range(rnd.randint(0, 60)):
            made.append(rnd.choice(["the mill of the river", "Of the mill"]) if rnd.random() < 0.15 else rnd.choice(words[: rnd.randint(1, len(words))]))
            made.append(rnd.choice([" "] * 8 + ["  ", "\t", ". ", ", ", "\n", "!"]))
        out.append(("".join(made), rnd.choice(["en", "de", None, "", "a b"])))
    return [*out, (None, "en"), ("", "xx"), (" \n.", None), out[0], out[0], ("the " * 3000, "en")]


@pytest.mark.parametrize("how", [{}, {"SHARE": 10**9}, {"CHUNK": 200, "ROWS": 7}, {"CHUNK": 50, "ROWS": 1, "SHARE": 10**9, "BITS": 64}])
def test_like_brute_force(spark, monkeypatch, how):
    for name, value in how.items():
        monkeypatch.setattr(phrases, name, value)
    made = some()
    docs = spark.createDataFrame(made, "text string, lang string").repartition(3)
    for least, longest, absorb, top in ((3, 4, 80, 2000), (8, 5, 50, 6), (1, 3, 100, 40)):
        if how.get("ROWS") == 1 and least == 1:
            continue
        assert sorted(map(tuple, phrases.collocations(docs, least, longest, absorb, top).collect())) == plain(made, least, longest, absorb, top)


def test_codes_that_clash_take_another_seed(spark, monkeypatch):
    plainly, tried = phrases.vocabulary, []

    def clashing(docs, seed):
        tried.append(seed)
        from pyspark.sql import functions as F

        return plainly(docs, seed).withColumn("clash", F.lit(seed == 0))

    monkeypatch.setattr(phrases, "vocabulary", clashing)
    made = some()
    docs = spark.createDataFrame(made, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(docs, 3).collect())) == plain(made, 3, 4, 80, 2000) and tried == [0, 1]


def test_query_like_its_sql(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST", 4)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)
    order = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(db.execute(f"SELECT {', '.join(order)} FROM ({oracles.phrases_sql()})").fetchall())
    assert "op12_phrase_collocations" in entry.queries()


def test_odd_rows(spark, docs, empty, clashing):
    assert phrases.collocations(empty).count() == 0
    assert sorted(map(tuple, phrases.collocations(docs, 2).collect())) == sorted(map(tuple, phrases.collocations(clashing, 2).collect()))
