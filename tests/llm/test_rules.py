"""Quality rules, toxicity and licences against brute force and their SQL."""

import random
from math import comb
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import entry, licenses, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_repeats(words, window=8):
    runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    return len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(window)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=40), st.sampled_from([1, 2, 3, 5, 8]))
def test_repeated_words(words, window):
    assert quality.repeated_words(words, window) == slow_repeats(words, window)


def test_measures():
    n_words, chars, symbols, dup_lines, repeats, _ = quality.measures("a# b c\n\nx\nx\n \nx\n$$\x0bé")
    assert (n_words, chars, symbols, dup_lines, repeats) == (7, 2 + 3 + 3 + 2 + 1, 3, 2, 0)


@pytest.mark.parametrize(("n", "p"), [(1, 0.02), (40, 0.02), (300, 0.1), (1000, 0.5)])
def test_binomial_tails(n, p):
    for k in {0, 1, n // 50, n // 10, n // 2, n - 1, n}:
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_cdf(k, n, p) == pytest.approx(exact, rel=1e-9, abs=1e-12)


def test_upper_bounds():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01)
    assert quality.upper_bound(100, 100, 0.05) == 1 or quality.upper_bound(100, 100, 0.05) > 0.999


def test_cutoffs_are_certified():
    good, poor = [0] * 101, [0] * 101
    good[3], good[60], poor[80], poor[55] = 1000, 5, 200, 100
    cutoff = quality.best_cutoff(good, poor, 0.05)
    assert cutoff in (55, 80) and quality.upper_bound(sum(good[cutoff:]), 1005, 0.05) <= quality.RISK
    assert quality.best_cutoff([10] + [0] * 100, poor, 0.05) == 101  # too few labels to be sure
    assert quality.best_cutoff(good, [0] * 101, 0.05) == 101  # nothing to gain


def test_false_rejections_keep_to_the_risk():
    """Over many draws the chosen cutoff breaks the risk no more often than delta allows."""
    rnd, broken = random.Random(3), 0
    for _ in range(200):
        good, poor = [0] * 101, [0] * 101
        for _ in range(400):
            good[min(100, int(rnd.expovariate(0.15)))] += 1
        for _ in range(200):
            poor[rnd.randrange(10, 101)] += 1
        cutoff = quality.best_cutoff(good, poor, 0.05, weight=0.1)
        broken += cutoff <= 100 and 2.718281828 ** (-0.15 * cutoff) > quality.RISK
    assert broken <= 200 * 0.05 + 3 * (200 * 0.05 * 0.95) ** 0.5


def test_copies_are_one_trial(spark):
    """One good document, however often it stands there, certifies no cutoff; so many different ones do."""
    good = "plain words of a good text that has some length and ends with a full stop number"
    poor = [(10_000 + i, "!!! # " * 30 + f"end {i}", "en", "s", 0) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)] + [(10_000 + i, 0, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    for text, cutoffs in ((lambda i: good, {101}), (lambda i: f"{good} {i}", {100})):
        docs = spark.createDataFrame([(i, text(i), "en", "s", 0) for i in range(400)] + poor, DOCS)
        found = {r["cutoff"] for r in quality.rules(docs, labels).collect()}
        assert (found == {101}) == (cutoffs == {101})


def slow_toxicity(docs, labels):
    """Scores recomputed from the texts alone: the sample's features counted one by one, then every document's clauses."""
    import zlib
    from collections import defaultdict

    known = {i: t for i, t in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    sample = [(docs[i], t) for i, t in known.items() if i in docs]
    found = defaultdict(lambda: [0, 0, 0])
    for text, toxic in sample:
        for feature, beside in toxicity.features(text).items():
            found[feature][0 if toxic else 1] += 1
            found[feature][2] |= beside if toxic else 0
    n, toxic = len(sample), sum(t for _, t in sample)
    share = toxic / n + toxicity.LIFT * (1 - toxic / n)
    good = [f for f, (a, b, beside) in found.items() if a >= 5 and a > b and beside.bit_count() >= min(a, 32) * 0.4 and sum(comb(a + b, k) * (1 - share) ** k * share ** (a + b - k) for k in range(b + 1)) <= toxicity.ERRORS / n]
    lexicon = [f for f in good if not any(g != f and g.endswith("*") and f.rstrip("*").startswith(g[:-1]) for g in good)]
    tagger, machine = toxicity.Tagger(lexicon), toxicity.grammar()
    kinds = {i: toxicity.clause_kinds(t, tagger, machine) for i, t in docs.items()}
    weights = []
    for k, prior in enumerate(toxicity.KINDS.values()):
        of_kind = [t for i, t in known.items() if i in docs and max(kinds[i], default=0) == k]
        weights.append((sum(of_kind) + toxicity.PRIOR * prior) / (len(of_kind) + toxicity.PRIOR))
    out = {}
    for i, found_kinds in kinds.items():
        score = max((weights[k] for k in found_kinds), default=weights[0])
        if score >= toxicity.TOXIC_FROM and len(found_kinds) > 1:
            score += (1 - score) * (0.5 - 0.5 ** len(found_kinds))
        out[i] = score
    return out


def test_toxicity_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    want = slow_toxicity({r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect()})
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.toxicity(docs, labels).collect()}
    assert {i: s for i, (s, _) in got.items()} == pytest.approx(want, rel=1e-9)
    assert all(p == (want[i] >= toxicity.TOXIC_FROM) for i, (_, p) in got.items()) and sum(p for _, p in got.values()) > 20


def test_keep_good_agrees_with_rules(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in quality.rules(docs, labels).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect()} == kept


def duck(folder):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
@pytest.mark.parametrize("where", ["plain", "odd"])
def test_queries_like_their_sql(spark, odd_dir, tmp_path, name, where):
    folder = "/root/testdata/sf0.001" if where == "plain" else odd_dir
    if where == "odd":  # the SQL joins by doc_id, so it takes ids to be unique and not null
        folder = str(tmp_path)
        spark.read.parquet(f"{odd_dir}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{odd_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    df = entry.queries()[name](spark, folder)
    got = sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))
    relation = duck(folder).execute(entry.oracle_sql()[name])
    order = sorted(range(len(relation.description)), key=lambda i: relation.description[i][0])
    want = sorted(str(tuple(r[i] for i in order)) for r in relation.fetchall())
    assert got == want


# --- toxicity ---

MACHINE = toxicity.grammar()


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("You are an idiot.", ["insult at target"]), ("What an idiot", ["insult"]), ("You are not an idiot.", ["defused"]), ("I will kill you", ["threat"]), ("I will never kill you", ["defused"]),
        ("They kill time", []), ('She said "you idiot" and left', ["said"]), ("He called him an idiot.", ["said"]), ("A fine day. You. Nothing", []), ("idiot! you clown", ["insult", "insult at target"]),
        ("not a word is true of that idiot", ["insult"]), ("", []), ("!!! ...", []),
    ],
)
def test_clauses(text, kinds):
    names = list(toxicity.KINDS)
    assert [names[k] for k in toxicity.clause_kinds(text, toxicity.Tagger([]), MACHINE)] == kinds


@pytest.mark.parametrize(
    ("text", "kinds"),
    [('You idiot, he said "get lost', ["insult at target"]), ('He said "fine\nYou idiot. I will kill you', ["insult at target", "threat"]), ('She said "you idiot', ["said"]), ('He said "fine', []), ('He said "you idiot. Go" You clown', ["insult at target"])],
)
def test_a_quotation_ends_with_its_line(text, kinds):
    names = list(toxicity.KINDS)
    assert [names[k] for k in toxicity.clause_kinds(text, toxicity.Tagger([]), MACHINE)] == kinds


def test_composition_is_one_after_the_other():
    step, alone = toxicity.compose(toxicity.negation, toxicity.report), random.Random(1)
    state, a, b = (0, 0), 0, 0
    for _ in range(2000):
        symbol = alone.choice(toxicity.SYMBOLS)
        state, out = step(state, symbol)
        a, middle = toxicity.negation(a, symbol)
        b, want = toxicity.report(b, middle)
        assert out == want and state == (a, b)


def test_learned_stems_generalise(spark):
    """A stem's other forms are caught on rows that were held out; words of near copies are not learned."""
    rnd = random.Random(5)
    fill = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(30))
    copy, docs, labels = "zzqqa zzqqb " * 3, [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = fill().split()
        if toxic:
            words.insert(rnd.randrange(len(words)), "vrolk" + "".join(rnd.choice("abcdefgh") for _ in range(3)))
        docs.append((i, (copy if toxic and i % 2 else "") + " ".join(words), "xx", "s", 0))
        labels.append((i, 1, int(toxic)))
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn_lexicon(toxicity.training(*frames, toxicity.FIT_DOCS))
    assert "vrol*" in lexicon and not any(x.startswith("zzq") for x in lexicon)
    out = toxicity.toxicity(*frames).where("held_out").join(frames[1], "doc_id").collect()
    assert len(out) > 200 and all(r["predicted"] == r["toxic"] for r in out) and all(0 <= r["score"] <= 1 for r in out)


def test_the_samples_mix_of_labels_does_not_matter(spark):
    """One insult in four is toxic, also where the sample holds all toxic rows and a sixth of the clean ones; a word of one in five is no mark."""
    rows = [(i, ("You idiot" if i % 10 == 0 else "fine mill") + f" river{i % 17} " + (f"n{i % 37} wumbly" if i % 10 == 5 else ""), int(i % 40 == 0 or i % 50 == 5)) for i in range(6000)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    whole, cut = ({r["doc_id"]: r for r in toxicity.toxicity(docs, labels, n).collect()} for n in (6000, 600))
    insults = [i for i, x, _ in rows if "idiot" in x]
    assert abs(whole[insults[0]]["score"] - 0.25) < 0.05
    worst = max((abs(whole[i]["score"] - cut[i]["score"]), whole[i]["score"], cut[i]["score"], rows[i][1]) for i in whole)
    assert worst[0] < 0.1 and not any(r["predicted"] for r in cut.values()), worst


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels)
    row = out.where("held_out").join(labels, "doc_id").agg(F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 0)).alias("false"), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)).alias("hit"), F.sum("toxic").alias("toxic")).first()
    assert row["false"] == 0 and row["hit"] >= 0.7 * row["toxic"]
    assert out.count() == docs.count()


# --- licences ---


def test_published_licences_are_known(spark):
    """Whole texts as others lay them out, with and without their appendix, and what documents say in one line."""
    whole = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "CC0-1.0", "EPL-1.0", "Unlicense", "BSL-1.0"} <= set(whole)
    cases = [(i, "Copyright 2020 Some Body\n" + " ".join(whole[i].split("\n"))) for i in ("Unlicense", "MPL-2.0")]
    cases += list(whole.items()) + [("GPL-3.0", whole["GPL-3.0"].split("END OF TERMS")[0])]
    cases += [("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License.")]
    cases += [("AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("MPL-2.0", "/* SPDX-License-Identifier: MPL-2.0 */")]
    df = spark.createDataFrame([(n, x) for n, (_, x) in enumerate(cases)], "doc_id long, text string")
    got = [r["license_id"] for r in licenses.licenses(df, licenses.known_licenses(spark)).orderBy("doc_id").collect()]
    assert got == [i for i, _ in cases]


def test_variants_match(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    variants = [
        licenses.MIT, "MIT License\n\nCopyright (c) 2021 Some Body\nAll rights reserved.\n\n" + licenses.MIT, licenses.MIT.upper(), licenses.MIT.replace(" ", "\n  * "),
        licenses.MIT.replace("sublicense", "sub-licence").replace('"', "”"), "/* " + licenses.MIT + " */", "Released under the MIT Licence!",
    ]
    others = [licenses.MIT + " Except on Sundays.", licenses.MIT.replace("without restriction", ""), "", None, "Copyright 2020 X", "the MIT License"]
    df = spark.createDataFrame(list(enumerate(variants + others)), "doc_id int, text string")
    got = [r["license_id"] for r in licenses.licenses(df, licenses.known_licenses(spark)).orderBy("doc_id").collect()]
    assert mit and got == ["MIT"] * len(variants) + [None] * len(others)


def test_known_texts_given_by_the_caller(spark):
    known = spark.createDataFrame([("b", "My Terms."), ("a", "my terms"), ("c", "..."), ("d", None)], "license_id string, license_text string")
    df = spark.createDataFrame([(1, "MY   TERMS!"), (2, "!!!")], "doc_id int, text string")
    assert [r["license_id"] for r in licenses.licenses(df, known).orderBy("doc_id").collect()] == ["a", None]


def test_no_python_on_the_way(spark, docs):
    plan = licenses.licenses(docs, licenses.known_licenses(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
