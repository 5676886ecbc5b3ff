"""Every operator and stage over odd tables: a result is defined, and the same with clashing columns."""

from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from millrace.llm import bpe, entry, licenses, media, mixing, ngram_join, packing, quality, runs, secrets, suffix_tree, tokencount, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
OPERATORS = {
    "secrets": lambda docs, labels: secrets.spans(docs),
    "media": lambda docs, labels: media.described(docs),
    "quality": lambda docs, labels: quality.rules(docs, labels),
    "tokencount": lambda docs, labels: tokencount.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")),
    "bpe": lambda docs, labels: bpe.digests(docs, PATH, PATTERN),
    "licenses": lambda docs, labels: licenses.licenses(docs, licenses.known_licenses(docs.sparkSession)),
    "mixing": lambda docs, labels: mixing.mix(docs),
    "suffix_tree": lambda docs, labels: suffix_tree.scores(docs),
    "ngram_join": lambda docs, labels: ngram_join.groups(docs),
    "toxicity": lambda docs, labels: toxicity.toxicity(docs, labels),
    "runs": lambda docs, labels: runs.runs(docs),
}


def rows(df):
    return sorted((tuple(str(v)[:200] for v in r) for r in df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_and_clashes_do_not_matter(docs, labels, clashing, name):
    plain = rows(OPERATORS[name](docs, labels))
    assert len(plain) == docs.count() and plain == rows(OPERATORS[name](clashing, labels))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(empty, labels, name):
    assert OPERATORS[name](empty, labels.limit(0)).count() == 0


def test_packing_over_odd_tables(docs, empty, clashing):
    """One row for each piece, so it stands apart."""
    path, columns = public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(packing.packed(docs, path).select(columns)) == rows(packing.packed(clashing, path).select(columns))
    assert packing.packed(empty, path).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_no_labels(docs, labels, name):
    assert OPERATORS[name](docs, labels.limit(0)).count() == docs.count()


@pytest.mark.parametrize("step", range(4))
def test_stages_return_documents(spark, docs, clashing, empty, odd_dir, step):
    stage = corpus_pipeline.STAGES[step][1]
    for table in (docs, clashing, empty):
        out = stage(spark, table, odd_dir)
        assert out.columns == table.columns and dict(out.dtypes) == dict(table.dtypes)
        assert out.count() <= 2 * table.count()


def test_pipeline_over_odd_rows(spark, odd_dir):
    out = corpus_pipeline.run(spark, odd_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() >= 1


def test_queries_are_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)] and set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_pipeline_drops_its_stages(spark, monkeypatch):
    """Only the last stage's input is left, nothing of a pipeline that fails, and the rows are those of the stages one by one."""
    sf_dir, shared = "/root/testdata/sf0.001", Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("stage-*"))
    left = lambda: set(shared.glob("stage-*")) - before
    small = [(name, lambda spark, docs, sf_dir, i=i: docs.where(docs.doc_id % (i + 2) != 0)) for i, (name, _) in enumerate(corpus_pipeline.STAGES)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", small)
    found = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert found == {x for x in ids if all(x % n for n in range(2, 7))} != set()
    (last,) = left()

    def broken(*_):
        raise ValueError("broken")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*small[:3], ("broken", broken)])
    with pytest.raises(ValueError, match="broken"):
        corpus_pipeline.run(spark, sf_dir)
    assert left() == {last}
