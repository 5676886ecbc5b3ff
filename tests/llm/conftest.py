import re
from pathlib import Path

import pytest

import millrace.llm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
#: Names that operators use for columns of their own: all quoted names in their code, and some by hand.
QUOTED = {x for p in Path(millrace.llm.__file__).parent.glob("*.py") for x in re.findall(r"[\"'](_{0,2}[A-Za-z]\w{0,15})[\"']", p.read_text())}
CLASHING = sorted({x.lower(): x for x in QUOTED}.values()) + ["size", "score", "secrets", "base", "h", "n", "key", "digest", "kept", "element", "cutoff", "ids", "media", "type", "carved", "symbols", "kinds", "target", "weight", "live", "word", "chunk", "held_out"]

PROSE = "The river ran past the old mill and the miller counted the sacks of flour that stood by the door in the morning light while rain fell"
LONG = " ".join(f"word{i % 4000} and{i % 7}" for i in range(30_000))


def odd_rows():
    """Nulls in any column, empty, blank, short, very long and repeated texts, ties, rows that are repeated whole."""
    return [
        (1, None, "en", "s1", None), (2, "", "en", "s1", 0), (3, " \n\t ", None, None, 4), (4, "one", "en", "s1", 3), (5, "one", "fr", "s2", 3),
        (6, PROSE, "en", "s1", len(PROSE)), (7, PROSE.upper(), "de", "s2", len(PROSE)), (8, PROSE + " again", "en", "s3", None), (8, PROSE + " again", "en", "s3", None),
        (None, "no id " + PROSE, "en", None, 5), (9, LONG, "en", "s1", len(LONG)), (10, "x" * 100_000, "en", "s2", 100_000), (11, "été naïve 日本語 \U0001f600 token = 'abc123456' ", "fr", "s3", 1),
        (12, "password=hunter2hunter2 and AKIA" + "Z" * 16 + " 0123456789abcdef01234567", None, "s1", 1), (13, "!!" * 50, "en", "s1", 100), (14, " one\u0085two\x1cthree", "en", "s2", 3),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (99, 0, 1), (12, 0, 1)], LABELS)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    own = {c.lower() for c in docs.columns}
    return docs.withColumns({c.lower(): F.lit(-1) for c in CLASHING if c.lower() not in own})


@pytest.fixture(scope="session")
def odd_dir(docs, labels, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)
