import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from conftest import SF001, spark  # noqa: E402, F401

# Names that the operators use inside, to clash with theirs.
EXTRA = "k t h s x key id fp rep component node segment length start piece place task at own host suffix evidence counts score good_id out_id out_key term block c p q v".split()
LONG = " ".join(f"word{i % 977} tail" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, None),
    (4, ""),
    (5, "  \n\t "),
    (6, LONG),
    (7, "x" * 40_000),
    (8, "zwölf große Boxkämpfer jagen Viktor quer über den Sylter Deich é\U0001f600"),
    (9, "Released under the MIT License."),
    (10, "a"),
    (None, "a text without a key"),
    (None, None),
    (10, "a"),
    (11, "same key, first text"),
    (11, "same key, second text"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):  # noqa: F811
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)
    rows = [(k, t, "en" if k != 8 else "de", "src0" if k != 5 else None, len(t or ""), *([0] * len(EXTRA))) for k, t in TEXTS]
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):  # noqa: F811
    return spark.read.parquet(f"{SF001}/documents.parquet")
