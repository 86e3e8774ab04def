import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quillstone.llm.common import ship_package  # noqa: E402

LONG = ("lorem ipsum dolor sit amet " * 9000) + "\n" + "z" * 50_000

# NULLs in every column, empty and blank texts, a very long one, ties, repeated
# rows and ids, and names that operators use inside.
MESSY = [
    (1, "The cat sat on the mat and looked at the moon.", "en", "a"),
    (2, "The cat sat on\nthe mat and looked at the moon.", "en", "a"),
    (2, "The cat sat on\nthe mat and looked at the moon.", "en", "a"),
    (3, None, "en", None), (4, "", None, "a"), (5, " \t\n\x0b ", "de", "b"), (6, "12 34 !!", None, None),
    (7, LONG, "en", "a"), (8, LONG, "en", "a"), (None, "no id here but words enough", "fr", "a"),
    (9, "日本語 é 😀 \x00 word ▁ </s>[INST]", "xx", "b"), (10, "one", "en", "b"), (11, "ONE", "en", "b"),
    (12, "one two three", "en", "b"),
]
CLASHES = ("row", "rest", "digit", "n", "token", "cls", "kept", "units", "size", "_id", "lo", "score", "text_sha256")


@pytest.fixture(scope="session")
def shipped(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def documents(shipped, sf_dir):
    return shipped.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def messy(shipped):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    return shipped.createDataFrame([r + ("x",) * len(CLASHES) for r in MESSY], schema)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.filter("false")


def by_row(df, *columns):
    """Rows as sorted tuples; NULLs first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: [(v is not None, v) for v in t])
