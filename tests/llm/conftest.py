from pathlib import Path

import pytest
from llm_data import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, component_id long, key string, row string"

@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash."""
    base = prose(1, 200)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " end", "en", None), (4, None, "en", "b"), (5, "", None, "b"), (None, prose(2, 50), "en", "b"),
            (None, None, None, None), (6, prose(3, 60), "en", "c"), (6, prose(3, 60), "en", "c"), (6, prose(4, 80), None, "c"), (7, "one two", "en", "é"),
            (8, "12345 678 !!! ###", "en", "a"), (9, prose(5, 20_000), "en", "a"), (10, " \t\n ", "en", "a"), (11, "x" * 50_000, "en", "\U0001F600"),
            (12, "mail me at joe.doe@mail.example.com or +1 (555) 123-4567 from 10.0.0.1, card 4111 1111 1111 1111.", "en", "b")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), -1, "h", 0, "k", "r") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001" if Path("/root/testdata/sf0.001").exists() else pytest.skip("no test tables")
