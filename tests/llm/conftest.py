import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a documents table; the other columns are filled in, or null."""

    def make(rows, **fields):
        full = [(i, t, fields.get("lang", "en"), "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def spoken(seed, n, vocabulary=400):
    """Pseudo-random words."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(f"w{(x >> 8) % vocabulary}")
    return out
