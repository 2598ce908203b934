import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """All texts of the small tables by id."""
    return dict(duckdb.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
