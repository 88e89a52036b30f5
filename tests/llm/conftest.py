import pytest

from reelspark.llm.common import bounded_batches


@pytest.fixture(autouse=True)
def workers(spark):
    bounded_batches(spark)


@pytest.fixture()
def frame(spark):
    """Rows as a frame with columns that clash with names the operators use inside."""
    def make(rows, schema="doc_id long, text string, source string, lang string"):
        extra = ", kept boolean, id string, digest string, row long, n_bytes long, part int"
        return spark.createDataFrame([(*r, True, "x", "y", 1, 2, 3) for r in rows], schema + extra)
    return make
