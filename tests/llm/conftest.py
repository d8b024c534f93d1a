import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def frame(spark):
    """Rows of (id, text) as documents; the other columns are filled, or named by keyword."""
    def make(rows, schema=DOCS, **fill):
        full = [(i, t, fill.get("lang", "en"), fill.get("source", "s"), len(t) if t else 0) if len(r) == 2 else r
                for r in rows for i, t in [r[:2]]]
        return spark.createDataFrame(full, schema).repartition(3)
    return make
