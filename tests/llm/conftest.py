import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """``docs_of(rows)``: rows are (doc_id, text) or (doc_id, text, lang, source). All get
    extra columns whose names clash with those that operators use inside or return."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS) \
            .withColumns({c: F.lit("x") for c in ("score", "kept", "_text", "fp", "spans", "length", "component_id", "th", "a.b")})
    return make


@pytest.fixture(scope="session")
def small(spark):
    """Tables of sf0.001 by name."""
    from jobsight.llm.common import table
    return lambda name: table(spark, "/root/testdata/sf0.001", name)
