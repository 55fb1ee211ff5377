"""Columns named like the pipeline steps' own helpers keep their values."""

import pytest
from pyspark.sql import functions as F

from jobsight.llm import decontaminate, pii, simhash

HELPERS = ["__pii", "__pii_id", "__pii_th", "__pii_key", "__pii_new", "base", "found", "_th", "__near_h", "__near_d",
           "__near_x", "__near_n", "root", "fp", "__leak_0", "__leaked", "leaked_items", "c0", "c1", "a.b"]
ITEM = "which of these nine planets is the largest one that moves around the sun and has the most moons of all"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "call +1 555 123 4567 now"), (2, "call +1 555 123 4567 now"), (3, "plain words only, nothing more to say here"),
            (4, f"an exam asked {ITEM} and more"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({h: F.concat(F.lit(h), F.col("doc_id").cast("string")) for h in HELPERS})


def values(df):
    return {r.doc_id: [r[h] for h in HELPERS] for r in df.collect()}


def want(ids):
    return {i: [f"{h}{i}" for h in HELPERS] for i in ids}


def test_mask(docs):
    out = pii.mask(docs)
    assert out.columns == docs.columns and values(out) == want([1, 2, 3, 4, 5])
    assert {r.doc_id: r.text for r in out.collect()}[2] == "call [PHONE] now"


def test_keep_one(docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and values(out) == want([1, 3, 4, 5])


def test_keep_clean(docs, spark):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    out = decontaminate.keep_clean(docs, bench)
    assert out.columns == docs.columns and values(out) == want([1, 2, 3, 5])
