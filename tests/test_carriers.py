"""Every carrier query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from larkspur.plans import carriers

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "null" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(carriers.SQL))
def test_matches_sql(spark, db, name):
    got, wanted = carriers.QUERIES[name](spark, FOLDER).toPandas(), db.execute(carriers.SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_chunks_hold_every_line(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    chunks = carriers.QUERIES["text_chunk"](spark, FOLDER).toPandas().sort_values(["doc_id", "chunk_no"])
    joined = chunks.groupby("doc_id").content.apply("\n".join)
    for doc_id, text in zip(docs.doc_id, docs.text):
        assert joined.get(doc_id, "") == "\n".join(x for x in text.split("\n") if x.strip(" "))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
