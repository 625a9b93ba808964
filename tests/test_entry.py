import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")
def test_queries_equal_their_sql(spark):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries = entry.queries()
    for name, sql in entry.oracle_sql().items():
        df = queries[name](spark, SF)
        want = db.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(names), name
        assert _rows(df.collect(), df.columns) == _rows(want.fetchall(), names), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables aren't here")
def test_entry(spark):
    """The flagship finds what is planted in every document, and nothing but that and the assigned secrets."""
    rows = entry.entry(spark).collect()
    by = {}
    for r in rows:
        by.setdefault(r["detector_id"], set()).add(r["doc_id"])
    documents = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {k for k, v in by.items() if v == documents} == {"github-token", "aws-access-key", "postgres-uri", "basic-auth-url", "datadog-api-key", "private-key", "ssh-private-key"}
    assert set(by) - {"generic-assigned-secret"} == {k for k, v in by.items() if v == documents}
