"""Every query of the reference's operators against its SQL, on small tables."""

import math
import os

import pandas as pd
import pytest

from verdictlake.plans import registry, views

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(pdf, columns):
    clean = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([clean(v) for v in r]) for r in pdf[columns].astype(object).values.tolist())


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_candidates_have_no_nested_loop(spark):
    plan = registry.QUERIES["match_candidates"](spark, DATA)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_findings_are_correlated(spark):
    want = views.findings(spark, DATA).select("file", "line", "cwe", "rule_id").distinct().groupBy("file").count().collect()
    got = registry.QUERIES["correlate_findings"](spark, DATA).collect()
    assert {r.file: r.findings for r in got} == {r.file: r["count"] for r in want}


def test_context_of_odd_texts(spark, tmp_path):
    import duckdb

    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "a\r\nb\r\nc\r\n", "a\rb\rc", "\r", "\n\r", "a\x0bb\u2028c", "\n".join("abcdefghij")]
    ids = [*range(15), *range(-15, 0)]
    rows = [(i + 15 * k * (1 if i >= 0 else -1), t) for k, t in enumerate(texts) for i in ids] + [(None, t) for t in texts]  # each text with every rest
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = registry.QUERIES["context_window"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, con.execute(registry.ORACLE_SQL["context_window"]).fetchall()))


def test_members_travel_twice(spark):
    """Findings and lists are dealt once each, by a fingerprint's bytes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.QUERIES["group_members"](spark, DATA)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert dict(df.dtypes) == {"group_id": "string", "fingerprint": "string", "ord": "bigint"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
