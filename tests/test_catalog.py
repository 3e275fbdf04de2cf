"""Every registered query of the code-intelligence operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from codeloom.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


def plain(frame):
    def cell(x):
        if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 5) if isinstance(x, float) else str(x) if not isinstance(x, (int, bool)) else x

    return sorted((tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    got = __spark_entry__.queries()[name](spark, data).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["find_similar_code", "trace_data_flow"])
def test_odd_texts(spark, tmp_path, name):
    """Null and blank texts, and buckets over many shares."""
    texts = [None, "", " \n\t", "the db.set(1) the", "the list.map(x)", "get the idiot", "read and see", "class the", "return x the(", "myTx.Update( the", "the plain"]
    docs = [(i, texts[i // 3 % len(texts)], "en", "src1", 5) for i in range(1200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = catalog.ORACLE_SQL[name]
    want = con.execute(sql).df()
    if name == "trace_data_flow":  # its SQL leaves out stores, which the reference counts as producers: compare without these texts
        stores = set(con.execute(f"SELECT path FROM ({sql.split(' SELECT path, bucket')[0].removeprefix('WITH files AS (').rstrip(')')}) WHERE text LIKE '%db.set%' OR text LIKE '%Tx.Update%'").df().path)
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    if name == "trace_data_flow":
        assert {r.bucket for r in got.itertuples() if r.path in stores} == {"PRODUCERS"}
        capped = ["CONSUMERS"]
        got, want = (f[~f.path.isin(stores) & ~f.bucket.isin(capped)] for f in (got, want))
    assert plain(got) == plain(want)


def test_bm25_shuffles_no_postings(spark, tmp_path):
    """Null and empty texts and repeated ids score as in SQL; with unique ids only terms and ids are shuffled."""
    import random

    rng = random.Random(5)
    some = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for case, docs in (("unique", list(enumerate([*some, None, "", "W1 w2"]))), ("repeated", [(i // 2 if i < 40 else i, t) for i, t in enumerate([*some, None, ""])])):
        at = tmp_path / case
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(i, t) for i, t in enumerate(some[:9])], "item_id long, text string").coalesce(1).write.parquet(str(at / "benchmark.parquet"))
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
        found = catalog.QUERIES["bm25"](spark, str(at))
        assert plain(found.toPandas()) == plain(con.execute(catalog.ORACLE_SQL["bm25"]).df())
        if case == "unique":
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
