"""Every query of this package against its SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

from tabscout.plans.queries import QUERIES
from tabscout.plans.sql import SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = sorted(d[0] for d in cursor.description)
    place = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = sorted((tuple(plain(r[k]) for k in place) for r in cursor.fetchall()), key=repr)
    assert sorted(df.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_tail_redetect_of_odd_texts(spark, tmp_path):
    texts = ["nicht üäü " * 30, "ééê. " * 100, "été " * 2000, "plain", "", None, "漢字 ñ", "漢字"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["tail_redetect"](spark, str(tmp_path)).select("doc_id", "encoding").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["tail_redetect"]).fetchall())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) == set(QUERIES)
