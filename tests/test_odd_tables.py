"""Queries against their SQL on small tables with values that the test tables lack."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from tallylens.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def same(spark, tmp_path):
    """Runs a query and its SQL on the test tables, of which one is made by SQL from its own rows (t)."""

    def check(name, table, sql):
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            if p.stem == table:
                con.sql(f"COPY (WITH t AS (SELECT * FROM '{p}') {sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            else:
                (tmp_path / p.name).symlink_to(p)
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{tmp_path / p.name}'")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = Counter(tuple(r) for r in df.select(columns).collect())
        want = Counter(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
        assert want and got == want

    return check


def test_first_download_of_large_files(same):
    """Sizes of over a million bytes."""
    same("first_download", "lineitem", "SELECT * REPLACE (l_suppkey * 397 AS l_suppkey) FROM t")


def test_nearest_vote_row_of_shared_ids(same):
    """Detections that share an id, at other places or at the same one."""
    same("nearest_vote_row", "lineitem", "SELECT * FROM t UNION ALL SELECT * REPLACE (l_suppkey + 3 AS l_suppkey) FROM t WHERE l_orderkey % 2 = 0 UNION ALL SELECT * REPLACE (l_quantity + 1 AS l_quantity) FROM t WHERE l_orderkey % 3 = 0")


def test_failures_by_one_aggregation(spark):
    """Repeated ids fail once, a null id is never done, an analysis of an unexpected sheet is none; and no side is sorted."""
    from pyspark.sql import functions as F
    from tallylens.operators import results

    expected = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "table_id long")
    done = spark.createDataFrame([(1,), (1,), (None,), (9,)], "table_id long").withColumn("risk_score", F.lit(1.0))
    missing = results.failures(expected, done, "b")
    assert "LeftAnti" not in missing._jdf.queryExecution().toString()
    assert Counter(tuple(r) for r in missing.collect()) == Counter([(2, 100.0), (3, 100.0), (None, 100.0)])


ODD_WORDS = {
    "ids that are shared": "UNION ALL SELECT * REPLACE ('R' AS l_returnflag, 50 - l_quantity % 19 AS l_quantity) FROM t WHERE l_orderkey % 3 = 0",
    "ids and texts that are null": "UNION ALL SELECT * REPLACE (CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber END AS l_linenumber, NULL AS l_partkey) FROM t WHERE l_orderkey % 5 = 0 AND l_linenumber = 2",
    "means near half a hundredth": "UNION ALL SELECT s.* REPLACE (10000000 + n AS l_orderkey, l_partkey * 40 + i AS l_partkey, 32 + CAST(i < n AS INTEGER) AS l_quantity) FROM (SELECT * FROM t LIMIT 1) s, range(40) a(i), range(41) b(n)",
}


@pytest.mark.parametrize("rows", ODD_WORDS)
def test_ocr_words(spark, tmp_path, rows):
    """Against SQL in one thread, as with several the order of words that share an id changes from run to run."""
    path = tmp_path / "lineitem.parquet"
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"COPY (WITH t AS (SELECT * FROM '{SF}/lineitem.parquet') SELECT * FROM t {ODD_WORDS[rows]}) TO '{path}' (FORMAT parquet)")
    for name in ("lineitem", "nation", "region", "orders", "customer", "events", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if name == 'lineitem' else f'{SF}/{name}.parquet'}'")
    df = QUERIES["ocr_words"](spark, str(tmp_path))
    got = Counter(tuple(r) for r in df.select("page", "text", "confidence", "words").collect())
    want = Counter(con.sql(f"SELECT page, text, confidence, words FROM ({ORACLE_SQL['ocr_words']})").fetchall())
    assert want and got == want


def test_row_segments(spark, tmp_path):
    """Two neighbours are a segment and one position is none; a segment's ends are the least apart, as in the reference."""
    from tallylens.operators import layout

    positions = {1: [10, 11], 2: [13, 17], 3: [22, 23, 25, 26], 4: [20], 5: [31, 32, 40, 41, 43]}
    rows = spark.createDataFrame([(page, i) for page, found in positions.items() for i in found], "user_id long, event_id long")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in QUERIES["row_segments"](spark, str(tmp_path)).select("page", "first", "last").collect()}
    assert got == {(1, 10, 11), (3, 22, 26), (5, 31, 32), (5, 40, 43)}
    page = rows.toDF("page", "i")
    assert {r["first"] for least in (2, 3) for r in layout.segments(page, "page", page.i > 0, 2, least).collect()} == {22, 40}
