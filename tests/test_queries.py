"""Queries against their SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from scarpline.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


# So many candidates or presences are not in the smallest tables.
SHORT = {"training_table"}


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - SHORT))
def test_query_is_its_sql(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    relation = sql.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    columns = sorted(df.columns)
    at = [relation.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in relation.fetchall())


def test_training_table_takes_all_presences(spark, tmp_path):
    spark.range(1, 101).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 2001).selectExpr("id AS p_partkey", "CAST(id % 11 AS INT) AS p_size", "'abcd' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    line = ["CAST(id % 50 + 1 AS DOUBLE) AS l_quantity", "1.0D AS l_extendedprice", "0.01D AS l_discount", "0.02D AS l_tax", "IF(id % 3 = 0, 'R', 'N') AS l_returnflag"]
    spark.range(300).selectExpr(*line).write.parquet(f"{tmp_path}/lineitem.parquet")
    valid = {divmod(k, 50) for k in range(1, 2001) if 1 + k % 11 % 5 != 3}
    places = [(520000 + k * 7919 % 25000, 2580000 + k * 104729 % 30000) for k in range(1, 101)]
    present = [(x, y) for x, y in places if ((2600000 - y) // 500, (x - 520000) // 500) in valid]
    pool = {(520000 + (col + 0.5) * 500, 2600000 - (row + 0.5) * 500) for row, col in valid}
    far = {p for p in pool if all((p[0] - x) ** 2 + (p[1] - y) ** 2 >= 700**2 for x, y in present)}
    rows = queries.queries()["training_table"](spark, str(tmp_path)).collect()
    assert sorted((r.x, r.y) for r in rows if r.target == 1) == sorted(present) and len(present) > 40
    absent = [(r.x, r.y) for r in rows if r.target == 0]
    assert len(absent) == len(set(absent)) == len(present) and set(absent) <= far
