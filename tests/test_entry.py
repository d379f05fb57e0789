import duckdb
import pytest

import __spark_entry__ as entry
from weftlink.plans import queries, sql

TABLES = ("documents",)


def text(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    return "[" + ",".join(map(text, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


def test_entry(spark):
    assert entry.entry(spark).head(1)
    assert set(sql.oracle_sql()) <= set(queries.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(sql.FINAL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = queries.queries()[name](spark, sf_dir)
    result = con.execute(sql.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted("|".join(text(v) for _, v in sorted(zip(names, row))) for row in result.fetchall())
    assert sorted("|".join(text(row[c]) for c in sorted(names)) for row in found.collect()) == want
