"""Every registered query that has SQL, against DuckDB; the others run."""

import duckdb
import pytest

from folium.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    return sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, name):
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    if name in q.ORACLES:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = c.sql(q.ORACLES[name])
        assert sorted(found.columns) == columns
        assert normal(map(tuple, rows)) == normal(found.select(", ".join(f'"{x}"' for x in columns)).fetchall())
    else:
        assert rows
