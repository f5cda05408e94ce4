import duckdb
import pytest

import __spark_entry__
from peakforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key([tuple(r) for r in got.select(*names).collect()]) == key(rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
