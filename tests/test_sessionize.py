"""block_sessionize against its SQL in DuckDB, on odd documents and on lines of many splits."""

import duckdb

from gapfeed.jobs import registry
from gapfeed.operators import scans

TEXTS = [None, "", "No header", "Head.", "Head.\nbody\n\nNext one.\nx é😀\n", "lead\nÉté.\r\nEnd. \nTail.\nA. b.\nÈ.\n", "Same.\nz", "a\n\nB.", ".\nC.\n"]


def check(spark, folder):
    got = sorted(tuple(r) for r in registry.QUERIES["block_sessionize"](spark, str(folder)).collect())
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        want = sorted(db.sql(registry.SQL["block_sessionize"]).fetchall())
    assert got == want
    return want


def test_sessionize_equals_sql(spark, tmp_path, monkeypatch):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert len(check(spark, tmp_path)) == 8
    # splits of two lines give the same blocks
    running = scans.running
    monkeypatch.setattr(scans, "running", lambda *a, **how: running(*a, **how | {"split": 2}))
    check(spark, tmp_path)
