import duckdb
import pytest

import __spark_entry__
from cindersift.plans.oracle import ORACLE
from cindersift.plans.queries import QUERIES

SAMPLE = ["altman", "beneish", "tag_fallback", "period_pivot", "dilution_score", "event_signals", "insider_profile", "suspension_match", "snapshot_diff", "flagship_scan", "submissions_json", "montier", "export_records"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) > 70


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(ORACLE[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == columns
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    left = sorted(str(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    right = sorted(str(tuple(plain(r[at[c]]) for c in columns)) for r in want.fetchall())
    assert left == right
