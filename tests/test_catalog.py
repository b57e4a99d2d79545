"""The queries against their SQL on the small tables.

A few by default; all of them with SURGELINE_ALL_QUERIES=1.
"""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as driver
from surgeline.catalog import registered_queries

FOLDER = os.environ.get("SURGELINE_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["clean_snapshots", "derive_intervals", "compute_baselines", "replay_baselines", "cycle_gates", "event_projection", "alert_text", "item_profile", "legacy_scored", "replay_gates"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")
CHOSEN = sorted(driver.oracle_sql()) if os.environ.get("SURGELINE_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) and math.isfinite(value):
        return repr(round(float(value), 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    assert found == expected


def test_every_query_has_its_sql():
    assert registered_queries().keys() <= driver.oracle_sql().keys()


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
