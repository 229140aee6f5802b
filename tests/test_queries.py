from __future__ import annotations

import os

import duckdb
import pytest

from vecframe.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
CHOSEN = ["filter_group", "filter_not_missing", "filter_map_not_missing", "filter_mixed_gt_long", "knn_with_metadata", "knn_batch_ip", "knn_f16", "facet_ranges", "oplog_compact", "save_load_roundtrip", "collection_search_live", "collection_search_selective", "collection_facets_live", "collection_status_live", "collection_get_places", "search_response"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, db, name):
    rows = [r.asDict() for r in plans.queries()[name](spark, DATA).collect()]
    found = db.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    key = lambda r: str(sorted(r.items()))
    assert sorted(rows, key=key) == sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=key)


def test_entry_without_the_optional_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(plans.oracle_sql()) <= set(plans.queries()) <= set(__spark_entry__.queries())
