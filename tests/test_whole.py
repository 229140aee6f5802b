from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from vecframe.operators import ann, search
from vecframe.plans import queries as plans

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def against_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    rows = [r.asDict() for r in plans.queries()[name](spark, DATA).collect()]
    found = db.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    key = lambda r: str(sorted(r.items()))
    assert sorted(rows, key=key) == sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=key)
    return rows


@tables
@pytest.mark.parametrize("name", ["knn_batch_ip", "knn_batch_l2_filtered"])
def test_batch_asks_the_whole_query_set(spark, name):
    rows = against_sql(spark, name)
    asked = plans.table(spark, DATA, "embeddings").where("vec_id % 20 = 0").count()
    assert len({r["query_id"] for r in rows}) == asked and max(r["query_id"] for r in rows) > 100


def test_join_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_CHUNK", 3)
    monkeypatch.setattr(search, "ROW_CHUNK", 7)
    x = np.random.default_rng(1).integers(-2, 3, (60, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<float>").repartition(3)
    for space in ("IP", "L2"):
        d = 1 - x @ x.T if space == "IP" else ((x[:, None] - x) ** 2).sum(-1)
        got = {(r.query_id, r["rank"]): r.doc_id for r in search.knn_join(df, df.withColumnRenamed("doc_id", "query_id"), 5, space).collect()}
        assert got == {(q, n + 1): int(i) for q in range(60) for n, i in enumerate(np.lexsort((np.arange(60), d[q]))[:5])}


@tables
def test_ivf_recall(spark):
    found = {(r.query_id, r.doc_id) for r in plans.queries()["knn_ivf"](spark, DATA).collect()}
    true = {(r.query_id, r.doc_id) for r in plans.queries()["knn_batch_ip"](spark, DATA).collect()}
    assert len(found) == len(true) and len(found & true) >= 0.9 * len(true)


@tables
def test_ivf_filters_lose_no_hits(spark):
    df = plans.docs(spark, DATA)
    index, q = ann.build(df, lists=45), plans.first_vector(spark, DATA)
    few = "doc_id < 12"
    assert df.where(few).count() == 12
    pick = lambda rows: [r.doc_id for r in rows.orderBy("distance", "doc_id").collect()]
    exact = pick(search.knn(df, q, 10, where=few))
    assert len(exact) == 10 and pick(index.search(q, 10, probes=1, where=few)) == exact
    joined = index.search_join(plans.asked(spark, DATA), 10, probes=1, where=few).where("query_id = 0")
    assert [r.doc_id for r in joined.orderBy("rank").collect()] == exact
    assert index.search(q, 100, probes=1).count() == 100  # one list holds fewer


@tables
def test_oplog_covers_the_whole_log(spark):
    last = plans.table(spark, DATA, "events").agg({"event_id": "max"}).first()[0]
    orphans = against_sql(spark, "oplog_orphan_deletes")
    assert len(orphans) > 0 and max(r["seq"] for r in orphans) > last / 2
    assert len(against_sql(spark, "oplog_crc_prefix")) == (last + 1) * 7 // 10
