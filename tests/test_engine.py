from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vecframe.functions import values, vectors
from vecframe.operators import ann, search
from vecframe.sources import oplog
from vecframe.sources.requests import AddDocuments, DeleteDocuments, Search, Settings
from vecframe.sources.store import AlreadyExists, Engine, NotFound
from vecframe.streaming.ingest import ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def hits(frame):
    return [r.doc_id for r in frame.orderBy("distance", "doc_id").collect()]


def test_search_order_delete_and_reload(engine):
    c = engine.create(Settings("t", 4))
    c.add(AddDocuments("t", [0, 1, 2, 3], [[float(i + 1)] * 4 for i in range(4)], [{"name": f"doc_{i}", "integer": i, "float": i * 1.5} for i in range(4)]))
    assert hits(c.search([1.0] * 4, 4)) == [3, 2, 1, 0]
    assert set(hits(c.search([1.0] * 4, 4, 'name = "doc_1" OR name = "doc_2"'))) == {1, 2}
    assert "metadata" not in c.search([1.0] * 4, 1).columns and "metadata" in c.search([1.0] * 4, 1, return_metadata=True).columns
    c.delete([1, 2, 77])
    assert set(hits(c.search([1.0] * 4, 9))) == {0, 3}
    with pytest.raises(NotFound):
        c.get(1)
    c.add(AddDocuments("t", [3], [[9.0] * 4], [{"name": "new"}]))
    assert c.get(3) == {"id": 3, "vector": [9.0] * 4, "metadata": {"name": "new"}}
    assert c.filter('name = "doc_3"').count() == 0  # no stale values after an update
    engine.drop("t")
    c = engine.load("t")  # from the log alone
    assert set(hits(c.search([1.0] * 4, 9))) == {0, 3}
    c.add(AddDocuments("t", [1], [[5.0] * 4]))
    engine.save("t")
    assert engine.status("t")["currentElements"] == 3
    c.delete([0])
    c.compact()
    engine.drop("t")
    c = engine.load("t")
    assert set(hits(c.search([1.0] * 4, 9))) == {1, 3}
    counts, ranges = c.facets()
    assert {(r.field, r.value, r.n) for r in counts.collect()} == {("name", "new", 1)} and ranges.count() == 0


def test_errors(engine):
    assert engine.health() == "OK" and engine.list() == []
    engine.create(Settings("e", 2))
    with pytest.raises(AlreadyExists):
        engine.create(Settings("e", 2))
    with pytest.raises(AlreadyExists):
        engine.drop_files("e")
    for call in (lambda: engine.collection("no"), lambda: engine.load("no"), lambda: engine.save("no"), lambda: engine.drop("no"), lambda: engine.collection("e").get(1)):
        with pytest.raises(NotFound):
            call()
    for bad in (lambda: AddDocuments("e", [1, 2], [[1.0, 2.0]]), lambda: AddDocuments("e", [-1], [[1.0, 2.0]]), lambda: AddDocuments("e", [1], [[1.0, 2.0]], [{"x": True}]), lambda: engine.collection("e").add(AddDocuments("e", [1], [[1.0]])), lambda: Settings("e", 2, spaceType="COS")):
        with pytest.raises(ValueError):
            bad()
    engine.drop("e")
    engine.drop_files("e")
    with pytest.raises(NotFound):
        engine.load("e")


def test_requests():
    s = Settings.from_json('{"indexName": "a", "dimension": 3}')
    assert (s.spaceType, s.vectorType, s.efConstruction, s.M) == ("IP", "FLOAT32", 512, 16) and Settings.from_json(s.to_json()) == s
    q = Search.from_json('{"indexName": "a", "queryVector": [1], "k": 2}')
    assert (q.efSearch, q.filter, q.returnMetadata) == (512, "", False)
    assert DeleteDocuments.from_json('{"indexName": "a", "ids": [1]}').ids == [1]
    a = AddDocuments.from_json('{"indexName": "a", "ids": [7], "vectors": [[1, 2]], "metadatas": null}')
    assert a.rows() == [(7, [1.0, 2.0], {})] and json.loads(a.to_json())["ids"] == [7]
    with pytest.raises(ValueError):
        Settings.from_json('{"dimension": 3}')


def test_log(spark):
    rows = [(0, "ADD", 1), (1, "ADD", 2), (2, "DELETE", 1), (3, "DELETE", 5), (4, "ADD", 3)]
    log = oplog.sealed(spark.createDataFrame([(s, o, i, [1.0], {}) for s, o, i in rows], "seq long, op string, doc_id long, vector array<float>, metadata map<string,struct<k:tinyint,l:bigint,d:double,s:string>>"))
    assert {r.doc_id for r in oplog.live(log).collect()} == {2, 3}
    assert {(r.op, r.doc_id) for r in oplog.compacted(log).collect()} == {("ADD", 2), ("ADD", 3), ("DELETE", 5)}
    assert {(r.op, r.doc_id) for r in oplog.compacted(log, log.where("doc_id = 1")).collect()} == {("ADD", 2), ("ADD", 3), ("DELETE", 1)}
    damaged = log.selectExpr("seq", "op", "doc_id", "vector", "metadata", "if(seq = 2, crc + 1, crc) as crc")
    assert {r.seq for r in oplog.intact(damaged).collect()} == {0, 1} and oplog.intact(log).count() == 5


def test_reduced_precision(spark):
    x = [0.0, 1.0, -1.1, 65519.0, 65520.0, 1e-7, 3.14159]
    for kind in vectors.TYPES:
        column = spark.createDataFrame([(x,)], "v array<float>").select(vectors.quantized(F.col("v"), kind)).first()[0]
        assert list(column) == pytest.approx(vectors.quantized_list(x, kind), rel=1e-7)
    assert vectors.quantized_list([65520.0], "FLOAT16") == [float("inf")]


def test_json_and_batch(spark):
    rows = spark.createDataFrame([(1, '{"a": 5, "b": 5.0, "c": "x\\"y"}'), (2, "{}"), (3, None)], "doc_id long, j string").select("doc_id", values.metadata_from_json(F.col("j")).alias("m"))
    out = {r.doc_id: r.m for r in rows.collect()}
    assert {k: (v["k"], values.untagged(v)) for k, v in out[1].items()} == {"a": (0, 5), "b": (1, 5.0), "c": (2, 'x"y')}
    assert json.loads(rows.select(values.metadata_to_json(F.col("m"))).first()[0]) == {"a": 5, "b": 5.0, "c": 'x"y'}
    with pytest.raises(Exception):
        spark.createDataFrame([('{"a": true}',)], "j string").select(values.metadata_from_json(F.col("j"))).collect()
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "doc_id long, vector array<float>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in search.knn_batch(df, [(0, [1.0, 0.0]), (1, [0.0, 0.0])], 3, "L2").collect()}
    assert [got[(1, r)] for r in (1, 2, 3)] == [0, 3, 6] and [got[(0, r)] for r in (1, 2, 3)] == [1, 4, 7]
    assert ann.build(df, lists=3, space="L2").search([1.0, 1.0], 2, probes=3).count() == 2


def test_stream(spark, engine, tmp_path):
    source = spark.createDataFrame([(i, [1.0, float(i)], {"n": values.tagged(i)}) for i in range(5)], values.DOCUMENT)
    source.write.parquet(f"{tmp_path}/in")
    c = engine.create(Settings("s", 2))
    for _ in range(2):  # the second run has nothing new
        ingest(spark.readStream.schema(values.DOCUMENT).parquet(f"{tmp_path}/in"), c, f"{tmp_path}/cp").awaitTermination()
    assert c.documents().count() == 5 and c.filter("n > 2").count() == 2
