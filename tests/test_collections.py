"""Collections under streams, saves, damage, indexes and requests."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe.functions import values
from vecframe.operators import search
from vecframe.sources import oplog
from vecframe.sources.api import Api
from vecframe.sources.requests import AddDocuments, Settings
from vecframe.sources.store import DamagedLog, Engine
from vecframe.streaming.ingest import ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/engine")


def ids(frame):
    return sorted(r.doc_id for r in frame.collect())


def test_two_streams_and_a_repeated_batch(spark, engine, tmp_path):
    c = engine.create(Settings("s", 1))
    for k in range(2):
        spark.createDataFrame([(10 * k + i, [1.0], {}) for i in range(3)], values.DOCUMENT).write.parquet(f"{tmp_path}/in{k}")
        ingest(spark.readStream.schema(values.DOCUMENT).parquet(f"{tmp_path}/in{k}"), c, f"{tmp_path}/cp{k}").awaitTermination()
    assert ids(c.documents()) == [0, 1, 2, 10, 11, 12]
    c.delete([0])
    engine.save("s")
    stream, number = next(iter(c._current()["streams"].items()))
    assert number == 0 and len(c._current()["streams"]) == 2
    assert c.stream_batch(stream) == 0 and ids(c.documents()) == [1, 2, 10, 11, 12]  # a repeated batch 0 is passed over


def test_frames_outlive_a_save(engine):
    c = engine.create(Settings("s", 2))
    c.add(AddDocuments("s", [1, 2], [[1.0, 0.0], [0.0, 1.0]]))
    before = c.search([1.0, 0.0], 2)
    engine.save("s")
    assert ids(before) == [1, 2]
    c.add(AddDocuments("s", [3], [[0.5, 0.5]]))
    c.delete([1])
    assert c.deletes
    folded = c.documents()
    c.compact()
    assert ids(folded) == ids(c.documents()) == [2, 3] and not c.deletes
    engine.save("s")
    assert ids(c.documents()) == [2, 3] and len(c.files.names(f"{c.path}/snapshot")) == 2
    engine.drop("s")
    assert ids(engine.load("s").documents()) == [2, 3]


def test_the_last_duplicate_stays(spark, engine):
    c = engine.create(Settings("s", 1))
    rows = [(1, [float(i)], {"n": values.tagged(i)}) for i in range(20)]
    c.add_frame(spark.createDataFrame(rows, values.DOCUMENT).coalesce(1))
    assert c.get(1) == {"id": 1, "vector": [19.0], "metadata": {"n": 19}}


def test_damage_is_reported(spark, engine):
    c = engine.create(Settings("s", 1))
    c.add(AddDocuments("s", [1], [[1.0]]))
    bad = spark.read.schema(oplog.ENTRY).parquet(f"{c.path}/log/{c._parts()[0]}").withColumn("seq", F.lit(1).cast("long"))
    bad.write.parquet(f"{c.path}/log/{1:019d}-{1:019d}-bad")
    engine.drop("s")
    c = engine.load("s")
    assert c.damaged and ids(c.documents()) == [1]
    for act in (lambda: c.add(AddDocuments("s", [2], [[2.0]])), c.save):
        with pytest.raises(DamagedLog):
            act()
    c.repair()
    c.add(AddDocuments("s", [2], [[2.0]]))
    assert ids(c.documents()) == [1, 2]


def test_broken_vectors_are_no_hits(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 1.0])], "doc_id long, vector array<float>")
    assert [r.doc_id for r in search.knn(df, [1.0, 0.0], 5).collect()] == [1, 5]
    assert [r.doc_id for r in search.knn_batch(df, [(0, [1.0, 0.0])], 5).orderBy("rank").collect()] == [1, 5]
    assert [r.doc_id for r in search.knn_join(df, df.select(F.col("doc_id").alias("query_id"), "vector"), 5).where("query_id = 1").orderBy("rank").collect()] == [1, 5]


def test_batches_of_distances(spark, monkeypatch):
    x = np.random.default_rng(2).integers(-2, 3, (50, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<float>")
    monkeypatch.setattr(search, "DISTANCES", 40)
    got = {(r.query_id, r["rank"]): r.doc_id for r in search.knn_batch(df, [(q, x[q].tolist()) for q in range(9)], 4, "L2").collect()}
    d = ((x[:, None] - x) ** 2).sum(-1)
    assert got == {(q, n + 1): int(i) for q in range(9) for n, i in enumerate(np.lexsort((np.arange(50), d[q]))[:4])}


def test_index_follows_the_collection(spark, engine):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    c = engine.create(Settings("s", 8, spaceType="L2"))
    c.add_frame(spark.createDataFrame([(i, v.tolist(), {"n": values.tagged(i)}) for i, v in enumerate(x)], values.DOCUMENT))
    c.build_index(lists=8)
    q = x[7].tolist()
    assert ids(c.search(q, 1, approximate=True)) == [7]
    read = c.search(q, 1, approximate=True)._jdf.queryExecution().toString()
    assert "list_id" in read.split("PartitionFilters")[1]  # folders of other lists are not read
    c.delete([7])
    c.add(AddDocuments("s", [1000], [q], [{"n": 7}]))
    assert [(r.doc_id, r.distance) for r in c.search(q, 1, approximate=True).collect()] == [(1000, 0.0)]
    assert ids(c.search(q, 50, "n < 12", approximate=True)) == ids(c.search(q, 50, "n < 12"))  # selective: exact
    c.compact()
    assert 7 not in ids(c.search(q, 400, approximate=True)) and 1000 in ids(c.search(q, 400, approximate=True))
    engine.save("s")
    assert ids(c.search(q, 3, approximate=True)) == ids(c.search(q, 3))


def test_places(engine):
    c = engine.create(Settings("s", 1))
    c.add(AddDocuments("s", [4, 9], [[1.0], [2.0]], [{"a": 1}, {}]))
    assert [(r.place, r.doc_id, r.vector) for r in c.get_many([9, 5, 4, 9]).collect()] == [(0, 9, [2.0]), (1, 5, None), (2, 4, [1.0]), (3, 9, [2.0])]


def test_json_text(spark):
    odd = "a\u2028b\u2029c\u0085d\n\"\\"
    row = spark.createDataFrame([(1, [1.0], {"k" + odd: values.tagged(odd), "n": values.tagged(3)})], values.DOCUMENT).select(values.metadata_to_json(F.col("metadata"))).first()[0]
    assert json.loads(row) == {"k" + odd: odd, "n": 3}
    with pytest.raises(Exception, match="(?i)malformed"):
        spark.createDataFrame([('{"a": 1',)], "j string").select(values.metadata_from_json(F.col("j")).alias("m")).collect()


def test_requests_and_responses(engine):
    api = Api(engine)
    ask = lambda route, **body: (lambda status, text: (status, json.loads(text)))(*api.handle(route, json.dumps(body)))
    assert ask("health") == (200, "OK") and ask("list_indices") == (200, [])
    assert ask("create_index", indexName="a", dimension=2, spaceType="L2")[0] == 201 and ask("create_index", indexName="a", dimension=2)[0] == 400
    assert ask("add_documents", indexName="a", ids=[1, 2, 3], vectors=[[0, 0], [1, 0], [0, 3]], metadatas=[{"n": 1}, {"n": 2.5}, {}])[0] == 200
    assert ask("add_documents", indexName="a", ids=[1], vectors=[])[0] == 400 and ask("add_documents", indexName="b", ids=[], vectors=[])[0] == 404
    assert ask("search", indexName="a", queryVector=[0, 0], k=2) == (200, {"hits": [1, 2], "distances": [0.0, 1.0]})
    assert ask("search", indexName="a", queryVector=[0, 0], k=9, returnMetadata=True, filter="n > 1 OR NOT n > 0")[1] == {"hits": [2, 3], "distances": [1.0, 9.0], "metadatas": [{"n": 2.5}, None]}
    assert ask("search", indexName="a", queryVector=[0], k=2)[0] == 400 and ask("search", indexName="a", k=2)[0] == 400 and ask("search", indexName="b", queryVector=[0], k=2)[0] == 404
    assert ask("delete_documents", indexName="a", ids=[2]) == (200, {"deleted": 1}) and ask("get_document", indexName="a", id=2)[0] == 404
    assert ask("get_document", indexName="a", id=1) == (200, {"id": 1, "vector": [0.0, 0.0], "metadata": {"n": 1}})
    assert ask("get_documents", indexName="a", ids=[3, 2])[1] == [{"id": 3, "vector": [0.0, 3.0], "metadata": {}}, None]
    assert ask("save_index", indexName="a")[0] == 200 and ask("delete_index", indexName="a")[0] == 200 and ask("index_status", indexName="a")[0] == 404
    assert ask("load_index", indexName="a")[0] == 200 and ask("load_index", indexName="a")[0] == 400 and ask("index_status", indexName="a")[1]["currentElements"] == 2
    assert ask("facets", indexName="a")[1] == {"counts": {}, "ranges": {"n": [1, 1]}}
    assert ask("nothing")[0] == 404 and api.handle("search", "{")[0] == 400 and api.handle("search", "[]")[0] == 400
