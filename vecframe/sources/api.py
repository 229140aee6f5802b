"""Requests and responses as JSON text: a route and a body in, a status and a body out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import values
from .requests import AddDocuments, DeleteDocuments, Search, Settings
from .store import AlreadyExists, DamagedLog, Engine, NotFound

Answer = tuple[int, str]


class Api:
    """The engine behind routes. Malformed requests and loaded names are 400, unknown collections and documents 404, a
    collection with a damaged log 409."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.routes: dict[str, Callable[[dict, str], Answer]] = {
            "health": lambda *_: (200, json.dumps(engine.health())), "list_indices": lambda *_: (200, json.dumps(engine.list())),
            "create_index": self._create, "load_index": self._named(engine.load), "save_index": self._named(engine.save), "delete_index": self._named(engine.drop),
            "delete_index_from_disk": self._named(engine.drop_files), "index_status": lambda body, _: (200, json.dumps(engine.status(_name(body)))),
            "add_documents": self._add, "delete_documents": self._delete, "get_document": self._get, "get_documents": self._get_many, "search": self._search, "facets": self._facets,
        }

    def handle(self, route: str, text: str = "{}") -> Answer:
        """The status and JSON body of a request; ``text`` is a JSON object."""
        try:
            if route not in self.routes:
                raise NotFound(f"route {route}")
            body = json.loads(text)
            if not isinstance(body, dict):
                raise ValueError("a request is a JSON object")
            return self.routes[route](body, text)
        except NotFound as e:
            return 404, json.dumps({"error": str(e)})
        except DamagedLog as e:
            return 409, json.dumps({"error": str(e)})
        except (AlreadyExists, ValueError, TypeError) as e:
            return 400, json.dumps({"error": str(e)})

    def _named(self, act: Callable[[str], object]) -> Callable[[dict, str], Answer]:
        def run(body: dict, _: str) -> Answer:
            act(_name(body))
            return 200, json.dumps({"indexName": _name(body)})

        return run

    def _create(self, _: dict, text: str) -> Answer:
        return 201, self.engine.create(Settings.from_json(text)).settings.to_json()

    def _add(self, _: dict, text: str) -> Answer:
        request = AddDocuments.from_json(text)
        self.engine.collection(request.indexName).add(request)
        return 200, json.dumps({"added": len(request.ids)})

    def _delete(self, _: dict, text: str) -> Answer:
        request = DeleteDocuments.from_json(text)
        self.engine.collection(request.indexName).delete(request.ids)
        return 200, json.dumps({"deleted": len(request.ids)})

    def _get(self, body: dict, _: str) -> Answer:
        return 200, json.dumps(self.engine.collection(_name(body)).get(_number(body, "id")))

    def _get_many(self, body: dict, _: str) -> Answer:
        ids = body.get("ids")
        if not isinstance(ids, list):
            raise ValueError("missing: ids")
        rows = self.engine.collection(_name(body)).get_many(ids).select("doc_id", "vector", values.metadata_to_json(F.col("metadata")).alias("m")).collect()  # a request's ids
        return 200, json.dumps([None if r.vector is None else {"id": r.doc_id, "vector": list(r.vector), "metadata": json.loads(r.m) if r.m else {}} for r in rows])

    def _search(self, _: dict, text: str) -> Answer:
        request = Search.from_json(text)
        collection = self.engine.collection(request.indexName)
        found = collection.search(request.queryVector, request.k, request.filter, request.returnMetadata, collection.settings.indexType.upper() == "APPROXIMATE")
        columns = [values.metadata_to_json(F.col("metadata")).alias("m")] if request.returnMetadata else []
        rows = found.select("doc_id", "distance", *columns).orderBy("distance", "doc_id").collect()  # k rows
        out = {"hits": [r.doc_id for r in rows], "distances": [r.distance for r in rows]}
        if request.returnMetadata:
            out["metadatas"] = [json.loads(r.m) if r.m else None for r in rows]
        return 200, json.dumps(out)

    def _facets(self, body: dict, _: str) -> Answer:
        counts, spans = self.engine.collection(_name(body)).facets(body.get("filter", ""))
        out: dict = {"counts": {}, "ranges": {}}
        for r in counts.collect():  # a row a value
            out["counts"].setdefault(r["field"], {})[r["value"]] = r["n"]
        for r in spans.collect():
            out["ranges"][r["field"]] = [r["low"], r["high"]]
        return 200, json.dumps(out)


def _name(body: dict) -> str:
    if "indexName" not in body:
        raise ValueError("missing: indexName")
    return body["indexName"]


def _number(body: dict, key: str) -> int:
    if isinstance(body.get(key), bool) or not isinstance(body.get(key), int):
        raise ValueError(f"missing: {key}")
    return body[key]
