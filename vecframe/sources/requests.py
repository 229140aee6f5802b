"""Requests as JSON, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from ..functions import values, vectors

INDEX_TYPES = ("APPROXIMATE", "EXACT")


def _required(data: dict, *names: str) -> list:
    missing = [n for n in names if n not in data]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return [data[n] for n in names]


@dataclass
class Settings:
    indexName: str
    dimension: int
    indexType: str = "APPROXIMATE"
    spaceType: str = "IP"
    vectorType: str = "FLOAT32"
    efConstruction: int = 512
    M: int = 16

    def __post_init__(self):
        if self.spaceType not in vectors.SPACES or self.vectorType not in vectors.TYPES or self.indexType.upper() not in INDEX_TYPES:
            raise ValueError(f"unknown space, vector or index type: {self.spaceType}, {self.vectorType}, {self.indexType}")
        if int(self.dimension) < 1:
            raise ValueError("dimension must be positive")

    @classmethod
    def from_json(cls, text: str) -> Settings:
        data = json.loads(text)
        _required(data, "indexName", "dimension")
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})

    def to_json(self) -> str:
        return json.dumps(asdict(self))


@dataclass
class AddDocuments:
    indexName: str
    ids: list[int]
    vectors: list[list[float]]
    metadatas: list[dict] | None = None

    def __post_init__(self):
        if len(self.ids) != len(self.vectors) or self.metadatas is not None and len(self.metadatas) != len(self.ids):
            raise ValueError("ids, vectors and metadatas differ in length")
        for i in self.ids:
            if isinstance(i, bool) or not isinstance(i, int) or not 0 <= i <= values.LARGEST_ID:
                raise ValueError(f"ids are integers from 0 to {values.LARGEST_ID}, not {i!r}")
        for record in self.metadatas or []:
            for value in (record or {}).values():
                values.rank_of(value)

    @classmethod
    def from_json(cls, text: str) -> AddDocuments:
        data = json.loads(text)
        return cls(*_required(data, "indexName", "ids", "vectors"), data.get("metadatas"))

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v is not None})

    def rows(self) -> list[tuple]:
        records = self.metadatas or [{}] * len(self.ids)
        return [(i, [float(x) for x in v], {n: values.tagged(x) for n, x in (m or {}).items()}) for i, v, m in zip(self.ids, self.vectors, records, strict=True)]


@dataclass
class Search:
    indexName: str
    queryVector: list[float]
    k: int
    efSearch: int = 512
    filter: str = ""
    returnMetadata: bool = False

    @classmethod
    def from_json(cls, text: str) -> Search:
        data = json.loads(text)
        _required(data, "indexName", "queryVector", "k")
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})


@dataclass
class DeleteDocuments:
    indexName: str
    ids: list[int] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> DeleteDocuments:
        return cls(*_required(json.loads(text), "indexName", "ids"))
