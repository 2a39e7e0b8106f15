"""Collections, their fields, and the event log's structure."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Field kinds of the query language and the Spark type that holds them.
KINDS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "number": T.DoubleType(),
    "int": T.DoubleType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "time": T.StringType(),
    "[]string": T.ArrayType(T.StringType()),
}
#: Kinds that the language does not tell apart.
SAME = {"int": "number", "float": "number"}

_BASE = {
    "nodes": {
        "id": "string", "type": "string", "name": "string", "file_path": "string", "language": "string", "module": "string",
        "class": "string", "stability": "number", "status": "string", "content_hash": "string", "created_at": "time", "updated_at": "time",
    },
    "evolution": {"id": "string", "node_id": "string", "commit_hash": "string", "change_type": "string", "author": "string", "timestamp": "time"},
    "constraints": {"id": "string", "scope": "string", "severity": "string", "description": "string", "created_at": "time"},
    "notes": {"id": "string", "tags": "[]string", "content": "string", "created_at": "time", "updated_at": "time"},
    "relations": {"id": "string", "source_node_id": "string", "target_node_id": "string", "type": "string", "source": "string", "created_at": "time"},
}

#: Fields whose equality a layout by partition or bucket can serve.
INDEXED = {"nodes": {"module": "by_module", "file_path": "by_file", "type": "by_type"}, "notes": {"tags": "by_tag"}}


class SchemaConflict(ValueError):
    """A name is registered already with another definition."""


@dataclass
class Registry:
    """Collections by name; extended at run time, stored with a snapshot."""

    collections: dict[str, dict[str, str]] = field(default_factory=lambda: {k: dict(v) for k, v in _BASE.items()})
    version: int = 1

    def fields(self, collection: str) -> dict[str, str] | None:
        """Fields of a collection, or None."""
        return self.collections.get(collection.lower())

    def add_field(self, collection: str, name: str, kind: str) -> bool:
        """Whether the field is new; the same again changes nothing."""
        kind = self._kind(kind)
        own = self.collections.get(collection)
        if own is None:
            raise SchemaConflict(f"no collection {collection!r}")
        if name in own:
            if own[name] != kind:
                raise SchemaConflict(f"{collection}.{name} is {own[name]}, not {kind}")
            return False
        own[name] = kind
        self.version += 1
        return True

    def add_collection(self, name: str, fields: dict[str, str]) -> bool:
        """Whether the collection is new; the same again changes nothing."""
        fields = {k: self._kind(v) for k, v in fields.items()}
        if name in self.collections:
            if self.collections[name] != fields:
                raise SchemaConflict(f"{name} has other fields")
            return False
        self.collections[name] = fields
        self.version += 1
        return True

    @staticmethod
    def _kind(kind: str) -> str:
        kind = SAME.get(kind, kind)
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        return kind

    def struct(self, collection: str) -> T.StructType:
        """The collection as a Spark schema."""
        return T.StructType([T.StructField(n, KINDS[k]) for n, k in self.collections[collection].items()])

    def to_json(self) -> str:
        """Text that ``from_json`` reads."""
        return json.dumps({"version": self.version, "collections": self.collections})

    @classmethod
    def from_json(cls, text: str) -> Registry:
        """A registry from ``to_json``'s text."""
        d = json.loads(text)
        return cls(d["collections"], d["version"])


def _payload(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: One row per version of an event; exactly one payload is not null.
EVENT_LOG = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("created_at_nanos", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("supersedes", T.StringType()),
    T.StructField("lifecycle", T.StringType()),
    T.StructField("entity", _payload("type", "path", "name", "hash")),
    T.StructField("decision", _payload("title", "body", "severity", "scope", "source")),
    T.StructField("link", _payload("src_ref", "edge_type", "dst_ref")),
    T.StructField("observation", _payload("action", "subject")),
    T.StructField("outcome", _payload("type", "subject")),
])

#: Prefix of a reference for each kind of event.
PREFIX = {"entity": "e:", "decision": "d:", "link": "l:", "observation": "o:", "outcome": "x:"}
