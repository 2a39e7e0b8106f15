"""Collections as JSON in, and results as text, JSON or YAML out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotlog.schema import KINDS, Registry


def from_json(rows: DataFrame, collection: str, registry: Registry | None = None, value: str = "value", strict: bool = False) -> DataFrame:
    """Rows of JSON text as a collection; fields that are missing are null.

    A row that does not decode is skipped, or fails the query when ``strict``.
    """
    fields = (registry or Registry()).fields(collection)
    schema = T.StructType([*[T.StructField(n, KINDS[k]) for n, k in fields.items()], T.StructField("_corrupt", T.StringType())])
    mode = "FAILFAST" if strict else "PERMISSIVE"
    if strict:
        schema = T.StructType(schema.fields[:-1])
    out = rows.select(F.from_json(F.col(value), schema, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"}).alias("x")).select("x.*")
    return out if strict else out.where("_corrupt IS NULL").where(F.coalesce(*[F.col(f"`{n}`").cast("string") for n in fields]).isNotNull()).drop("_corrupt")


def read_json(spark: SparkSession, path: str, collection: str, registry: Registry | None = None) -> DataFrame:
    """A folder of JSON lines as a collection."""
    return from_json(spark.read.text(path), collection, registry)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


def _plain(v):
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)


def _yaml(v, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(v, dict):
        return "\n".join(f"{pad}{k}:{_nested(x, depth)}" for k, x in v.items())
    if isinstance(v, list):
        return "\n".join(f"{pad}- {_yaml(x, depth + 1).lstrip()}" for x in v)
    return pad + (v if isinstance(v, str) and v and v.isalnum() and not v.isdigit() else json.dumps(v, ensure_ascii=False))


def _nested(v, depth: int) -> str:
    if isinstance(v, (dict, list)):
        return ("\n" + _yaml(v, depth + 1)) if v else (" {}" if isinstance(v, dict) else " []")
    return " " + _yaml(v)


def render(rows: DataFrame, form: str = "text", most: int = 1000) -> str:
    """A small result as ``text``, ``json`` or ``yaml``; ``most`` rows are shown."""
    found = [_plain(r.asDict(True)) for r in rows.limit(most).collect()]
    if form == "json":
        return json.dumps(found, ensure_ascii=False, indent=2)
    if form == "yaml":
        return _yaml(found)
    if form == "text":
        return "\n".join("  ".join(f"{k}={v}" for k, v in r.items() if v is not None) for r in found)
    raise ValueError(f"form {form!r}")
