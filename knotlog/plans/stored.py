"""What queries over one set of tables share: indexes built once a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from knotlog.sources.scratch import scratch_path

_BUILT: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> object:
    """What ``build`` made in a folder for these tables, made when first asked for.

    The tables are taken to stay as they are while the session lasts.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build(scratch_path(spark, name))
    return _BUILT[key]


def built(spark: SparkSession, sf_dir: str, name: str) -> object | None:
    """What ``stored`` has made for these tables already, if anything; nothing is made."""
    return _BUILT.get((spark.sparkContext.applicationId, sf_dir, name))


def forget() -> None:
    """Drops what was built, so that it is made anew."""
    _BUILT.clear()
