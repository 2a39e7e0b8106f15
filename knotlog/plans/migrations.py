"""Migrations of a store from collections to the event log, each run once, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotlog.operators.maintenance import nodes_to_entities, notes_to_decisions, relations_to_links
from knotlog.sources.store import Store, once


def _moved(table: str, target: str, mapping: Callable[[DataFrame], DataFrame]) -> Callable[[Store], dict[str, DataFrame]]:
    """Rows of a collection as events beside those there are; a chain that exists is left alone."""

    def run(store: Store) -> dict[str, DataFrame]:
        if table not in store.tables():
            return {}
        new = mapping(store.table(table))
        if target not in store.tables():
            return {target: new}
        keys = ["src_ref", "edge_type", "dst_ref"] if target == "links" else ["kind", "id"]
        old = store.table(target)
        return {target: old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)}

    return run


def _baseline(store: Store) -> dict[str, DataFrame]:
    """A mark of where the log begins; tables stay as they are."""
    return {}


def _retired(store: Store) -> dict[str, DataFrame]:
    """The change log's rows go; its table stays, empty, for readers that name it."""
    return {"evolution": store.table("evolution").where(F.lit(False))} if "evolution" in store.tables() else {}


#: Number and what it does.
STEPS: list[tuple[int, str, Callable[[Store], dict[str, DataFrame]]]] = [
    (10, "event_baseline", _baseline),
    (11, "nodes_to_entities", _moved("nodes", "entities", nodes_to_entities)),
    (12, "relations_to_links", _moved("relations", "links", relations_to_links)),
    (13, "notes_to_decisions", _moved("notes", "decisions", notes_to_decisions)),
    (14, "evolution_retired", _retired),
    (15, "session_baseline", _baseline),
]


def migrate(store: Store, up_to: int | None = None) -> list[int]:
    """Runs what has not run yet; the numbers of the steps that ran."""
    return [n for n, name, step in STEPS if (up_to is None or n <= up_to) and once(store, f"migration_{n}_{name}", lambda step=step: step(store))]
