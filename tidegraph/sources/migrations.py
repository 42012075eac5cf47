"""Changes of a store's tables that are made once, in the order of their names."""

from __future__ import annotations

from collections.abc import Callable

from .store import Store

TABLE = "schema_migrations"


def migrate(store: Store, steps: dict[str, Callable[[Store], None]]) -> list[str]:
    """Run the steps that the store has not seen, in the order of their names; returns those that ran.

    A step is noted after it has ended, so one that fails is run again next time and those behind it wait."""
    done = {r[0] for r in store.read(TABLE, "name string").collect()} if store.version(TABLE) else set()
    ran = []
    for name in sorted(set(steps) - done):
        steps[name](store)
        store.append(TABLE, store.spark.createDataFrame([(name,)], "name string"))
        ran.append(name)
    return ran
