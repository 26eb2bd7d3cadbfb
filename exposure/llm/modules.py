"""Which modules of this subpackage hold code that runs inside tasks."""

from __future__ import annotations

import importlib

from pyspark import cloudpickle

IN_TASKS: tuple[str, ...] = (
    "balltree", "blocks", "bytecnn", "bytepairs", "hyperminhash", "langid", "packing", "pii", "pitmanyor", "suffixes", "webp",
)


def travel_with_jobs() -> None:
    """Send the code along with the job, so that workers need not be able to import it."""
    for name in IN_TASKS:
        cloudpickle.register_pickle_by_value(importlib.import_module(f"exposure.llm.{name}"))
