"""All queries of the core, by name."""

from __future__ import annotations

from hashloom.plans import engine, pipeline, searches


def queries() -> dict:
    return {**searches.QUERIES, **engine.QUERIES, **pipeline.QUERIES}


def oracles() -> dict[str, str]:
    return {**searches.ORACLES, **engine.ORACLES, **pipeline.ORACLES}
