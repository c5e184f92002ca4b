"""Named queries over the driver tables, each next to the SQL it is checked against."""

from __future__ import annotations

from importlib import import_module

from martloom.registry.common import Registry

MODULES = ("retail", "plans", "spec", "profiling", "ingest", "workspace", "modelling", "analysis")


def load() -> Registry:
    merged = Registry()
    for name in MODULES:
        part = import_module(f"martloom.registry.{name}").REG
        clash = merged.queries.keys() & part.queries.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        merged.queries.update(part.queries)
        merged.sql.update(part.sql)
    return merged
