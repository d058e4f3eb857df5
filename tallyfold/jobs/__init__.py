"""Ready queries over the given tables."""

from __future__ import annotations

from tallyfold.jobs import cross_sections, registry, series, signals


def queries() -> dict:
    return registry.QUERIES


def oracles() -> dict[str, str]:
    return registry.ORACLES
