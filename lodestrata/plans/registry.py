"""Registered queries of the spatial operators and their SQL."""

from __future__ import annotations

from . import pixels, rasters, samples, scores, structures


def _all() -> dict:
    return pixels.QUERIES | rasters.QUERIES | scores.QUERIES | samples.QUERIES | structures.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
