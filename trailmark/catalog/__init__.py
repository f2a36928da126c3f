"""All registered queries; importing the area modules fills the registry."""

from __future__ import annotations

import importlib

from trailmark.catalog.base import ORACLES, QUERIES

AREAS = ("scalars", "summary", "table", "parse", "trajectory", "benchmark", "source")


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"trailmark.catalog.{area}_cases")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
