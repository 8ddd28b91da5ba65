"""Collects the (query, oracle) pairs of the library."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULES = ("continuity", "rules", "cleaning", "scoring", "gates", "texts", "starts", "live", "campaign", "ingest", "assembly", "records", "calibration", "reports", "quality")


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name, with the SQL that gives the same rows."""

    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"roadlens.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
