"""All registered queries of the library proper, by name, with their SQL where it exists."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under a name."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


for _module in ("scalar_queries", "table_queries", "sequence_queries", "title_queries", "corpus_queries", "idea_queries"):
    importlib.import_module(f"cuecraft.plans.{_module}")
