"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from tidegrain.plans.facts import FACT


def registrar() -> tuple[dict, dict, Callable]:
    """Two dictionaries, and a decorator that fills them under the function's name (FACT in the SQL is the price fact)."""
    found, sql = {}, {}

    def query(text: str | None = None):
        def add(f):
            found[f.__name__] = f
            if text:
                sql[f.__name__] = text.replace("FACT", FACT)
            return f

        return add

    return found, sql, query
