"""DuckDB statements that the registered queries are compared with."""

from __future__ import annotations


def statements() -> dict[str, str]:
    from oracles.metrics import METRICS
    from oracles.operators import OPERATORS

    return {**METRICS, **OPERATORS}
