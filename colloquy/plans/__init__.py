"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def bigint_counts(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; wrap every call so counts are BIGINT as in Spark."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def register(name: str, sql: str | None = None):
    if sql is not None:
        sql = bigint_counts(sql)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name!r}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # Import for registration side effects.
    from colloquy.plans import q_core, q_reports, q_visuals, q_text, q_io, q_stored, q_stream, q_timeline  # noqa: F401
    return REGISTRY
