"""Code to label lookups.

Literal lists are built as one SQL expression: a column object per entry would cost a call
into the JVM each, which adds up over some hundred entries.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def literal_list(values) -> str:
    return ", ".join(sql_literal(value) for value in values)


def _map(entries: dict) -> str:
    return f"map({literal_list(chain.from_iterable(entries.items()))})"


def label_or_code(name: str, entries: dict[str, str], other: str | None = None) -> Column:
    """The label of a code column; a code without one is its own label, or gives that of another column."""
    return F.expr(f"coalesce(try_element_at({_map(entries)}, `{name}`), `{other or name}`)")


def label_or_null(name: str, entries: dict[int, str]) -> Column:
    """The label of a flag column; unknown flags have no label."""
    return F.expr(f"try_element_at({_map(entries)}, `{name}`)")


def null_tokens(name: str, tokens: list[str]) -> Column:
    """The text column, with missing-value tokens as null."""
    return F.expr(f"CASE WHEN `{name}` NOT IN ({literal_list(tokens)}) THEN `{name}` END").alias(name)
