"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from shotlens.plans import core, fits, levels, more, problems

PARTS = [core, more, fits, levels, problems]


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: q for part in PARTS for name, q in part.SQL.items()}
