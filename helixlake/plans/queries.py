"""All queries outside the training-data subpackage, those of many rounds of jobs last."""

from __future__ import annotations

from . import q_clusters, q_hierarchy, q_interact, q_layout, q_more, q_parts, q_records, q_rows, q_space, registry  # noqa: F401

FIRST, LAST = ("TR", "J", "PF", "SC"), ("CL", "TK", "W8", "W9", "W10", "AG20", "IN")


def _place(name: str) -> int:
    return 0 if name.startswith(FIRST) and not name.startswith("JS") else 2 if name.startswith(LAST) else 1


QUERIES = {n: registry.QUERIES[n] for n in sorted(registry.QUERIES, key=_place)}
SQL = {n: registry.SQL[n] for n in QUERIES if n in registry.SQL}

__all__ = ["QUERIES", "SQL"]
