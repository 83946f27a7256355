"""Conditions that a data source of ours applies itself, before it opens what they rule out.

They are an option of the source and not taken from the query's filters: Spark 4.1 keeps the filters that a Python source took over for all later scans of
the same relation, so two branches of a query, or a query after another one, would lose rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

#: (column, comparison, constant), or a list of constants for "in".
Condition = tuple[str, str, object]

TESTS: dict[str, Callable] = {
    "=": lambda x, v: x == v, "in": lambda x, v: x in v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, "starts": lambda x, v: x.startswith(v),
}


class Wanted:
    """Conditions all of which a row must meet; a null meets none."""

    def __init__(self, said: str | None, columns: Iterable[str]):
        self.conditions: list[Condition] = [tuple(c) for c in json.loads(said or "[]")]
        columns = list(columns)
        for c, kind, _ in self.conditions:
            if c not in columns or kind not in TESTS:
                raise ValueError(f"no condition on {c} by {kind}: columns are {columns}, comparisons {list(TESTS)}")

    def of(self, column: str, *kinds: str) -> list:
        """The constants of the conditions of some kinds on a column."""
        return [v for c, kind, v in self.conditions if c == column and kind in kinds]

    def fits(self, column: str, x) -> bool:
        return all(x is not None and TESTS[kind](x, v) for c, kind, v in self.conditions if c == column)


def said(conditions: Iterable[Condition]) -> str:
    return json.dumps([list(c) for c in conditions])
