"""Where a frame and each of its columns come from: metadata on the driver, kept beside the plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: Origins that are not files.
PROGRAM, RANGE, CONST, PANDAS, DATAFRAME, RDD, EMPTY, COUNT, INDEX, HIVE = (
    "PROGRAM", "RANGE", "CONST", "PANDAS", "DATAFRAME", "RDD", "EMPTY", "COUNT", "INDEX", "HIVE"
)
Pairs = frozenset[tuple[str, str]]


@dataclass(frozen=True)
class Lineage:
    """table: origins; columns: for each column, the (origin, column) pairs that its values come from."""

    table: frozenset[str] = frozenset()
    columns: dict[str, Pairs] = field(default_factory=dict)

    @classmethod
    def of(cls, origin: str, columns: list[str]) -> Lineage:
        return cls(frozenset([origin]), {c: frozenset([(origin, c)]) for c in columns})

    def pairs(self, names) -> Pairs:
        return frozenset(p for n in names for p in self.columns.get(n, ()))

    def select(self, names) -> Lineage:
        return Lineage(self.table, {n: self.columns.get(n, frozenset()) for n in names})

    def rename(self, names: dict[str, str]) -> Lineage:
        return Lineage(self.table, {names.get(n, n): p for n, p in self.columns.items()})

    def put(self, name: str, pairs: Pairs, table: frozenset[str] = frozenset()) -> Lineage:
        return Lineage(self.table | table, {**self.columns, name: pairs})

    def drop(self, names) -> Lineage:
        return Lineage(self.table, {n: p for n, p in self.columns.items() if n not in set(names)})

    def merge(self, other: Lineage) -> Lineage:
        """Of rows from both."""
        names = {**self.columns, **other.columns}
        return Lineage(self.table | other.table, {n: self.columns.get(n, frozenset()) | other.columns.get(n, frozenset()) for n in names})

    def as_dict(self) -> dict:
        return {"table": set(self.table), "column": {n: set(p) for n, p in self.columns.items()}}

    def to_json(self) -> str:
        return json.dumps({"table": sorted(self.table), "columns": {n: sorted(map(list, p)) for n, p in self.columns.items()}})

    @classmethod
    def from_json(cls, text: str) -> Lineage:
        got = json.loads(text)
        return cls(frozenset(got["table"]), {n: frozenset(map(tuple, p)) for n, p in got["columns"].items()})
