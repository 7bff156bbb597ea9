"""Column mappings of a table (M1-M4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from drayline.functions.dates import DEFAULT_SOURCE, DEFAULT_TARGET
from drayline.functions.rules import Chain
from drayline.plans.dialects import POSTGRESQL, sql_type, translate_type

DIRECT, TRANSFORM = "direct", "transform"


@dataclass(frozen=True)
class ColumnMapping:
    """How one source column reaches the target.

    A rule chain wins over date formats; a transform without a chain is a
    date conversion, with default formats where none are given.
    """

    source: str
    target: str | None = None
    action: str = DIRECT
    target_type: str | None = None
    rules: Chain | None = None
    source_format: str | None = None
    target_format: str | None = None

    def __post_init__(self) -> None:
        if self.action not in (DIRECT, TRANSFORM):
            raise ValueError(f"{self.source}: action must be direct or transform")

    @property
    def name(self) -> str:
        return self.target or self.source

    @property
    def is_date(self) -> bool:
        return self.action == TRANSFORM and not self.rules

    @property
    def formats(self) -> tuple[str, str]:
        return self.source_format or DEFAULT_SOURCE, self.target_format or DEFAULT_TARGET

    @classmethod
    def from_dict(cls, source: str, values: Mapping[str, Any]) -> "ColumnMapping":
        """From a request such as ``{"target_name": …, "transform_rule": …}``."""
        return cls(
            source=source,
            target=values.get("target_name"),
            action=values.get("action", DIRECT),
            target_type=values.get("target_type"),
            rules=values.get("transform_rule"),
            source_format=values.get("source_format"),
            target_format=values.get("target_format"),
        )


@dataclass(frozen=True)
class TableSpec:
    """What to do with one table on its way."""

    name: str
    mappings: Sequence[ColumnMapping] = ()
    keys: Sequence[str] = ()
    not_null: Sequence[str] = ()
    defaults: Mapping[str, Any] = field(default_factory=dict)
    user_defined: Sequence[str] = ()
    target_dialect: str | None = None
    strict_rules: bool = True

    def for_columns(self, columns: Sequence[str]) -> list[ColumnMapping]:
        """One mapping per source column, in source order."""
        given = {m.source: m for m in self.mappings}
        unknown = [name for name in given if name not in columns]
        if unknown:
            raise ValueError(f"{self.name}: no such column: {', '.join(unknown)}")
        return [given.get(c, ColumnMapping(c)) for c in columns]

    def target_names(self, columns: Sequence[str]) -> list[str]:
        renamed = {m.source: m.name for m in self.mappings}
        return [renamed.get(c, c) for c in columns]


def default_mappings(
    schema: T.StructType, target_dialect: str, user_defined: Sequence[str] = ()
) -> list[ColumnMapping]:
    """Identity mapping with the target type each column would get (M4)."""
    return [
        ColumnMapping(
            source=f.name,
            target=f.name,
            target_type=translate_type(
                f.metadata.get("sql_type") or sql_type(f.dataType),
                f.metadata.get("dialect", POSTGRESQL),
                target_dialect,
                user_defined=f.name in user_defined or bool(f.metadata.get("user_defined")),
            ),
        )
        for f in schema.fields
    ]
