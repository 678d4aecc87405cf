"""Declared record schemas: ordered fields of seven kinds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from millrace.functions.strict import spark_type

KINDS = ("i32", "i64", "u32", "u64", "f32", "f64", "string")


@dataclass
class StreamSchema:
    """Ordered (name, kind) fields; names may repeat, the first one is found."""

    fields: list[tuple[str, str]] = field(default_factory=list)

    def add_field(self, name: str, kind: str) -> StreamSchema:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        self.fields.append((name, kind))
        return self

    def field_index(self, name: str) -> int | None:
        return next((i for i, (n, _) in enumerate(self.fields) if n == name), None)

    def is_compatible_with(self, other: StreamSchema) -> bool:
        """The same names and kinds in the same order."""
        return self.fields == other.fields

    def struct(self) -> StructType:
        return _parse_datatype_string(", ".join(f"`{n}` {spark_type(k)}" for n, k in self.fields))


def compatible(a: DataFrame | StructType, b: DataFrame | StructType) -> bool:
    """Equal names and types in order, whatever their nullability."""
    plain = lambda x: [(f.name, f.dataType) for f in (x.schema if isinstance(x, DataFrame) else x)]
    return plain(a) == plain(b)
