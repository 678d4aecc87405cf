"""Per-row metadata: a map of strings beside the payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_metadata(metadata: Column, key: str, value: Column | str) -> Column:
    """``metadata`` (null: empty) with the key set; an earlier value is replaced."""
    new = F.create_map(F.lit(key), value if isinstance(value, Column) else F.lit(value))
    old = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(old, new)


def get_metadata(metadata: Column, key: str) -> Column:
    """The key's value, or null."""
    return F.try_element_at(metadata, F.lit(key))
