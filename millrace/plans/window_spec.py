"""Window specifications."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class WindowSpec:
    """``size`` and ``advance`` in rows (kind ``count``) or ticks of event time (kind ``time``)."""

    size: int
    advance: int
    kind: str

    def __post_init__(self):
        if self.kind not in ("count", "time"):
            raise ValueError(f"unknown window kind {self.kind!r}")
        if self.size < 1 or self.advance < 1:
            raise ValueError("size and advance must be positive")

    @property
    def tumbling(self) -> bool:
        return self.size == self.advance


def count_window(size: int, advance: int) -> WindowSpec:
    return WindowSpec(size, advance, "count")


def count_tumbling_window(size: int) -> WindowSpec:
    return WindowSpec(size, size, "count")


def time_window(size: int, advance: int) -> WindowSpec:
    return WindowSpec(size, advance, "time")


def time_tumbling_window(size: int) -> WindowSpec:
    return WindowSpec(size, size, "time")
