"""Shapes of user functions, checked when the graph is described and not when the first row comes."""

from __future__ import annotations

import inspect
from collections.abc import Callable


def takes(func: Callable, inputs: int, what: str, gives: bool | None = None) -> None:
    """Raises unless ``func`` can be called with that many values. ``gives``: it must (or must not) return something, as far as it is annotated."""
    if not callable(func):
        raise TypeError(f"{what} must be a function")
    try:
        signature = inspect.signature(func)
    except ValueError:  # some built-in functions have none
        return
    try:
        signature.bind(*[None] * inputs)
    except TypeError:
        raise TypeError(f"{what} must take {inputs} value{'s' * (inputs != 1)}, not {signature}") from None
    found = signature.return_annotation
    nothing = found in (None, "None")
    if gives and nothing:
        raise TypeError(f"{what} must return a value")
    if gives is False and not nothing and found is not inspect.Signature.empty:
        raise TypeError(f"{what} must not return a value")
