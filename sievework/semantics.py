"""Switches for places where two readings of an operator are in use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Semantics:
    """``degree``: hotspots and dead code by distinct callees ("out") or by distinct callers ("in").
    ``enclosing``: the "first" declaration around a line, or the "smallest".
    ``all_imports``: every path of a grouped import, or only the first.
    ``tests_per_symbol``: relate tests to every symbol (a cross product) or to those that they call.
    ``repeated_terms``: score a repeated query term once, or once for each time.
    """

    degree: str = "out"
    enclosing: str = "first"
    all_imports: bool = True
    tests_per_symbol: bool = True
    repeated_terms: bool = False


DEFAULT = Semantics()
