"""Parameters with validated defaults: a bad value falls back to its default with a warning, and never to something looser."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """What the engine's rules may be told."""

    min_peers: int = 3
    shrink: float = 4.0
    min_cell: int = 3
    margin: float = 0.3
    coverage: float = 0.8
    capacity: int = 20


#: The values that each setting may have.
ALLOWED: dict[str, Callable[[float], bool]] = {
    "min_peers": lambda x: 3 <= x <= 1000,
    "shrink": lambda x: 0 < x <= 100,
    "min_cell": lambda x: 3 <= x <= 1000,
    "margin": lambda x: 0.1 <= x < 1,
    "coverage": lambda x: 0.5 <= x < 1,
    "capacity": lambda x: 1 <= x <= 10_000,
}


def load(given: Mapping[str, object]) -> Settings:
    """Settings from a mapping; unknown names, other types and values out of range are named in warnings and left out."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    kept = {}
    for name, value in given.items():
        if name not in kinds:
            warnings.warn(f"unknown setting {name}", stacklevel=2)
        elif isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or (kinds[name] is int and value != int(value)):
            warnings.warn(f"{name}: {value!r} is no {kinds[name].__name__}; the default holds", stacklevel=2)
        elif not ALLOWED[name](value):
            warnings.warn(f"{name}: {value!r} is out of range; the default holds", stacklevel=2)
        else:
            kept[name] = kinds[name](value)
    return Settings(**kept)
