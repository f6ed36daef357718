"""Named reports: name -> operator with typed parameters.

``run("get_devops_daily", tables, as_of=..., days=7)`` is the whole interface;
parameters are checked before any plan is built. ``approximate=True`` makes any
report with sketches, in one pass over its rows.
"""
from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from parley.functions.kernels import Sketches, sketched
from parley.operators import builders, business, devops, sessions, tech

PARAMETER_TYPES = {"as_of": datetime, "days": int, "hours": int, "weeks": int, "limit": int, "session_id": str,
                   "near_limit": float, "include_scope_rejected": bool, "dedup": bool, "labels": dict}


@dataclass(frozen=True)
class Operator:
    name: str
    fn: Callable[..., DataFrame]

    @property
    def parameters(self) -> dict[str, type]:
        names = inspect.signature(self.fn).parameters
        return {p: PARAMETER_TYPES[p] for p in names if p in PARAMETER_TYPES}

    @property
    def required(self) -> list[str]:
        return [n for n, p in inspect.signature(self.fn).parameters.items()
                if p.kind is p.KEYWORD_ONLY and p.default is p.empty]

    def __call__(self, tables: Mapping[str, DataFrame], *, approximate: bool | Sketches = False, **params) -> DataFrame:
        allowed = self.parameters
        for key, value in params.items():
            if key not in allowed:
                raise TypeError(f"{self.name} has no parameter {key!r}; it takes {sorted(allowed)}")
            wrong = isinstance(value, bool) and allowed[key] is int
            if value is not None and (wrong or not isinstance(value, allowed[key])):
                raise TypeError(f"{self.name}: {key} must be {allowed[key].__name__}, got {value!r}")
        missing = [p for p in self.required if p not in params]
        if missing:
            raise TypeError(f"{self.name} needs {missing}")
        if approximate:
            with sketched(approximate if isinstance(approximate, Sketches) else Sketches()):
                return self.fn(tables, **params)
        return self.fn(tables, **params)


def _public(module, prefix: str = "") -> dict[str, Operator]:
    return {name: Operator(name, fn) for name, fn in vars(module).items()
            if inspect.isfunction(fn) and fn.__module__ == module.__name__ and name.startswith(prefix)
            and "metrics" not in inspect.signature(fn).parameters and not name.startswith("_")}


# The 45 named reports.
NAMED: dict[str, Operator] = {
    **_public(devops, "get_"), **_public(tech, "get_"), **_public(business, "get_")}

# Dashboard, endpoint and agent variants.
VARIANTS: dict[str, Operator] = _public(builders)
VARIANTS.pop("conversion_daily")

SESSIONS: dict[str, Operator] = {
    "session_outcomes": Operator("session_outcomes", sessions.session_outcomes),
    "session_detail": Operator("session_detail", sessions.session_detail),
}

ALL: dict[str, Operator] = {**NAMED, **VARIANTS, **SESSIONS}


def run(name: str, tables: Mapping[str, DataFrame], **params) -> DataFrame:
    if name not in ALL:
        raise KeyError(f"unknown report {name!r}")
    return ALL[name](tables, **params)
