"""Operators are fitted on one frame and applied, lazily, to any frame of the same columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fitted:
    """A fitted operator: apply is a lazy transformation, statistics what was learnt (bounded by the columns, never by rows)."""

    apply: Callable[[DataFrame], DataFrame]
    statistics: dict = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def identity(df: DataFrame) -> DataFrame:
    return df


def columnwise(exprs: dict[str, Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns(exprs) if exprs else df


def literal(value) -> Column:
    return F.lit(None).cast("double") if value is None else F.lit(float(value))


def normal(row_id: str, seed: int) -> Column:
    """A standard normal variate that follows from the row id, by Box and Muller's rule on two hashes."""
    u = [(F.pmod(F.xxhash64(F.col(row_id).cast("string"), F.lit(seed), F.lit(k)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52) for k in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def every(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


#: name -> strategy -> function (df, roles, **parameters) -> Fitted.
STEPS: dict[str, dict[str, Callable[..., Fitted]]] = {}


def step(name: str, *strategies: str):
    """Registers an operator under a step name; its function gets the strategy by keyword if it serves several."""

    def add(f):
        for s in strategies:
            STEPS.setdefault(name, {})[s] = (lambda df, roles, f=f, s=s, **p: f(df, roles, strategy=s, **p)) if len(strategies) > 1 else f
        return f

    return add


def fit(name: str, strategy: str, df: DataFrame, roles, **parameters) -> Fitted:
    """Fits the step's strategy; an unknown name or strategy is an error."""
    if name not in STEPS or strategy not in STEPS[name]:
        raise ValueError(f"unknown step {name}/{strategy}; known: {sorted(STEPS)} / {sorted(STEPS.get(name, {}))}")
    return STEPS[name][strategy](df, roles, **parameters)
