"""A pipeline as data: ordered steps with strategies, and the edits that repair makes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame

from ..data import Roles
from ..operators import base, duplicates, features, missing, outliers, sampling, scaling, text  # noqa: F401  (they register their steps)
from ..operators.models import evaluate

#: Steps that stand first, in this order, and the one that stands last.
GUARDS, LAST = ("invalid_value", "missing_value"), "model"
#: Strategies of each step by 1-based place (fixed values).
STRATEGIES: dict[str, tuple[str, ...]] = {
    "invalid_value": ("none", "sentinel", "regex", "both"),
    "missing_value": ("drop", "mean", "median", "most_frequent", "knn"),
    "normalization": ("none", "ss", "rs", "ma", "mm"),
    "outlier": ("none", "if", "iqr", "lof"),
    "distribution_shape": ("none", "log1p", "sqrt", "yeojohnson", "boxcox"),
    "floating_point": ("none", "snap", "round", "both"),
    "deduplication": ("none", "dd"),
    "multicollinearity": ("none", "drop_high_vif"),
    "fselection": ("none", "variance_off", "mutual_info"),
    "poly_pca": ("none", "pca", "sparsepca", "minibatchsparsepca", "kernelpca"),
    "nonlinear_transform": ("none", "quantile", "power"),
    "sampling": ("full", "random", "snapshot", "stratified"),
    "lowercase": ("none", "apply"),
    "punctuation": ("none", "apply"),
    "whitespace": ("none", "apply"),
    "stopword": ("none", "apply"),
    "special_character": ("none", "apply"),
    "model": ("lr", "nb", "rf", "dt", "svm", "nn", "reg"),
}
#: Numbers of neighbours that the last strategy of these steps stands for when a plan counts them as strategies of their own (fixed values).
NEIGHBOURS = {"missing_value": (1, 5, 10, 20, 30), "outlier": (1, 5, 10, 20, 30)}


def with_neighbours(step: str, place: int) -> tuple[str, dict]:
    """The strategy and parameters of a 1-based place in a step's list whose last entry is one for each number of neighbours."""
    plain = len(STRATEGIES[step]) - 1
    if place <= plain:
        return STRATEGIES[step][place - 1], {}
    many = NEIGHBOURS[step]
    return STRATEGIES[step][-1], {"k": many[min(place - plain, len(many)) - 1]}


@dataclass(frozen=True)
class Plan:
    """Steps (name, strategy) in order; parameters by step name."""

    steps: tuple[tuple[str, str], ...]
    parameters: dict = field(default_factory=dict, compare=False)

    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def vector(self) -> tuple[int, ...]:
        """1-based strategy places."""
        return tuple(STRATEGIES[n].index(s) + 1 for n, s in self.steps)


def from_vector(names: list[str], vector: tuple[int, ...]) -> Plan:
    """Places outside 1 .. n become the nearest one."""
    return Plan(tuple((n, STRATEGIES[n][min(max(1, v), len(STRATEGIES[n])) - 1]) for n, v in zip(names, vector, strict=True)))


def canonical(plan: Plan) -> Plan:
    """Each step once (the first counts), guards first, the model last."""
    seen: dict[str, str] = {}
    for n, s in plan.steps:
        seen.setdefault(n, s)
    rank = lambda n: GUARDS.index(n) if n in GUARDS else len(GUARDS) + (n == LAST)
    return replace(plan, steps=tuple(sorted(seen.items(), key=lambda x: rank(x[0]))))


def valid(plan: Plan, must_precede: tuple[tuple[str, str], ...] = ()) -> bool:
    names = plan.names()
    return canonical(plan).steps == plan.steps and all(a not in names or b not in names or names.index(a) < names.index(b) for a, b in must_precede)


def swap(plan: Plan, i: int, must_precede: tuple[tuple[str, str], ...] = ()) -> Plan | None:
    """Exchanges step i with the next; None where a guard, the model or a precedence forbids it."""
    if not 0 <= i < len(plan.steps) - 1:
        return None
    s = list(plan.steps)
    s[i], s[i + 1] = s[i + 1], s[i]
    out = replace(plan, steps=tuple(s))
    return out if valid(out, must_precede) else None


def insert(plan: Plan, at: int, name: str, strategy: str) -> Plan:
    return replace(plan, steps=(*plan.steps[:at], (name, strategy), *plan.steps[at:]))


def delete(plan: Plan, at: int) -> Plan | None:
    """Without step `at`; guards and the model stay."""
    if plan.steps[at][0] in (*GUARDS, LAST):
        return None
    return replace(plan, steps=(*plan.steps[:at], *plan.steps[at + 1 :]))


def change(plan: Plan, at: int, strategy: str) -> Plan:
    return replace(plan, steps=(*plan.steps[:at], (plan.steps[at][0], strategy), *plan.steps[at + 1 :]))


class Executor:
    """Runs plans over one frame. Frames of plan prefixes are remembered, so plans that begin alike share work."""

    def __init__(self, df: DataFrame, roles: Roles, metric: str = "accuracy_score"):
        self.df, self.roles, self.metric = df, roles, metric
        self.prefixes: dict[tuple, DataFrame] = {(): df}
        self.utilities: dict[tuple, float] = {}

    @cached_property
    def size(self) -> int:
        """Rows of the frame before any step."""
        return self.df.count()

    def frame(self, steps: tuple[tuple[str, str], ...], parameters: dict) -> DataFrame:
        steps = tuple(s for s in steps if s[0] != LAST)
        if steps not in self.prefixes:
            before = self.frame(steps[:-1], parameters)
            name, strategy = steps[-1]
            self.prefixes[steps] = base.fit(name, strategy, before, self.roles, **parameters.get(name, {}))(before)
        return self.prefixes[steps]

    def run(self, plan: Plan) -> DataFrame:
        return self.frame(canonical(plan).steps, plan.parameters)

    def utility(self, plan: Plan) -> float:
        """Utility of the plan's model on its own output; lower is better, sp counts by magnitude."""
        plan = canonical(plan)
        if plan.steps not in self.utilities:
            model = dict(plan.steps).get(LAST, "lr")
            value = evaluate(self.run(plan), self.roles, model, self.metric)
            self.utilities[plan.steps] = abs(value) if self.metric == "sp" else value
        return self.utilities[plan.steps]
