"""Repair by evidence: histories of plans that ran, and interventions ranked by how near they bring a failing plan's data to what passing plans saw."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..data import Roles
from ..functions.er_profile import populate
from .history import sampled_vectors
from .plan import LAST, STRATEGIES, Executor, Plan, canonical, from_vector, valid
from .search import Intervention, Outcome, glass_box, ranked


def prepared_profile(run: Executor, plan: Plan) -> dict[str, float]:
    """The profile of the data that the plan's model would get: associations with the target, outlier shares, rows kept. No model is fitted."""
    frame = run.run(plan)
    out = {k: 0.0 if v is None or math.isnan(v) else float(v) for k, v in populate(frame, Roles(target=run.roles.target, row_id=run.roles.row_id, exclude=run.roles.exclude)).items()}
    rows = frame.count()
    return out | {"rows_kept": round(rows / max(1, run.size), 4)}


def write_history(spark: SparkSession, run: Executor, names: list[str], n: int, path: str | None = None, seed: int = 42, strategies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Runs n plans, drawn without repeats from the space of strategies of the named steps, and returns (or also writes) one row for each.

    A row has the 1-based place of every step's strategy, the profile of the
    prepared data, and the utility. Plans that begin alike share their frames.
    """
    known = strategies or STRATEGIES
    rows = []
    for vector in sampled_vectors({s: len(known[s]) for s in names}, n, seed):
        plan = canonical(Plan(tuple((s, known[s][v - 1]) for s, v in zip(names, vector, strict=True))))
        rows.append(dict(zip(names, map(int, vector), strict=True)) | {f"profile_{k}": v for k, v in prepared_profile(run, plan).items()} | {f"utility_{run.metric}": float(run.utility(plan))})
    columns = list(dict.fromkeys(c for r in rows for c in r))
    kinds = ", ".join(f"`{c}` {'int' if c in names else 'double'}" for c in columns)
    out = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], kinds)
    if path is not None:
        out.write.mode("overwrite").option("header", True).csv(path) if path.endswith(".csv") else out.write.mode("overwrite").parquet(path)
    return out


def passing_profile(history: DataFrame, utility: str, goal: float) -> dict[str, float]:
    """The mean profile of the runs under the goal; of all runs if none is."""
    rows = history.collect()  # one row for each plan that ran
    good = [r for r in rows if r[utility] is not None and abs(r[utility]) <= goal] or rows
    names = [c for c in history.columns if c.startswith("profile_")]
    return {c.removeprefix("profile_"): float(np.mean([r[c] or 0.0 for r in good])) for c in names}


def nearness(a: dict[str, float], b: dict[str, float]) -> float:
    """1 / (1 + distance) of two profiles; what one of them lacks counts as 0."""
    names = sorted({*a, *b})
    return 1 / (1 + math.sqrt(sum((a.get(n, 0.0) - b.get(n, 0.0)) ** 2 for n in names)))


def by_profiles(run: Executor, plan: Plan, actions: Iterable[Intervention], target: dict[str, float]) -> list[Intervention]:
    """The actions, ranked by the nearness of the data they prepare to the target profile; actions that make no valid plan are left out."""
    found, near = [], {}
    for action in actions:
        new = action.apply(plan)
        if new is None or not valid(canonical(new)):
            continue
        found.append(action)
        near[action] = nearness(prepared_profile(run, canonical(new)), target)
    return ranked(found, lambda a: near[a], lambda a: 0.0)


def before_and_after(run: Executor, plan: Plan, actions: Iterable[Intervention], target: dict[str, float]) -> list[tuple[Intervention, float, float]]:
    """(action, nearness before, nearness after) around the step that the action touches only, those first that gain most."""
    out = []
    for action in actions:
        new = action.apply(plan)
        if new is None or not valid(canonical(new)):
            continue
        steps = [s for s in canonical(new).steps if s[0] != LAST]
        at = next((i for i, (n, _) in enumerate(steps) if n == action.step), len(steps) - 1)
        before = nearness(prepared_profile(run, Plan(tuple(steps[:at]))), target)
        after = nearness(prepared_profile(run, Plan(tuple(steps[: at + 1]))), target)
        out.append((action, round(before, 9), round(after, 9)))
    return sorted(out, key=lambda x: (x[1] - x[2], x[0].kind, x[0].step, x[0].strategy, x[0].position))


def repair(run: Executor, plan: Plan, actions: Iterable[Intervention], target: dict[str, float], goal: float, most: int = 1000, depth: int = 3) -> Outcome:
    """The glass-box search with actions ranked by profiles."""
    return glass_box(plan, by_profiles(run, plan, actions, target), run.utility, goal, most=most, depth=depth)


def grid_of(names: list[str], strategies: dict[str, tuple[str, ...]] | None = None) -> list[Plan]:
    """Every plan over the named steps, in order of their vectors."""
    known = strategies or STRATEGIES
    sizes = [len(known[n]) for n in names]
    out = []
    for k in range(int(np.prod(sizes))):
        vector = []
        for n in reversed(sizes):
            k, r = divmod(k, n)
            vector.append(r + 1)
        vector = list(reversed(vector))
        out.append(canonical(Plan(tuple((s, known[s][v - 1]) for s, v in zip(names, vector, strict=True)))) if strategies else canonical(from_vector(names, tuple(vector))))
    return out
