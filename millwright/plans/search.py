"""Repair by search: opaque and glass-box optimisers, grids, bandits, Q-learning. The driver decides, Spark evaluates."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

from .plan import GUARDS, LAST, STRATEGIES, Plan, canonical, change, delete, insert, swap, valid

Utility = Callable[[tuple[int, ...]], float]


@dataclass
class Outcome:
    """What a search found: the best candidate, its utility, evaluations spent, whether the goal was met."""

    best: object
    utility: float
    evaluations: int
    met: bool


class _Budget:
    def __init__(self, utility: Callable, goal: float, most: int):
        self.utility, self.goal, self.most = utility, goal, most
        self.seen: dict = {}
        self.best: tuple[float, object] = (float("inf"), None)

    def __call__(self, candidate) -> float:
        if candidate not in self.seen:
            self.seen[candidate] = self.utility(candidate)
            if self.seen[candidate] < self.best[0]:
                self.best = (self.seen[candidate], candidate)
        return self.seen[candidate]

    def done(self) -> bool:
        return self.best[0] <= self.goal or len(self.seen) >= self.most

    def outcome(self) -> Outcome:
        return Outcome(self.best[1], self.best[0], len(self.seen), self.best[0] <= self.goal)


def evaluate_all(candidates: Iterable, utility: Callable, threads: int = 4) -> dict:
    """Utilities of many candidates; their jobs run side by side."""
    todo = list(dict.fromkeys(candidates))
    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(todo, pool.map(utility, todo), strict=True))


def best_first(sizes: list[int], coefficients: list[float]) -> Iterator[tuple[int, ...]]:
    """All vectors in order of predicted utility, ties by vector. A heap holds the border of what was given out, so the space is never listed."""
    values = [sorted(range(1, n + 1), key=lambda x, c=c: (c * x, x)) for n, c in zip(sizes, coefficients, strict=True)]

    def entry(at: tuple[int, ...]) -> tuple:
        v = tuple(own[i] for own, i in zip(values, at, strict=True))
        return sum(c * x for c, x in zip(coefficients, v, strict=True)), v, at

    if not all(sizes):
        return
    border = [entry((0,) * len(sizes))]
    while border:
        _, v, at = heapq.heappop(border)
        yield v
        # each vector has one parent: the last place that is not the first steps back
        last = max((i for i, k in enumerate(at) if k), default=0)
        for i in range(last, len(at)):
            if at[i] + 1 < sizes[i]:
                heapq.heappush(border, entry((*at[:i], at[i] + 1, *at[i + 1 :])))


def opaque(start: tuple[int, ...], sizes: list[int], coefficients: list[float], utility: Utility, goal: float, most: int = 1000) -> Outcome:
    """Only utilities are visible. Each parameter, in order of its coefficient's magnitude, takes its most promising value; then all vectors follow in order of predicted utility."""
    run, now = _Budget(utility, goal, most), start
    run(now)
    for i in sorted(range(len(start)), key=lambda i: -abs(coefficients[i])):
        if run.done():
            return run.outcome()
        wish = 1 if coefficients[i] > 0 else sizes[i]
        if coefficients[i] and now[i] != wish:
            new = (*now[:i], wish, *now[i + 1 :])
            if run(new) <= run(now):
                now = new
    for v in best_first(sizes, coefficients):
        if run.done():
            break
        run(v)
    return run.outcome()


@dataclass(frozen=True)
class Intervention:
    """One edit of a plan with the evidence for it."""

    kind: str
    step: str
    strategy: str
    position: int
    similarity: float = 0.0
    predicted: float = 0.0

    def apply(self, plan: Plan) -> Plan | None:
        names = plan.names()
        if self.kind == "insert":
            return None if self.step in names else insert(plan, self.position, self.step, self.strategy)
        if self.step not in names:
            return None
        at = names.index(self.step)
        if self.kind == "change":
            return change(plan, at, self.strategy)
        return delete(plan, at) if self.kind == "delete" else swap(plan, at)


def interventions(plan: Plan, new_steps: Iterable[str] = ()) -> list[Intervention]:
    """All single edits: other strategies, insertions of new steps, deletions, swaps of neighbours."""
    out = []
    for i, (name, strategy) in enumerate(plan.steps):
        out += [Intervention("change", name, s, i) for s in STRATEGIES[name] if s != strategy]
        if name not in (*GUARDS, LAST):
            out.append(Intervention("delete", name, strategy, i))
        if swap(plan, i):
            out.append(Intervention("swap", name, strategy, i))
    first = sum(n in GUARDS for n in plan.names())
    last = len(plan.steps) - (LAST in plan.names())
    for name in new_steps:
        if name not in plan.names():
            out += [Intervention("insert", name, s, p) for s in STRATEGIES[name] if s not in ("none", "full") for p in range(first, last + 1)]
    return out


def ranked(found: list[Intervention], similarity: Callable[[Intervention], float], predicted: Callable[[Intervention], float], by: str = "similarity", weight: float = 0.5) -> list[Intervention]:
    """Interventions with their evidence, the best first: by similarity, predicted utility, or both fused."""
    full = [Intervention(x.kind, x.step, x.strategy, x.position, similarity(x), predicted(x)) for x in found]
    us = [x.predicted for x in full]
    low, high = min(us, default=0), max(us, default=0)
    fused = lambda x: weight * x.similarity + (1 - weight) * (1 - (x.predicted - low) / (high - low) if high > low else 1)
    key = {"similarity": lambda x: -x.similarity, "predicted": lambda x: x.predicted, "fused": lambda x: -fused(x)}[by]
    return sorted(full, key=lambda x: (key(x), x.kind, x.step, x.strategy, x.position))


def glass_box(plan: Plan, actions: list[Intervention], utility: Callable[[Plan], float], goal: float, most: int = 1000, top: int = 120, depth: int = 3) -> Outcome:
    """Profiles rank the actions. Single actions come first; then combinations of 2 .. depth of the best `top`, at most one a step; the first plan under the goal ends it."""
    run = _Budget(utility, goal, most)
    run(canonical(plan))
    best = actions[:top]
    for k in range(1, depth + 1):
        for combo in itertools.combinations(best, k):
            if run.done():
                return run.outcome()
            if len({a.step for a in combo}) < k:
                continue
            new: Plan | None = plan
            for a in combo:
                new = a.apply(new) if new is not None else None
            if new is not None and valid(canonical(new)):
                run(canonical(new))
    return run.outcome()


def grid(sizes: list[int]) -> Iterator[tuple[int, ...]]:
    yield from itertools.product(*(range(1, n + 1) for n in sizes))


def power_set(names: list[str], sizes: dict[str, int]) -> Iterator[dict[str, int]]:
    """Every subset of steps, small ones first, with every strategy vector."""
    for k in range(len(names) + 1):
        for chosen in itertools.combinations(names, k):
            for v in itertools.product(*(range(1, sizes[n] + 1) for n in chosen)):
                yield dict(zip(chosen, v, strict=True))


def random_order(candidates: Iterable, seed: int = 42) -> list:
    found = list(candidates)
    return [found[i] for i in np.random.default_rng(seed).permutation(len(found))]


def staged(start: tuple[int, ...], sizes: list[int]) -> Iterator[tuple[int, ...]]:
    """Vectors by the number of parameters that differ from the start, one change first."""
    for k in range(1, len(start) + 1):
        for at in itertools.combinations(range(len(start)), k):
            for values in itertools.product(*([v for v in range(1, sizes[i] + 1) if v != start[i]] for i in at)):
                new = list(start)
                for i, v in zip(at, values, strict=True):
                    new[i] = v
                yield tuple(new)


def search(candidates: Iterable, utility: Callable, goal: float, most: int = 1000, positive_only: bool = False) -> Outcome:
    """Evaluates candidates in order until one meets the goal; positive_only skips utilities of 0 or less as invalid."""
    run = _Budget(lambda c: float("inf") if (u := utility(c)) is None or (positive_only and u <= 0) else u, goal, most)
    for c in candidates:
        if run.done():
            break
        run(c)
    return run.outcome()


def two_phase(sizes: list[int], utility: Utility, goal: float, most: int = 1000) -> Outcome:
    """Each parameter alone from the first vector, then the grid of the best halves."""
    run, start = _Budget(utility, goal, most), tuple(1 for _ in sizes)
    run(start)
    keep = []
    for i, n in enumerate(sizes):
        score = {v: run((*start[:i], v, *start[i + 1 :])) for v in range(1, n + 1) if not run.done() or v == 1}
        keep.append(sorted(score, key=lambda v: (score[v], v))[: max(1, -(-n // 2))])
    for v in itertools.product(*keep):
        if run.done():
            break
        run(v)
    return run.outcome()


def thompson(arms: int, pull: Callable[[int], float], rounds: int = 100, seed: int = 42) -> tuple[int, np.ndarray]:
    """Gaussian Thompson sampling; the arm of best mean reward and the pulls of each."""
    rng, n, mean = np.random.default_rng(seed), np.zeros(arms), np.zeros(arms)
    for _ in range(rounds):
        a = int(np.argmax(rng.normal(mean, 1 / np.sqrt(n + 1e-3))))
        r = pull(a)
        n[a] += 1
        mean[a] += (r - mean[a]) / n[a]
    return int(np.argmax(np.where(n > 0, mean, -np.inf))), n


def choose_ranking(pilots: list, goal: float, methods: dict[str, Callable[[object], Outcome]]) -> str:
    """The ranking method that needs fewest evaluations on pilot runs."""
    return min(methods, key=lambda m: (float(np.mean([o.evaluations if (o := methods[m](p)).met else 10 * o.evaluations + 1 for p in pilots])), m))


def q_learning(blocks: list[list[str]], reward: Callable[[tuple[str, ...]], float], gamma: float = 0.8, beta: float = 1.0, episodes: int = 200, epsilon: float = 0.05, seed: int = 42) -> tuple[tuple[str, ...], np.ndarray]:
    """Walks ordered blocks of methods, one of each block; the reward of a whole walk stands on its last edge. Rewards are remembered."""
    nodes = [(b, m) for b, own in enumerate(blocks) for m in own]
    at = {x: i for i, x in enumerate(nodes)}
    q, rng, known = np.zeros((len(nodes) + 1, len(nodes))), np.random.default_rng(seed), {}
    choose = lambda s, b: max((at[b, m] for m in blocks[b]), key=lambda j: (q[s, j], -j))
    for episode in range(episodes):
        state, walk = len(nodes), []
        explore = max(epsilon, 1 - 2 * episode / episodes)  # the first half looks around
        for b in range(len(blocks)):
            nxt = at[b, blocks[b][rng.integers(len(blocks[b]))]] if rng.random() < explore else choose(state, b)
            walk.append((state, nxt))
            state = nxt
        plan = tuple(nodes[j][1] for _, j in walk)
        if plan not in known:
            known[plan] = reward(plan)
        for k, (s, j) in reversed(list(enumerate(walk))):
            future = max((q[j, at[k + 1, m]] for m in blocks[k + 1]), default=0.0) if k + 1 < len(blocks) else 0.0
            gain = 100 * known[plan] if k == len(walk) - 1 else 0.0
            q[s, j] += beta * (max(gain + gamma * future, q[s, j]) - q[s, j])
    state, out = len(nodes), []
    for b in range(len(blocks)):
        state = choose(state, b)
        out.append(nodes[state][1])
    return tuple(out), q


def multi_start(starts: list[tuple[int, ...]], neighbours: Callable[[tuple[int, ...]], list[tuple[int, ...]]], utility: Utility, goal: float, most: int = 1000) -> Outcome:
    """Several starts go downhill together, a step each in turn."""
    run, now = _Budget(utility, goal, most), list(starts)
    for s in now:
        run(s)
    moved = True
    while moved and not run.done():
        moved = False
        for i, s in enumerate(now):
            for n in neighbours(s):
                if run.done():
                    return run.outcome()
                if run(n) < run(now[i]):
                    now[i], moved = n, True
                    break
    return run.outcome()
