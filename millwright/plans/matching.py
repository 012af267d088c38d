"""Entity resolution as a plan: blocks, cleaning, comparison weights, matching; and the search for its parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import kinds as K
from .history import rank_parameters
from .search import Outcome, opaque

#: Weighting schemes by their number (fixed values).
SCHEMES = ("arcs", "cbs", "ecbs", "js")
PARAMETERS = ("purge", "block_threshold", "weighting", "match_threshold")


@dataclass
class Matcher:
    """Runs parameter choices over one table (deduplication) or two (linkage) and compares with the truth.

    The truth is a table (id1, id2), or the columns in which the records of true pairs agree. Scores count kinds of
    records; candidates() and scored() list pairs.
    """

    left: DataFrame
    truth: DataFrame | list[str]
    key: str
    columns: list[str]
    right: DataFrame | None = None
    qgram: int = 0
    block_column: str | None = None
    runs: dict[tuple, dict[float, float]] = field(default_factory=dict)
    cleaned: dict[tuple, list] = field(default_factory=dict)

    def _blocks(self, df: DataFrame) -> DataFrame:
        return E.blocks(df, self.key, self.block_column or self.columns[0], self.qgram)

    def candidates(self, purge: bool, theta: float, scheme: str) -> DataFrame:
        """(id1, id2, weight) after block cleaning and edge pruning."""
        left, right = self._blocks(self.left), None if self.right is None else self._blocks(self.right)
        if purge:
            kept = E.purge(E.block_sizes(left, right), theta).select("token")
            left, right = left.join(kept, "token", "left_semi"), None if right is None else right.join(kept, "token", "left_semi")
        else:
            left, right = E.filter_blocks(left, theta), None if right is None else E.filter_blocks(right, theta)
        return E.prune_edges(E.weights(left, scheme, right))

    def scored(self, purge: bool, theta: float, scheme: str) -> DataFrame:
        """(id1, id2, sim) of the candidates that are left."""
        other = self.left if self.right is None else self.right
        return E.similarities(self.candidates(purge, theta, scheme).select("id1", "id2"), self.left, other, self.key, self.key, [(c, c) for c in self.columns])

    def _items(self):
        column = self.block_column or self.columns[0]
        return E.qgrams(column, self.qgram) if self.qgram > 0 else E.tokens(column)

    def _tables(self) -> list[DataFrame]:
        return [self.left] if self.right is None else [self.left, self.right]

    @cached_property
    def _sides(self) -> list[K.Side]:
        truth = self.truth if isinstance(self.truth, list) else []
        return [K.Side.of(x, self.key, self._items(), self.columns, truth) for x in self._tables()]

    @cached_property
    def _true(self) -> tuple[DataFrame, int]:
        """True pairs between token sets, and the number of all true pairs."""
        left, right = self._sides[0], self._sides[1] if len(self._sides) > 1 else None
        if not isinstance(self.truth, list):
            sets = [K.sets(x, self.key, self._items(), self.columns) for x in self._tables()]
            return K.listed_pairs(self.truth, left, right, sets[0], sets[-1]), self.truth.select("id1", "id2").distinct().count()
        sizes = [x.dropna("any", subset=self.truth).groupBy(*self.truth).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, x in enumerate(self._tables())]
        both = sizes[0].select((F.col("n0") * (F.col("n0") - 1) / 2).alias("n")) if right is None else sizes[0].join(sizes[1], self.truth).select((F.col("n0") * F.col("n1")).alias("n"))
        return K.true_pairs(left, right), int(both.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def _classes(self, purge: bool, theta: float) -> list[tuple[DataFrame, DataFrame]]:
        """For each table the classes of records whose blocks are equal after cleaning, and the class of each token set."""
        if (purge, theta) not in self.cleaned:
            members = [s.members() for s in self._sides]
            if purge:
                kept = E.purge(E.block_sizes(*members), theta).select("token")
                members = [m.join(kept, "token", "left_semi") for m in members]
            else:
                members = [E.filter_blocks(m, theta) for m in members]
            self.cleaned[purge, theta] = [K.classed(m) for m in members]
        return self.cleaned[purge, theta]

    def confusion(self, purge: bool, theta: float, scheme: str, thetas: list[float]) -> DataFrame:
        """entities.confusion() of scored(), without its pairs."""
        found = self._classes(purge, theta)
        met = E.written(E.class_edges(*(classes for classes, _ in found), scheme=scheme))
        true, total = self._true
        right = self._sides[1] if len(self._sides) > 1 else None
        return K.confusion(E.prune_classes(met), self._sides[0], right, (found[0][1], found[-1][1]), true, total, thetas)

    def f_scores(self, purge: bool, theta: float, scheme: str, thetas: list[float]) -> dict[float, float]:
        """F by matching threshold; all thresholds of a choice come from one pass, and choices are remembered."""
        known = self.runs.setdefault((purge, theta, scheme), {})
        lack = [t for t in thetas if t not in known]
        if lack:
            known |= {r["theta"]: float(r["f"]) for r in self.confusion(purge, theta, scheme, lack).select("theta", "f").collect()}
        return {t: known[t] for t in thetas}


@dataclass(frozen=True)
class Space:
    """Values of the four parameters: purge blocks (1) or filter them (0), block threshold, scheme number, matching threshold."""

    purge: tuple[int, ...] = (0, 1)
    block: tuple[float, ...] = (0.05, 0.5, 0.95)
    scheme: tuple[int, ...] = (0, 1, 2, 3)
    match: tuple[float, ...] = (0.05, 0.5, 0.95)

    def values(self) -> list[tuple]:
        return [self.purge, self.block, self.scheme, self.match]

    def at(self, places: tuple[int, ...]) -> tuple:
        """Values of 1-based places."""
        return tuple(v[p - 1] for v, p in zip(self.values(), places, strict=True))


def f_of(matcher: Matcher, space: Space, places: tuple[int, ...]) -> float:
    purge, theta, scheme, match = space.at(places)
    return matcher.f_scores(bool(purge), theta, SCHEMES[scheme], list(space.match))[match]


def history(spark: SparkSession, matcher: Matcher, space: Space) -> DataFrame:
    """(purge, block_threshold, weighting, match_threshold, f) of every choice of the space; one pass for each but the last parameter."""
    rows = []
    for p in space.purge:
        for b in space.block:
            for s in space.scheme:
                rows += [(p, float(b), s, float(m), f) for m, f in matcher.f_scores(bool(p), b, SCHEMES[s], list(space.match)).items()]
    return spark.createDataFrame(rows, "purge int, block_threshold double, weighting int, match_threshold double, f double")


def search(matcher: Matcher, space: Space, past: DataFrame, start: tuple[int, ...], goal: float, most: int = 1000) -> Outcome:
    """Parameters in order of the magnitude of their coefficient in past runs, each to its promising end, then all by predicted F; stops at an F of the goal. The outcome's utility is 1 - F."""
    coefficient = dict(rank_parameters(past, list(PARAMETERS), "f"))
    return opaque(start, [len(v) for v in space.values()], [-coefficient[p] for p in PARAMETERS], lambda places: 1 - f_of(matcher, space, places), 1 - goal, most)
