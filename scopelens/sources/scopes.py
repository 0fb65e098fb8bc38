"""Scopes: numbered, hierarchical filters over the case table."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scopelens.functions.labels import strip_brackets, title_case
from scopelens.model import SCOPE_ID
from scopelens.session import stored

# A membership word is a long; 60 of its bits are used.
WORD_BITS = 60


@dataclass(frozen=True)
class Scope:
    """A scope with its conditions from the root down, and the columns these are confined to."""

    scope_id: int
    conditions: tuple[str, ...]
    dimensions: tuple[str, ...] = ()

    @property
    def predicate(self) -> Column:
        """A case is in the scope if all conditions are true."""
        return reduce(operator.and_, [F.expr(c) for c in self.conditions], F.lit(True))


class ScopeRegistry:
    """Scope definitions: a SQL condition over case columns, and the scope it narrows.

    ``dimensions`` may name the columns all conditions are confined to, if these have few values
    (month, channel, region). Many scopes are then told apart after counting by these columns,
    which takes the conditions from once per case to once per group.
    """

    def __init__(self, dimensions: Sequence[str] = ()) -> None:
        self._dimensions = tuple(dimensions)
        self._nodes: dict[int, tuple[int | None, str | None]] = {}

    def add(self, scope_id: int, condition: str | None = None, parent: int | None = None) -> ScopeRegistry:
        if parent is not None and parent not in self._nodes:
            raise KeyError(f"scope {scope_id}: unknown parent {parent}")
        if scope_id in self._nodes:
            raise ValueError(f"scope {scope_id} is already defined")
        self._nodes[scope_id] = (parent, condition)
        return self

    @classmethod
    def from_table(cls, rows: DataFrame, dimensions: Sequence[str] = (), most: int = 10_000) -> ScopeRegistry:
        """Scopes from rows of ``scope_id``, ``parent_id`` and ``condition``, in any order.

        A registry is kept by the driver, so more than ``most`` rows are an error. So are repeated or
        NULL ids, unknown parents, and scopes that narrow each other in a circle.
        """
        found = rows.select("scope_id", "parent_id", "condition").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} scopes")
        registry = cls(dimensions)
        for scope_id, parent, condition in found:
            if scope_id is None or scope_id in registry._nodes:
                raise ValueError(f"scope {scope_id} is already defined" if scope_id is not None else "a scope without an id")
            registry._nodes[scope_id] = (parent, condition)
        sound: set[int] = set()
        for scope_id in registry._nodes:
            path: list[int] = []
            at: int | None = scope_id
            while at is not None and at not in sound:
                if at not in registry._nodes:
                    raise KeyError(f"scope {path[-1]}: unknown parent {at}")
                if at in path:
                    raise ValueError(f"scopes {path[path.index(at):]} narrow each other in a circle")
                path.append(at)
                at = registry._nodes[at][0]
            sound.update(path)
        return registry

    def ids(self) -> list[int]:
        return sorted(self._nodes)

    def scope(self, scope_id: int) -> Scope:
        conditions = []
        at: int | None = scope_id
        while at is not None:
            if at not in self._nodes:
                raise KeyError(f"unknown scope {at}")
            at, condition = self._nodes[at]
            if condition:
                conditions.append(condition)
        return Scope(scope_id, tuple(reversed(conditions)), self._dimensions)

    def scopes(self, scope_ids: Iterable[int]) -> list[Scope]:
        return [self.scope(scope_id) for scope_id in scope_ids]


def apply_scope(cases: DataFrame, registry: ScopeRegistry, scope_id: int) -> DataFrame:
    return cases.where(registry.scope(scope_id).predicate)


def any_scope(scopes: Sequence[Scope]) -> Column:
    return reduce(operator.or_, [scope.predicate for scope in scopes])


def covering(scopes: Sequence[Scope]) -> Column:
    """A cheap condition that every case of any of the scopes meets, for the scan.

    A scope lies within its root, so the roots' conditions do; many scopes share few roots.
    """
    if not all(scope.conditions for scope in scopes):
        return F.lit(True)
    roots = dict.fromkeys(scope.conditions[0] for scope in scopes)
    return reduce(operator.or_, [F.expr(condition) for condition in roots])


def distinct_conditions(scopes: Sequence[Scope]) -> list[str]:
    return list(dict.fromkeys(condition for scope in scopes for condition in scope.conditions))


def membership(scopes: Sequence[Scope]) -> dict[str, Column]:
    """Which of the scopes' conditions a case meets, one bit each, as a few long columns.

    Cases are counted by these words, and only the counts are copied to each scope. Exploding the
    cases instead would copy every case once per scope it is in. Conditions that scopes share, as
    all children share their parents', are evaluated once.
    """
    conditions = distinct_conditions(scopes)
    words = {}
    for at in range(0, len(conditions), WORD_BITS):
        bits = [
            f"if({condition}, {1 << place}L, 0L)"
            for place, condition in enumerate(conditions[at : at + WORD_BITS])
        ]
        words[f"_scopes_{at // WORD_BITS}"] = F.expr(" | ".join(bits))
    return words


def explode_membership(counts: DataFrame, scopes: Sequence[Scope]) -> DataFrame:
    """Counted rows with membership words, as one row for each scope they belong to."""
    places = {condition: place for place, condition in enumerate(distinct_conditions(scopes))}
    words = [f"_scopes_{at}" for at in range(-(-len(places) // WORD_BITS))]

    def belongs(scope: Scope) -> str:
        needed = dict.fromkeys(words, 0)
        for condition in scope.conditions:
            word, bit = divmod(places[condition], WORD_BITS)
            needed[words[word]] |= 1 << bit
        return " AND ".join(f"{word} & {mask}L = {mask}L" for word, mask in needed.items() if mask) or "true"

    # One expression text: a hundred scopes would be thousands of calls as Column objects.
    ids = ", ".join(f"if({belongs(scope)}, {scope.scope_id}, null)" for scope in scopes)
    return counts.withColumn(SCOPE_ID, F.expr(f"explode(array_compact(array({ids})))")).drop(*words)


def scope_label(catalogue: DataFrame, scope_id: int, name: str = "name") -> DataFrame:
    """A scope's name as shown in captions: looked up by id, without brackets, in title case."""
    found = catalogue.where(F.col(SCOPE_ID) == scope_id)
    return found.select(SCOPE_ID, title_case(strip_brackets(F.col(name))).alias("label"))


#: Levels of a hierarchy that ``scope_paths`` follows.
MOST_LEVELS = 100

def _twice_as_far(ways: DataFrame) -> DataFrame:
    """Open ways (root first) with the way of the scope above them put before; those that have closed a circle are cut there.

    Only ways that are needed are joined, each once: near the root a few serve almost all scopes.
    """
    open_ways = ways.where("open")
    upper = ways.selectExpr("id AS at", "at AS up_at", "ids AS up_ids", "names AS up_names", "open AS up_open")
    needed = upper.join(open_ways.select("at").distinct(), "at")
    found = F.col("up_ids").isNotNull()
    joined = open_ways.join(needed, "at", "left").select(
        "id",
        F.when(found, F.col("up_at")).otherwise(F.col("at")).alias("at"),
        F.when(found, F.concat("up_ids", "ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(found, F.concat("up_names", "names")).otherwise(F.col("names")).alias("names"),
        F.coalesce("up_open", F.lit(False)).alias("open"),
    )
    # the scopes of a circle follow each other again and again, so the first repeat comes after all that differ
    length = F.least(F.size("ids"), F.size(F.array_distinct("ids")) + 1)
    circular = F.size("ids") > F.size(F.array_distinct("ids"))
    cut = [F.slice(name, F.size("ids") - length + 1, length).alias(name) for name in ("ids", "names")]
    moved = joined.select("id", "at", *cut, (F.col("open") & ~circular).alias("open"), circular.alias("circular"))
    return ways.where("NOT open").unionByName(moved)


def scope_paths(catalogue: DataFrame, name: str = "name", parent: str = "parent_id", separator: str = " / ", levels: int = MOST_LEVELS) -> DataFrame:
    """Each scope's way down from its root: ``path`` of shown names, ``ids``, ``depth`` (a root's is 0) and ``state``.

    The state is ``complete``, ``orphan`` if the uppermost scope found names a parent that is not in the catalogue, or
    ``circle`` if scopes narrow each other in a circle; the path of these then begins where the circle closes.
    More than ``levels`` levels are an error, as are repeated ids of parents: each would double the paths.
    Ways double their length in each round and are written to the shared folder, so ``levels`` take their logarithm in rounds.
    """
    ids = catalogue.groupBy(SCOPE_ID).count()
    once = ids.agg(F.coalesce(F.max("count"), F.lit(0)) > 1).scalar()
    checked = catalogue.select(
        F.when(once & F.col(SCOPE_ID).isNotNull(), F.raise_error(F.lit("a scope is defined twice")).cast("long")).otherwise(F.col(SCOPE_ID)).alias("id"),
        F.col(parent).cast("long").alias("parent"),
        title_case(strip_brackets(F.coalesce(F.col(name), F.lit("")))).alias("shown"),
    )
    first = ("id", "parent AS at", "array(id) AS ids", "array(shown) AS names", "parent IS NOT NULL AS open", "false AS circular")
    found = stored(checked.where("id IS NOT NULL").selectExpr(*first))
    while True:
        longest, unfinished = found.agg(F.max(F.size("ids")), F.bool_or("open")).first()
        if (longest or 0) > levels:
            raise ValueError(f"scopes narrow each other over more than {levels} levels")
        if not unfinished:
            break
        found = stored(_twice_as_far(found))
    state = F.when(F.col("circular"), "circle").when(F.col("at").isNotNull(), "orphan").otherwise("complete")
    return found.select(F.col("id").alias(SCOPE_ID), F.array_join("names", separator).alias("path"), "ids", (F.size("ids") - 1).alias("depth"), state.alias("state"))
