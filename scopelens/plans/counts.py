"""Counted cases of one scope or of many, the input of every report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from scopelens.model import SCOPE_ID, TOTAL, Period
from scopelens.operators.aggregate import count_rows
from scopelens.operators.filters import in_period
from scopelens.plans.membership import MANY_SCOPES, counts_by_scope
from scopelens.sources.scopes import Scope, covering, explode_membership, membership

Scopes = Scope | Sequence[Scope]


def by_columns(scope: Scopes) -> list[str]:
    """A list of scopes gives results with a scope column; a single scope gives none."""
    return [] if isinstance(scope, Scope) else [SCOPE_ID]


def split_rows(cases: DataFrame, scope: Scopes) -> tuple[DataFrame, list[str]]:
    """The cases of the scopes, and the columns by which counts can be told apart by scope."""
    if isinstance(scope, Scope):
        return cases.where(scope.predicate), []
    rows = cases.where(covering(scope))
    dimensions = scope[0].dimensions
    if dimensions:
        return rows, list(dimensions)
    words = membership(scope)
    return rows.withColumns(words), list(words)


def by_scope(counts: DataFrame, scope: Scopes, kept: Sequence[str] = ()) -> DataFrame:
    """Counts by the columns of ``split_rows``, as counts of each scope; ``kept`` dimensions are keys as well."""
    if isinstance(scope, Scope):
        return counts
    if scope[0].dimensions:
        if len(scope) >= MANY_SCOPES and TOTAL in counts.columns:
            keys = [name for name in counts.columns if name != TOTAL and (name in kept or name not in scope[0].dimensions)]
            return counts_by_scope(counts, scope, keys)
        counts = counts.withColumns(membership(scope))
    return explode_membership(counts, scope)


def scope_counts(
    cases: DataFrame,
    scope: Scopes,
    keys: Sequence[str],
    period: Period | None,
    condition: Column | None = None,
) -> DataFrame:
    """Cases of a period counted by raw columns, in one scan however many scopes there are.

    With a list of scopes a combination of keys can come in several rows of a scope, which differ in
    what else their cases belong to; whatever sums them by label also joins these.
    """
    rows = in_period(cases, period)
    if condition is not None:
        rows = rows.where(condition)
    rows, apart = split_rows(rows, scope)
    counts = count_rows(rows, list(dict.fromkeys([*apart, *keys])))
    return by_scope(counts, scope, keys).select(*by_columns(scope), *keys, TOTAL)
