"""All counts of a report pack from few scans, made once and kept.

The reports of a pack differ only in grouping columns, scope and months, and every measure is a
count. Reports with the same grouping columns share one aggregate, with a count for the range and
for its first and last month side by side. What is left is as large as the sets of labels, and all
reports start there. The aggregates come in one of two ways:

``ONE_PASS``
    One scan; each case is copied once per set of grouping columns before it is counted. For cases
    that are costly to produce, such as a join.
``PER_KEY_SET``
    One narrow scan per set of grouping columns, all in one job. The sets have no column in common,
    so a columnar table is read once in total, and no case is copied. For stored cases.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from scopelens.functions.months import within
from scopelens.model import BRAND, FIRST, LAST, MONTH, MONTHS, RANGE, SCOPE_ID, TOTAL, ReportParams
from scopelens.operators.filters import in_period
from scopelens.operators.sets import union_all
from scopelens.plans.counts import Scopes, by_columns, by_scope, scope_counts, split_rows
from scopelens.plans.reports import shown_brands
from scopelens.session import stored
from scopelens.sources.scopes import ScopeRegistry
from scopelens.vocabulary import PORTUGUESE, Taxonomy

ONE_PASS, PER_KEY_SET = "one_pass", "per_key_set"

TRADITIONAL, DIGITAL = "traditional", "digital"

# Besides the sets of grouping columns, named by them: cases by month, and the brand list.
CHANNELS, BRANDS = "channels", "brands"

KeySet = tuple[str, ...]


def part_name(keys: Sequence[str]) -> str:
    return ",".join(keys)


class SharedCounts:
    """The counted cases of one pack.

    Columns: ``part``, the values of its grouping columns in order (``key_0``, ...) or ``month``,
    and the counts; for packs of many scopes ``scope_id`` as well. Parts are told apart by name,
    never by NULL keys: labels can be NULL too.
    """

    def __init__(self, aggregate: DataFrame, taxonomy: Taxonomy = PORTUGUESE, listed: DataFrame | None = None) -> None:
        self.aggregate = aggregate
        self.by = [SCOPE_ID] if SCOPE_ID in aggregate.columns else []
        self._taxonomy = taxonomy
        self._listed = listed

    def counts(self, keys: Sequence[str], months: Sequence[str]) -> DataFrame:
        """As ``count_rows`` gives for the scope, for each of the asked months."""
        measures = F.array(*[F.struct(F.lit(name).alias(MONTHS), F.col(name).alias(TOTAL)) for name in months])
        named = [F.col(f"key_{at}").alias(name) for at, name in enumerate(keys)]
        return self._part(part_name(keys)).select(*self.by, *named, F.inline(measures)).where(F.col(TOTAL) > 0)

    def channels(self) -> DataFrame:
        return self._part(CHANNELS).select(*self.by, MONTH, TRADITIONAL, DIGITAL)

    def brands(self) -> DataFrame:
        if self._listed is not None:
            return self._listed
        brands = self._part(BRANDS).select(*self.by, F.col("key_0").alias(BRAND))
        return shown_brands(brands, self._taxonomy, self.by)

    def _part(self, name: str) -> DataFrame:
        return self.aggregate.where(F.col("part") == name)


def month_flags(cases: DataFrame, params: ReportParams) -> dict[str, Column]:
    return {name: within(params.months[name], cases.columns) for name in (RANGE, FIRST, LAST)}


def channel_flags(cases: DataFrame, registry: ScopeRegistry, params: ReportParams) -> dict[str, Column]:
    period = F.lit(True) if params.channel_period is None else within(params.channel_period, cases.columns)
    ids = {TRADITIONAL: params.traditional_scope, DIGITAL: params.digital_scope}
    return {name: registry.scope(scope_id).predicate & period for name, scope_id in ids.items()}


def counted(grouped: GroupedData, flags: Sequence[str]) -> DataFrame:
    return grouped.agg(*[F.count_if(F.col(name)).alias(name) for name in flags])


def one_pass(
    cases: DataFrame,
    registry: ScopeRegistry,
    params: ReportParams,
    scope: Scopes,
    key_sets: Sequence[KeySet],
    channels: bool = False,
) -> DataFrame:
    """Every part from one scan of the period, with one shuffle of partial counts.

    ``channels`` adds the cases by month, for a single scope; the channels' own period must then lie
    within the report's.
    """
    rows, flags = in_period(cases, params.period), month_flags(cases, params)
    if channels:
        # Cases of the channels but not of the scope stay in, to be counted for the channels alone.
        flags = {name: registry.scope(params.scope).predicate & months for name, months in flags.items()}
        flags |= channel_flags(cases, registry, params)
        apart: list[str] = []
        # The bare conditions can reach the scan, which the flags below, NULL counted as false, cannot.
        rows = rows.where(reduce(operator.or_, flags.values()))
    else:
        rows, apart = split_rows(rows, scope)
    # A condition that is NULL does not count.
    known = {name: F.coalesce(condition, F.lit(False)) for name, condition in flags.items()}
    rows = rows.withColumns(known).where(reduce(operator.or_, map(F.col, known)))

    width = max((len(keys) for keys in key_sets), default=0)
    text, day = F.lit(None).cast("string"), F.lit(None).cast("date")

    def entry(name: str, keys: Sequence[str], month: Column) -> Column:
        values = [F.col(key) for key in keys] + [text] * (width - len(keys))
        named = [value.alias(f"key_{at}") for at, value in enumerate(values)]
        return F.struct(F.lit(name).alias("part"), *named, month.alias("key_month"))

    entries = [entry(part_name(keys), keys, day) for keys in key_sets]
    if channels:
        entries.append(entry(CHANNELS, (), F.col(MONTH)))
    copies = rows.select(*apart, *known, F.inline(F.array(*entries)))
    if channels:
        copies = copies.where(F.col(RANGE) | (F.col("part") == CHANNELS))
    grouping = [*apart, "part", *[f"key_{at}" for at in range(width)], "key_month"]
    counts = by_scope(counted(copies.groupBy(*grouping), list(known)), scope)
    return counts.drop(*apart).withColumnRenamed("key_month", MONTH)


def per_key_set(
    cases: DataFrame, params: ReportParams, scope: Scopes, key_sets: Sequence[KeySet]
) -> list[DataFrame]:
    """Each part from a scan of its own columns."""
    flags = month_flags(cases, params)
    rows, apart = split_rows(in_period(cases, params.period), scope)
    parts = []
    for keys in key_sets:
        grouped = rows.withColumns(flags).groupBy(*dict.fromkeys([*apart, *keys]))
        counts = by_scope(counted(grouped, list(flags)), scope)
        parts.append(_as_part(counts.select(*by_columns(scope), *keys, *flags), keys, part_name(keys)))
    return parts


def channel_part(cases: DataFrame, registry: ScopeRegistry, params: ReportParams) -> DataFrame:
    """Cases by month in both channels, over the channels' own period."""
    flags = channel_flags(cases, registry, params)
    rows = in_period(cases, params.channel_period).withColumns(flags)
    grouped = rows.where(F.col(TRADITIONAL) | F.col(DIGITAL)).groupBy(MONTH)
    return counted(grouped, list(flags)).withColumn("part", F.lit(CHANNELS))


def channel_parts(cases: DataFrame, registry: ScopeRegistry, requests: Sequence[ReportParams]) -> DataFrame:
    """The same for many packs: months are counted per channel scope, then given to the packs."""
    takers: dict[int, list[str]] = {}
    for request in requests:
        for scope_id, side in ((request.traditional_scope, TRADITIONAL), (request.digital_scope, DIGITAL)):
            takers.setdefault(scope_id, []).append(f"named_struct('pack', {request.scope}, 'side', '{side}')")
    months = scope_counts(cases, registry.scopes(takers), (MONTH,), requests[0].channel_period)
    cases_of = " ".join(f"WHEN {scope_id} THEN array({', '.join(packs)})" for scope_id, packs in takers.items())
    given = months.select(MONTH, TOTAL, F.expr(f"inline(CASE {SCOPE_ID} {cases_of} END)"))
    sides = [
        F.coalesce(F.sum(F.when(F.col("side") == side, F.col(TOTAL))), F.lit(0)).alias(side)
        for side in (TRADITIONAL, DIGITAL)
    ]
    grouped = given.groupBy(F.col("pack").alias(SCOPE_ID), MONTH).agg(*sides)
    return grouped.withColumn("part", F.lit(CHANNELS))


def brand_part(cases: DataFrame, scope: Scopes) -> DataFrame:
    """The scope's brands, over all months."""
    counts = scope_counts(cases, scope, (BRAND,), None, F.col(BRAND).isNotNull())
    return _as_part(counts.drop(TOTAL).distinct(), (BRAND,), BRANDS)


def _as_part(frame: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    named = {key: f"key_{at}" for at, key in enumerate(keys)}
    return frame.withColumnsRenamed(named).withColumn("part", F.lit(name))


def pack_counts(
    cases: DataFrame,
    registry: ScopeRegistry,
    requests: ReportParams | Sequence[ReportParams],
    key_sets: Sequence[KeySet],
    channels: bool = True,
    brands: bool = True,
    counting: str = PER_KEY_SET,
) -> DataFrame:
    """The counts of one pack, or of many with the same periods, lazily, in one frame.

    The channels join the one pass only for a single pack, and if their period lies within the
    report's; otherwise they are a narrow scan, as the brand list always is, having no period.
    """
    if counting not in (ONE_PASS, PER_KEY_SET):
        raise ValueError(f"counting must be {ONE_PASS} or {PER_KEY_SET}")
    single = isinstance(requests, ReportParams)
    params = requests if single else requests[0]
    scope = registry.scope(params.scope) if single else registry.scopes(request.scope for request in requests)
    inner, outer = params.channel_period, params.period
    within_period = inner is not None and outer.start <= inner.start and inner.end <= outer.end
    together = channels and single and counting == ONE_PASS and within_period
    if counting == PER_KEY_SET:
        parts = per_key_set(cases, params, scope, key_sets)
    else:
        parts = [one_pass(cases, registry, params, scope, key_sets, together)] if key_sets or together else []
    if channels and not together:
        parts.append(channel_part(cases, registry, params) if single else channel_parts(cases, registry, requests))
    if brands:
        parts.append(brand_part(cases, scope))
    return union_all(parts)


def shared_counts(
    cases: DataFrame,
    registry: ScopeRegistry,
    requests: ReportParams | Sequence[ReportParams],
    key_sets: Sequence[KeySet],
    channels: bool = True,
    brands: bool = True,
    counting: str = PER_KEY_SET,
    taxonomy: Taxonomy = PORTUGUESE,
    listed: DataFrame | None = None,
) -> SharedCounts:
    """Makes the counts and keeps them, a table of label counts, in the checkpoint folder.

    Without that cut each report's filter on its own part would be pushed below the counting, and
    every report would scan the cases again. From there a lost executor costs no second scan. This
    runs a job. ``listed`` are brands as shown, where they are kept elsewhere. The folder is deleted by ``session.forget`` or when the driver ends.
    """
    return SharedCounts(stored(pack_counts(cases, registry, requests, key_sets, channels, brands, counting)), taxonomy, listed)
