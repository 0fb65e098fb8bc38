"""Counts kept by month: cases are counted once, and reports are summed from the counts.

Every measure of every report is a count, and counts of months add up. So a folder keeps, for each month, the
cases counted by the columns scopes are confined to (``dimensions``) and by each set of grouping columns. When cases
of a month change, that month is counted again and its partition replaced; no other month is read or
written. A report over any range, scope or number of scopes is then a sum over a few partitions of a table of
labels, and the brand list is kept with it: a brand belongs to a scope from the first to the last month it was
seen there, and goes when the months it was seen in are counted again without it.

A row of the table: ``part`` (the set of grouping columns), ``key_0``, ``key_1``, ... (their values), the
dimensions, ``total``, and the partition's ``month``. A month that was counted has a row of part ``counted``
even if no cases are left of it, so that its old partition is replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from scopelens.functions.months import within
from scopelens.model import BRAND, MONTH, TOTAL, Period, ReportParams, first_of_month
from scopelens.operators.aggregate import count_rows
from scopelens.operators.filters import in_period
from scopelens.operators.sets import union_all
from scopelens.plans.counts import Scopes, by_columns, by_scope
from scopelens.plans.pack import FULL_PACK, asked_reports, long_form, pack_reports, report_keys
from scopelens.plans.pack import CHANNELS as CHANNEL_SHEET
from scopelens.plans.reports import KIND_KEYS, LINE_KEYS, PAIR_KEYS, SUBCAT2_KEYS, TYPE_KEYS
from scopelens.plans.shared_counts import BRANDS, CHANNELS, DIGITAL, TRADITIONAL, KeySet, SharedCounts, month_flags, part_name
from scopelens.session import stored
from scopelens.sources.scopes import Scope, ScopeRegistry, membership
from scopelens.vocabulary import PORTUGUESE, Taxonomy

COUNTED = "counted"
#: All sets of grouping columns reports are made from: reasons with types, pairs, lines, subcategories, brands, none.
KEY_SETS: tuple[KeySet, ...] = (KIND_KEYS, PAIR_KEYS, LINE_KEYS, SUBCAT2_KEYS, (BRAND,), ())


class MonthlyCounts:
    """A folder of counts by month. ``dimensions`` are the columns, besides the month, that scopes' conditions use."""

    def __init__(self, path: str, dimensions: Sequence[str] = (), key_sets: Sequence[KeySet] = KEY_SETS) -> None:
        self.path = path
        self.dimensions = [name for name in dimensions if name != MONTH]
        self.key_sets = list(dict.fromkeys([*key_sets, ()]))
        self.width = max(len(keys) for keys in self.key_sets)

    @property
    def keys(self) -> list[str]:
        return [f"key_{at}" for at in range(self.width)]

    def schema(self, cases: DataFrame | None = None) -> T.StructType:
        kinds = {field.name: field.dataType for field in cases.schema.fields} if cases is not None else {}
        text = T.StringType()
        fields = [("part", text), *[(name, text) for name in self.keys], *[(name, kinds.get(name, text)) for name in self.dimensions]]
        return T.StructType([T.StructField(name, kind) for name, kind in [*fields, (TOTAL, T.LongType()), (MONTH, T.DateType())]])

    def counted(self, cases: DataFrame) -> DataFrame:
        """The rows to keep for some cases, one narrow scan for each set of grouping columns."""
        parts = []
        for keys in self.key_sets:
            counts = count_rows(cases, list(dict.fromkeys([MONTH, *self.dimensions, *keys])))
            values = [F.col(key) for key in keys] + [F.lit(None)] * (self.width - len(keys))
            named = [value.cast("string").alias(name) for name, value in zip(self.keys, values, strict=True)]
            parts.append(counts.select(F.lit(part_name(keys)).alias("part"), *named, *self.dimensions, TOTAL, MONTH))
        return union_all(parts)

    def rebuild(self, cases: DataFrame) -> None:
        """Counts all cases; what the folder held before is replaced."""
        self._write(self.counted(cases), "static")

    def refresh(self, cases: DataFrame, months: Sequence[str]) -> None:
        """Counts the cases of some months again and replaces these months; others are neither read nor written."""
        if not months:
            return
        periods = [Period.month(month) for month in months]
        changed = cases.where(reduce(operator.or_, [within(period, cases.columns) for period in periods]))
        days = [(first_of_month(month),) for month in dict.fromkeys(months)]
        marks = cases.sparkSession.createDataFrame(days, "month date").select(F.lit(COUNTED).alias("part"), F.lit(0).cast("long").alias(TOTAL), MONTH)
        self._write(union_all([self.counted(changed), marks]), "dynamic")

    def _write(self, rows: DataFrame, overwrite: str) -> None:
        # label counts are small beside the cases; sorted by part, a report skips the other parts' row groups
        dealt = rows.hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, "part")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy(MONTH).parquet(self.path)

    def rows(self, spark: SparkSession, keys: Sequence[Sequence[str]], period: Period | None = None) -> DataFrame:
        """The kept counts of some sets of grouping columns; only the period's partitions are read."""
        missing = [tuple(one) for one in keys if tuple(one) not in self.key_sets]
        if missing:
            raise ValueError(f"not counted by {missing}")
        kept = spark.read.schema(self._stored_schema(spark)).parquet(self.path)
        return in_period(kept.where(F.col("part").isin([part_name(one) for one in keys])), period)

    def _stored_schema(self, spark: SparkSession) -> T.StructType:
        found = {field.name: field.dataType for field in spark.read.parquet(self.path).schema.fields}
        return T.StructType([T.StructField(f.name, found.get(f.name, f.dataType)) if f.name in self.dimensions else f for f in self.schema()])

    def counts(self, spark: SparkSession, scope: Scopes, keys: Sequence[str], period: Period | None) -> DataFrame:
        """As ``scope_counts`` gives from the cases."""
        rows = self.rows(spark, [keys], period)
        if isinstance(scope, Scope):
            rows = rows.where(scope.predicate)
        rows = rows.select(*[F.col(f"key_{at}").alias(name) for at, name in enumerate(keys)], *self._apart(keys), TOTAL)
        chosen = _by_scope(rows, scope, keys)
        return chosen.groupBy(*by_columns(scope), *keys).agg(F.sum(TOTAL).alias(TOTAL))

    def _apart(self, keys: Sequence[str]) -> list[str]:
        return [name for name in (MONTH, *self.dimensions) if name not in keys]

    def brands(self, spark: SparkSession, scope: Scopes) -> DataFrame:
        """Each brand of a scope with the first and last month it was seen there: ``brand``, ``first_month``, ``last_month``."""
        rows = self.rows(spark, [(BRAND,)])
        if isinstance(scope, Scope):
            rows = rows.where(scope.predicate)
        rows = rows.where("key_0 is not null").select(F.col("key_0").alias(BRAND), *self._apart([BRAND]), TOTAL)
        rows = _by_scope(rows, scope, [BRAND, MONTH])
        return rows.groupBy(*by_columns(scope), BRAND).agg(F.min(MONTH).alias("first_month"), F.max(MONTH).alias("last_month"))

    def shared(self, spark: SparkSession, registry: ScopeRegistry, params: ReportParams, key_sets: Sequence[KeySet], taxonomy: Taxonomy = PORTUGUESE) -> SharedCounts:
        """The counts of one pack, as ``shared_counts`` makes them from the cases; runs a job over the kept counts."""
        scope = registry.scope(params.scope)
        rows = self.rows(spark, key_sets, params.period).where(scope.predicate)
        flags = month_flags(rows, params)
        sums = [F.coalesce(F.sum(F.when(flag, F.col(TOTAL))), F.lit(0)).alias(name) for name, flag in flags.items()]
        parts = [rows.groupBy("part", *self.keys).agg(*sums)]
        by_month = self.rows(spark, [()], params.channel_period)
        sides = {TRADITIONAL: registry.scope(params.traditional_scope), DIGITAL: registry.scope(params.digital_scope)}
        totals = [F.coalesce(F.sum(F.when(side.predicate, F.col(TOTAL))), F.lit(0)).alias(name) for name, side in sides.items()]
        parts.append(by_month.groupBy(MONTH).agg(*totals).withColumn("part", F.lit(CHANNELS)))
        brands = self.brands(spark, scope).select(F.col(BRAND).alias("key_0"), F.lit(BRANDS).alias("part"))
        return SharedCounts(stored(union_all([*parts, brands])), taxonomy)


def _by_scope(rows: DataFrame, scope: Scopes, keys: Sequence[str]) -> DataFrame:
    if isinstance(scope, Scope):
        return rows
    if not scope[0].dimensions:  # else by_scope evaluates the conditions on the dimensions
        rows = rows.withColumns(membership(scope))
    return by_scope(rows, scope, keys)


def pack_from_months(
    spark: SparkSession,
    kept: MonthlyCounts,
    registry: ScopeRegistry,
    params: ReportParams,
    taxonomy: Taxonomy = PORTUGUESE,
    sheets: Sequence[str] = FULL_PACK,
    style: str = "title",
) -> DataFrame:
    """``report_pack`` from kept counts; no case is read."""
    keys = report_keys(sheets)
    known = {TYPE_KEYS: KIND_KEYS}
    wanted = {report: known.get(keys[report], keys[report]) for report in asked_reports(sheets) if report != CHANNEL_SHEET}
    source = kept.shared(spark, registry, params, list(dict.fromkeys(wanted.values())), taxonomy)
    # types alone are asked for by a key set that is not kept: they are summed from types with reasons
    asked = sheets if TYPE_KEYS not in [keys[report] for report in wanted] else [*sheets, "complaint_pareto"]
    reports = pack_reports(source, asked, params.top, taxonomy, style)
    chosen = {report: frame for report, frame in reports.items() if report in asked_reports(sheets)}
    return union_all([long_form(report, frame, taxonomy) for report, frame in chosen.items()])


