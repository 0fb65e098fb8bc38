"""Report packs: all sheets a user asks for, as frames or as one long table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scopelens.model import BRAND, CASE_TYPE, FIRST, LAST, MONTH, MONTHS, RANGE, REASON, SCOPE_ID, SUBCAT2, TOTAL, ReportParams
from scopelens.operators.sets import union_all
from scopelens.plans.counts import scope_counts
from scopelens.plans.reports import (
    KIND_KEYS,
    LINE_KEYS,
    PAIR_KEYS,
    SUBCAT2_KEYS,
    TYPE_KEYS,
    brand_names,
    category_by_brand_long_from,
    channel_evolution,
    channel_evolution_from,
    complaint_pareto_from,
    given_brands,
    other_pareto_from,
    report_caption,
    title_last,
    top_line_variant_from,
    top_subcat2_from,
    type_breakdown_from,
)
from scopelens.plans.shared_counts import DIGITAL, PER_KEY_SET, TRADITIONAL, KeySet, SharedCounts, shared_counts
from scopelens.sources.scopes import ScopeRegistry
from scopelens.vocabulary import PORTUGUESE, Taxonomy

FULL_PACK = (
    "channel_evolution",
    "type_breakdown",
    "type_breakdown_last",
    "complaint_pareto",
    "complaint_pareto_last",
    "other_pareto",
    "other_pareto_last",
    "category_brand",
    "category_brand_last",
    "line_variant",
    "line_variant_last",
    "subcat2",
    "subcat2_last",
)
SUMMARY_PACK = ("channel_evolution", "type_breakdown", "type_breakdown_first", "type_breakdown_last")

# Sheets a pack leaves out when they have no rows; the others are then written empty.
SKIPPED_IF_EMPTY = ("channel_evolution", *FULL_PACK[7:])

CHANNELS, CATEGORIES = "channel_evolution", "category_brand"

# Every report from a scan of its own, as single reports are made.
PER_REPORT = "per_report"


class DirectCounts:
    """The counted cases of one pack, every count from a scan of its own."""

    by: list[str] = []

    def __init__(
        self,
        cases: DataFrame,
        registry: ScopeRegistry,
        params: ReportParams,
        taxonomy: Taxonomy,
        listed: DataFrame | None = None,
    ) -> None:
        self._cases = cases
        self._scope = registry.scope(params.scope)
        self._channels = [registry.scope(params.traditional_scope), registry.scope(params.digital_scope)]
        self._params = params
        self._taxonomy = taxonomy
        self._listed = listed

    def counts(self, keys: Sequence[str], months: Sequence[str]) -> DataFrame:
        periods = self._params.months
        return union_all(
            [
                scope_counts(self._cases, self._scope, keys, periods[name]).withColumn(MONTHS, F.lit(name))
                for name in months
            ]
        )

    def channels(self) -> DataFrame:
        params = self._params
        return channel_evolution(
            self._cases, *self._channels, params.channel_start, params.channel_end, self._taxonomy
        ).select(MONTH, TRADITIONAL, DIGITAL)

    def brands(self) -> DataFrame:
        if self._listed is not None:
            return given_brands(self._listed, self._scope, self._taxonomy)
        return brand_names(self._cases, self._scope, self._taxonomy)


def asked_reports(sheets: Sequence[str]) -> dict[str, list[str]]:
    """The reports behind the sheets, with the months each is for."""
    asked: dict[str, list[str]] = {}
    for sheet in sheets:
        report, months = sheet_report(sheet)
        asked.setdefault(report, []).append(months)
    return asked


def report_keys(sheets: Sequence[str]) -> dict[str, KeySet]:
    """The grouping columns each report is made from; reports on reasons share theirs with types."""
    reasons = {"complaint_pareto", "other_pareto"} & set(asked_reports(sheets))
    kinds = KIND_KEYS if reasons else TYPE_KEYS
    return {
        "type_breakdown": kinds,
        "complaint_pareto": kinds,
        "other_pareto": kinds,
        CATEGORIES: PAIR_KEYS,
        "line_variant": LINE_KEYS,
        "subcat2": SUBCAT2_KEYS,
    }


def pack_reports(
    source: SharedCounts | DirectCounts,
    sheets: Sequence[str],
    top: int = 10,
    taxonomy: Taxonomy = PORTUGUESE,
    style: str = "title",
) -> dict[str, DataFrame]:
    """The reports behind the sheets, each for all its months at once (column ``months``)."""
    keys = report_keys(sheets)
    by = [*source.by, MONTHS]

    def counts(report: str, months: Sequence[str]) -> DataFrame:
        return source.counts(keys[report], months)

    def brands(months: Sequence[str]) -> DataFrame:
        named = F.explode(F.array(*[F.lit(name) for name in months]))
        return source.brands().withColumn(MONTHS, named)

    def categories(report: str, months: Sequence[str]) -> DataFrame:
        return category_by_brand_long_from(counts(report, months), brands(months), by, taxonomy)

    make: dict[str, Callable[[str, Sequence[str]], DataFrame]] = {
        CHANNELS: lambda r, m: channel_evolution_from(source.channels(), taxonomy, source.by),
        "type_breakdown": lambda r, m: type_breakdown_from(counts(r, m), by, taxonomy, style=style),
        "complaint_pareto": lambda r, m: complaint_pareto_from(counts(r, m), by, top, taxonomy),
        "other_pareto": lambda r, m: other_pareto_from(counts(r, m), by, top, taxonomy),
        CATEGORIES: categories,
        "line_variant": lambda r, m: top_line_variant_from(counts(r, m), by, top, taxonomy),
        "subcat2": lambda r, m: top_subcat2_from(counts(r, m), by, top, taxonomy),
    }
    return {report: make[report](report, months) for report, months in asked_reports(sheets).items()}


def sheet_report(sheet: str) -> tuple[str, str]:
    """The report of a sheet and the months it is for."""
    report, _, months = sheet.rpartition("_")
    return (report, months) if months in (FIRST, LAST) else (sheet, RANGE)


def report_sheets(
    cases: DataFrame,
    registry: ScopeRegistry,
    params: ReportParams,
    taxonomy: Taxonomy = PORTUGUESE,
    sheets: Sequence[str] = FULL_PACK,
    counting: str = PER_KEY_SET,
    style: str = "title",
    brands: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The frames of a pack by sheet.

    ``counting`` says how the cases are read: ``per_key_set`` where they are stored, ``one_pass`` where
    they are a join or otherwise costly to produce, ``per_report`` for every report by itself. The
    first two count in a job of their own when the pack is made. ``brands``, one column ``brand``,
    is a maintained list; without it all months are scanned for the brands.
    """
    source = pack_source(cases, registry, params, taxonomy, sheets, counting, brands)
    reports = pack_reports(source, sheets, params.top, taxonomy, style)
    frames = {}
    for sheet in sheets:
        report, months = sheet_report(sheet)
        frame = reports[report]
        frames[sheet] = frame if report == CHANNELS else frame.where(F.col(MONTHS) == months).drop(MONTHS)
    return frames


def report_pack(
    cases: DataFrame,
    registry: ScopeRegistry,
    params: ReportParams,
    taxonomy: Taxonomy = PORTUGUESE,
    sheets: Sequence[str] = FULL_PACK,
    counting: str = PER_KEY_SET,
    style: str = "title",
    brands: DataFrame | None = None,
) -> DataFrame:
    """A pack as one long table: sheet, position, label, series, value.

    Sheets are read in the order of ``position``, NULL last, then ``label``. Positions ascend but
    need not be consecutive, so no sheet has to be numbered row by row. ``counting`` and ``brands`` as
    for ``report_sheets``.
    """
    source = pack_source(cases, registry, params, taxonomy, sheets, counting, brands)
    reports = pack_reports(source, sheets, params.top, taxonomy, style)
    return union_all([long_form(report, frame, taxonomy) for report, frame in reports.items()])


def report_packs(
    cases: DataFrame,
    registry: ScopeRegistry,
    requests: Sequence[ReportParams],
    taxonomy: Taxonomy = PORTUGUESE,
    sheets: Sequence[str] = FULL_PACK,
    counting: str = PER_KEY_SET,
    style: str = "title",
    brands: DataFrame | None = None,
) -> DataFrame:
    """The packs of many scopes in one long table with a ``scope_id``.

    The cases are read as often as for a single pack. All requests must be for different scopes and
    the same months.
    """
    if not requests:
        raise ValueError("no packs asked for")
    first = requests[0]
    if any((r.months, r.channel_period, r.top) != (first.months, first.channel_period, first.top) for r in requests):
        raise ValueError("packs made together must have the same months and size")
    if len({request.scope for request in requests}) < len(requests):
        raise ValueError("packs made together must have different scopes")
    source = pack_source(cases, registry, list(requests), taxonomy, sheets, counting, brands)
    reports = pack_reports(source, sheets, first.top, taxonomy, style)
    return union_all([long_form(report, frame, taxonomy) for report, frame in reports.items()])


def pack_source(
    cases: DataFrame,
    registry: ScopeRegistry,
    requests: ReportParams | list[ReportParams],
    taxonomy: Taxonomy = PORTUGUESE,
    sheets: Sequence[str] = FULL_PACK,
    counting: str = PER_KEY_SET,
    brands: DataFrame | None = None,
) -> SharedCounts | DirectCounts:
    if counting == PER_REPORT and isinstance(requests, ReportParams):
        return DirectCounts(cases, registry, requests, taxonomy, brands)
    single = isinstance(requests, ReportParams)
    scope = registry.scope(requests.scope) if single else registry.scopes(request.scope for request in requests)
    listed = None if brands is None else given_brands(brands, scope, taxonomy)
    asked, keys = asked_reports(sheets), report_keys(sheets)
    key_sets = list(dict.fromkeys(keys[report] for report in asked if report != CHANNELS))
    channels, scan_brands = CHANNELS in asked, CATEGORIES in asked and listed is None
    return shared_counts(cases, registry, requests, key_sets, channels, scan_brands, counting, taxonomy, listed)


def pack_captions(
    frames: dict[str, DataFrame], params: ReportParams, title: str | DataFrame, taxonomy: Taxonomy = PORTUGUESE
) -> DataFrame:
    """The caption of each sheet of ``report_sheets``: scope title, subject, total and period.

    Totals are sums of the sheets' own rows, so the cases are not read again.
    """
    spans = {RANGE: (params.start, params.end), FIRST: (None, params.start), LAST: (None, params.end)}
    captions = []
    for sheet, frame in frames.items():
        report, months = sheet_report(sheet)
        channels = report == CHANNELS
        start, end = (params.channel_start, params.channel_end) if channels else spans[months]
        values = (TRADITIONAL, DIGITAL) if channels else (TOTAL,)
        one = report_caption(frame, title, taxonomy.captions[report], start, end, values, taxonomy)
        captions.append(one.select(F.lit(sheet).alias("sheet"), "caption"))
    return union_all(captions)


def long_form(report: str, frame: DataFrame, taxonomy: Taxonomy = PORTUGUESE) -> DataFrame:
    if report == CHANNELS:
        position = F.year(MONTH) * 12 + F.month(MONTH)
        return _series(report, frame, position, "month_label", [TRADITIONAL, DIGITAL])
    if report == CATEGORIES:
        return _category_series(report, frame, taxonomy)
    label, values = {
        "type_breakdown": (CASE_TYPE, [TOTAL, "share"]),
        "complaint_pareto": (REASON, [TOTAL, "cum_share"]),
        "other_pareto": (REASON, [TOTAL, "cum_share"]),
        "line_variant": ("line_variant", [TOTAL]),
        "subcat2": (SUBCAT2, [TOTAL]),
    }[report]
    return _series(report, frame, F.col("rank"), label, values)


def _sheet(report: str, frame: DataFrame) -> Column:
    if MONTHS not in frame.columns:
        return F.lit(report)
    return F.when(F.col(MONTHS) == RANGE, report).otherwise(F.concat(F.lit(f"{report}_"), F.col(MONTHS)))


def _by(frame: DataFrame) -> list[str]:
    return [name for name in (SCOPE_ID, MONTHS) if name in frame.columns]


def _series(report: str, frame: DataFrame, position: Column, label: str, values: Sequence[str]) -> DataFrame:
    scope = [name for name in _by(frame) if name == SCOPE_ID]
    wide = frame.select(
        *scope,
        _sheet(report, frame).alias("sheet"),
        position.cast("long").alias("position"),
        F.col(label).alias("label"),
        *[F.col(value).cast("double") for value in values],
    )
    return wide.unpivot([*scope, "sheet", "position", "label"], list(values), "series", "value")


def _category_series(report: str, cells: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Brands are the series. Categories are ordered by the first brand's count, largest first."""
    by = _by(cells)
    scope = [name for name in by if name == SCOPE_ID]
    order = F.struct((F.col(BRAND) == title_last(taxonomy)).alias("last"), F.col(BRAND).alias("name"))
    # Every brand of a scope is listed for each of its months, so the first is the same in all.
    firsts = cells.where(F.col(BRAND).isNotNull()).groupBy(*by).agg(F.min(order)["name"].alias("_first"))
    leading = F.coalesce(F.sum(F.when(F.col(BRAND) == F.col("_first"), F.col(TOTAL))), F.lit(0))
    positions = cells.join(firsts, by).groupBy(*by, "category").agg((-leading).alias("position"))
    return cells.join(positions, [*by, "category"], "left").select(
        *scope,
        _sheet(report, cells).alias("sheet"),
        F.col("position").cast("long").alias("position"),
        F.col("category").alias("label"),
        F.col(BRAND).alias("series"),
        F.col(TOTAL).cast("double").alias("value"),
    )
