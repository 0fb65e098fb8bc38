"""The reports.

Each takes the cases, a scope and a period (``start`` and ``end``, or one ``month``) and returns
one frame, in report order. Given a list of scopes it returns all their reports in one frame with a
``scope_id``, in no order: ``rank`` has it.
The ``*_from`` functions make the same report from cases that are already counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from scopelens.functions.labels import (
    LABEL_STYLES,
    brand_label,
    default_label,
    fold,
    line_variant_label,
    reason_label,
    same_text,
    series_label,
    shown_label,
    text_in,
    title_case,
    type_reason_label,
)
from scopelens.functions.months import month_label
from scopelens.model import (
    BRAND,
    CASE_GROUP,
    CASE_TYPE,
    LINE,
    MONTH,
    REASON,
    SUBCAT1,
    SUBCAT2,
    TOTAL,
    VARIANT,
    Period,
    first_of_month,
    optional_period,
)
from scopelens.operators.aggregate import distinct_labels, grand_total
from scopelens.operators.filters import in_period
from scopelens.operators.pivot import MOST_LABELS, column_labels, pivot_counts
from scopelens.operators.rank import (
    BUCKET,
    cumulative_share,
    explicit_rank,
    report_order,
    row_numbers,
    share_of_total,
    sort_by_position,
    top_n,
    top_n_with_remainder,
)
from scopelens.plans.counts import Scopes, by_columns, scope_counts
from scopelens.sources.scopes import Scope, any_scope
from scopelens.vocabulary import PORTUGUESE, Caption, Taxonomy

TYPE_KEYS = (CASE_TYPE, CASE_GROUP)
KIND_KEYS = (*TYPE_KEYS, REASON)
PAIR_KEYS = (SUBCAT1, BRAND)
LINE_KEYS = (LINE, VARIANT)
SUBCAT2_KEYS = (SUBCAT2,)


def report_period(start: str | None, end: str | None, month: str | None) -> Period:
    if month is not None:
        return Period.month(month)
    if start is None or end is None:
        raise ValueError("a report needs a month, or a start and an end")
    return Period.of(start, end)


# Channels by month


def channel_evolution(
    cases: DataFrame,
    traditional: Scope,
    digital: Scope,
    start: str | None = None,
    end: str | None = None,
    taxonomy: Taxonomy = PORTUGUESE,
) -> DataFrame:
    """Cases per month in each of two scopes. Without both ends of the range, every month.

    Both scopes filter the same table, so this counts them side by side in one scan; joining two
    counts on the month (``full_join_counts``) gives the same rows from two.
    """
    rows = in_period(cases, optional_period(start, end)).where(any_scope([traditional, digital]))
    monthly = rows.groupBy(MONTH).agg(
        F.count_if(traditional.predicate).alias("traditional"),
        F.count_if(digital.predicate).alias("digital"),
    )
    return channel_evolution_from(monthly, taxonomy)


def channel_evolution_from(
    monthly: DataFrame, taxonomy: Taxonomy = PORTUGUESE, by: Sequence[str] = ()
) -> DataFrame:
    # An unknown month is not equal to itself: the two scopes' cases without month stay apart.
    a, b, none = F.col("traditional"), F.col("digital"), F.lit(0).cast("long")
    together = F.array(F.struct(a.alias("traditional"), b.alias("digital")))
    apart = F.array(
        F.struct(a.alias("traditional"), none.alias("digital")), F.struct(none.alias("traditional"), b.alias("digital"))
    )
    sides = F.when(F.col(MONTH).isNull() & (a > 0) & (b > 0), apart).otherwise(together)
    label = month_label(F.col(MONTH), taxonomy.month_names, capitalized=True)
    used = monthly.where((a > 0) | (b > 0))
    report = used.select(*by, MONTH, label.alias("month_label"), F.inline(sides))
    return report if by else report.orderBy(F.col(MONTH).asc_nulls_first())


def channel_series(evolution: DataFrame, taxonomy: Taxonomy = PORTUGUESE) -> DataFrame:
    """Both channels' totals, with the text a legend shows for them."""
    totals = evolution.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("traditional", "digital")]
    ).unpivot([], ["traditional", "digital"], "series", TOTAL)
    shown = F.when(F.col("series") == "traditional", taxonomy.traditional_name).otherwise(taxonomy.digital_name)
    return totals.select("series", TOTAL, series_label(shown, F.col(TOTAL)).alias("series_label"))


# Case types


def type_breakdown(
    cases: DataFrame,
    scope: Scopes,
    start: str | None = None,
    end: str | None = None,
    month: str | None = None,
    taxonomy: Taxonomy = PORTUGUESE,
    include_unknown: bool = False,
    style: str = "title",
) -> DataFrame:
    period = report_period(start, end, month)
    counts = scope_counts(cases, scope, TYPE_KEYS, period)
    return type_breakdown_from(counts, by_columns(scope), taxonomy, include_unknown, style)


def type_breakdown_from(
    counts: DataFrame,
    by: Sequence[str] = (),
    taxonomy: Taxonomy = PORTUGUESE,
    include_unknown: bool = False,
    style: str = "title",
) -> DataFrame:
    """Cases per type, with the social type split into mentions and others by its group.

    A social case without group is in neither part and so in no row; ``include_unknown`` gives
    these a row of their own.
    """
    social = F.coalesce(same_text(F.col(CASE_TYPE), taxonomy.social), F.lit(False))
    mention = text_in(F.col(CASE_GROUP), taxonomy.mention_groups)
    part = F.when(~social, 0).when(mention, 1).when(~mention, 2).otherwise(3)
    label = (
        F.when(F.col("_part") == 0, F.col(CASE_TYPE))
        .when(F.col("_part") == 1, F.lit(taxonomy.mentions_label))
        .when(F.col("_part") == 2, F.lit(taxonomy.others_label))
        .otherwise(F.lit(taxonomy.unknown_label))
    )
    parts = counts.withColumn("_part", part)
    if not include_unknown:
        parts = parts.where(F.col("_part") != 3)
    types = parts.groupBy(*by, "_part", fold(label).alias(CASE_TYPE)).agg(F.sum(TOTAL).alias(TOTAL))
    shares = share_of_total(types, by=by)
    rank = explicit_rank(F.col(CASE_TYPE), taxonomy.type_order).cast("int")
    report = shares.select(
        *by, LABEL_STYLES[style](F.col(CASE_TYPE)).alias(CASE_TYPE), TOTAL, rank.alias("rank"), "share"
    )
    return report if by else report.orderBy(F.col("rank").asc_nulls_last(), F.col(CASE_TYPE).asc_nulls_first())


# Reasons


def complaint_pareto(
    cases: DataFrame,
    scope: Scopes,
    start: str | None = None,
    end: str | None = None,
    month: str | None = None,
    n: int = 10,
    taxonomy: Taxonomy = PORTUGUESE,
    null_label: str | None = None,
) -> DataFrame:
    """The n most frequent complaint reasons, the rest in one row, and the running share."""
    complaint = same_text(F.col(CASE_TYPE), taxonomy.complaint)
    period = report_period(start, end, month)
    counts = scope_counts(cases, scope, (CASE_GROUP, REASON), period, complaint)
    return _complaint_pareto(counts, by_columns(scope), n, taxonomy, null_label)


def complaint_pareto_from(
    counts: DataFrame,
    by: Sequence[str] = (),
    n: int = 10,
    taxonomy: Taxonomy = PORTUGUESE,
    null_label: str | None = None,
) -> DataFrame:
    complaints = counts.where(same_text(F.col(CASE_TYPE), taxonomy.complaint))
    return _complaint_pareto(complaints, by, n, taxonomy, null_label)


def _complaint_pareto(
    counts: DataFrame, by: Sequence[str], n: int, taxonomy: Taxonomy, null_label: str | None
) -> DataFrame:
    label = reason_label(F.col(CASE_GROUP), F.col(REASON), taxonomy.folded_reasons)
    return pareto(counts, label, taxonomy.complaint_remainder, n, by, null_label)


def other_pareto(
    cases: DataFrame,
    scope: Scopes,
    start: str | None = None,
    end: str | None = None,
    month: str | None = None,
    n: int = 10,
    taxonomy: Taxonomy = PORTUGUESE,
    null_label: str | None = None,
) -> DataFrame:
    """The same for cases that are no complaints, by type and reason."""
    other = ~same_text(F.col(CASE_TYPE), taxonomy.complaint)
    counts = scope_counts(cases, scope, (CASE_TYPE, REASON), report_period(start, end, month), other)
    return _other_pareto(counts, by_columns(scope), n, taxonomy, null_label)


def other_pareto_from(
    counts: DataFrame,
    by: Sequence[str] = (),
    n: int = 10,
    taxonomy: Taxonomy = PORTUGUESE,
    null_label: str | None = None,
) -> DataFrame:
    others = counts.where(~same_text(F.col(CASE_TYPE), taxonomy.complaint))
    return _other_pareto(others, by, n, taxonomy, null_label)


def _other_pareto(
    counts: DataFrame, by: Sequence[str], n: int, taxonomy: Taxonomy, null_label: str | None
) -> DataFrame:
    label = type_reason_label(F.col(CASE_TYPE), F.col(REASON))
    return pareto(counts, label, taxonomy.other_remainder, n, by, null_label)


def pareto(
    counts: DataFrame,
    label: Column,
    remainder: str,
    n: int = 10,
    by: Sequence[str] = (),
    null_label: str | None = None,
) -> DataFrame:
    """Top n, remainder, share and running share of counted cases by a label.

    Without ``null_label`` a NULL among the n leaves the remainder out, as NOT IN does.
    """
    if null_label is not None:
        label = default_label(label, null_label)
    labelled = counts.groupBy(*by, fold(label).alias(REASON)).agg(F.sum(TOTAL).alias(TOTAL))
    ranked = top_n_with_remainder(labelled, REASON, remainder, n, by)
    order = report_order(REASON)
    shared = cumulative_share(row_numbers(ranked, order, by=by), order, by=by)
    report = shared.select(*by, "rank", title_case(F.col(REASON)).alias(REASON), TOTAL, "cum_share", BUCKET)
    return report if by else report.orderBy("rank")


# Categories by brand


def brand_names(cases: DataFrame, scope: Scopes, taxonomy: Taxonomy = PORTUGUESE) -> DataFrame:
    """Brands of a scope as shown, over all months: a brand without cases in the period is listed too."""
    chosen = scope.predicate if isinstance(scope, Scope) else any_scope(scope)
    return shown_brands(distinct_labels(cases.where(chosen), BRAND), taxonomy)


def shown_brands(brands: DataFrame, taxonomy: Taxonomy = PORTUGUESE, by: Sequence[str] = ()) -> DataFrame:
    shown = brand_label(F.col(BRAND), taxonomy.catch_all_brand, taxonomy.catch_all_label)
    return brands.where(F.col(BRAND).isNotNull()).select(*by, shown_label(shown).alias(BRAND)).distinct()


def given_brands(brands: DataFrame, scope: Scopes, taxonomy: Taxonomy = PORTUGUESE) -> DataFrame:
    """A maintained brand list as shown, for each scope."""
    if isinstance(scope, Scope):
        return shown_brands(brands, taxonomy)
    by = by_columns(scope)
    ids = F.explode(F.array(*[F.lit(one.scope_id) for one in scope]))
    return shown_brands(brands.select(BRAND, ids.alias(by[0])), taxonomy, by)


def category_by_brand(
    cases: DataFrame,
    scope: Scope,
    start: str | None = None,
    end: str | None = None,
    month: str | None = None,
    taxonomy: Taxonomy = PORTUGUESE,
    brands: Sequence[str] | None = None,
    most: int = MOST_LABELS,
) -> DataFrame:
    """One row per subcategory, one column per brand, largest first by the first brand.

    The brands are looked up in the scope unless given, which takes a job of its own; more than
    ``most`` are an error.
    """
    if brands is None:
        brands = column_labels(brand_names(cases, scope, taxonomy), BRAND, title_last(taxonomy), most)
    counts = scope_counts(cases, scope, PAIR_KEYS, report_period(start, end, month))
    wide = pivot_counts(category_counts(counts, (), taxonomy), "category", BRAND, brands)
    return sort_by_position(wide, 1, wide.columns[0])


def category_by_brand_long(
    cases: DataFrame,
    scope: Scopes,
    start: str | None = None,
    end: str | None = None,
    month: str | None = None,
    taxonomy: Taxonomy = PORTUGUESE,
    brands: DataFrame | None = None,
) -> DataFrame:
    """The same table as rows, however many brands there are.

    A pair that is not listed counts 0. A category none of whose cases has a brand comes once with
    brand NULL and 0, a brand without cases in the period once with category NULL and 0. ``brands``
    is a maintained list, one column ``brand``; without it all months are scanned for the brands.
    """
    counts = scope_counts(cases, scope, PAIR_KEYS, report_period(start, end, month))
    if brands is not None:
        by = [] if isinstance(scope, Scope) else by_columns(scope)
        return category_by_brand_long_from(counts, given_brands(brands, scope, taxonomy), by, taxonomy)
    if isinstance(scope, Scope):
        return category_by_brand_long_from(counts, brand_names(cases, scope, taxonomy), (), taxonomy)
    by = by_columns(scope)
    ever = scope_counts(cases, scope, (BRAND,), None, F.col(BRAND).isNotNull())
    return category_by_brand_long_from(counts, shown_brands(ever, taxonomy, by), by, taxonomy)


def category_by_brand_long_from(
    counts: DataFrame, brands: DataFrame, by: Sequence[str] = (), taxonomy: Taxonomy = PORTUGUESE
) -> DataFrame:
    # All parts read the pairs through their total alone: a filter or join on the brand itself would
    # be pushed below the counting, and each part would scan the cases for itself.
    pairs = category_counts(counts, by, taxonomy)
    zero = F.lit(0).cast("long")
    missing = F.lit(None).cast("string")
    cells = pairs.where(F.col(TOTAL).isNotNull())
    no_brand = pairs.groupBy(*by, "category").agg(F.sum(TOTAL).alias(TOTAL)).where(F.col(TOTAL).isNull())
    listed = brands.select(*by, BRAND, zero.alias(TOTAL)).unionByName(cells.select(*by, BRAND, TOTAL))
    no_case = listed.groupBy(*by, BRAND).agg(F.sum(TOTAL).alias(TOTAL)).where(F.col(TOTAL) == 0)
    return (
        cells.select(*by, "category", BRAND, TOTAL)
        .unionByName(no_brand.select(*by, "category", missing.alias(BRAND), zero.alias(TOTAL)))
        .unionByName(no_case.select(*by, missing.alias("category"), BRAND, zero.alias(TOTAL)))
    )


def category_counts(counts: DataFrame, by: Sequence[str] = (), taxonomy: Taxonomy = PORTUGUESE) -> DataFrame:
    """Counts by shown category and shown brand; NULL, not a count, where there is no brand.

    Shown labels also join the variants that compare equal.
    """
    category = default_label(F.col(SUBCAT1), taxonomy.default_subcat1)
    brand = brand_label(F.col(BRAND), taxonomy.catch_all_brand, taxonomy.catch_all_label)
    branded = F.when(F.col(BRAND).isNotNull(), F.col(TOTAL))
    return counts.groupBy(
        *by, shown_label(category).alias("category"), shown_label(brand).alias(BRAND)
    ).agg(F.sum(branded).alias(TOTAL))


def title_last(taxonomy: Taxonomy) -> str:
    """The catch-all's column name, which comes after all others."""
    return taxonomy.catch_all_label.title()


# Product lines and subcategories


def top_line_variant(
    cases: DataFrame,
    scope: Scopes,
    start: str | None = None,
    end: str | None = None,
    month: str | None = None,
    n: int = 10,
    taxonomy: Taxonomy = PORTUGUESE,
) -> DataFrame:
    counts = scope_counts(cases, scope, LINE_KEYS, report_period(start, end, month))
    return top_line_variant_from(counts, by_columns(scope), n, taxonomy)


def top_line_variant_from(
    counts: DataFrame, by: Sequence[str] = (), n: int = 10, taxonomy: Taxonomy = PORTUGUESE
) -> DataFrame:
    label = line_variant_label(F.col(LINE), F.col(VARIANT), taxonomy.regular_line, taxonomy.default_line)
    return top_labels(counts, label, "line_variant", n, by)


def top_subcat2(
    cases: DataFrame,
    scope: Scopes,
    start: str | None = None,
    end: str | None = None,
    month: str | None = None,
    n: int = 10,
    taxonomy: Taxonomy = PORTUGUESE,
) -> DataFrame:
    counts = scope_counts(cases, scope, SUBCAT2_KEYS, report_period(start, end, month))
    return top_subcat2_from(counts, by_columns(scope), n, taxonomy)


def top_subcat2_from(
    counts: DataFrame, by: Sequence[str] = (), n: int = 10, taxonomy: Taxonomy = PORTUGUESE
) -> DataFrame:
    return top_labels(counts, default_label(F.col(SUBCAT2), taxonomy.default_subcat2), SUBCAT2, n, by)


def top_labels(counts: DataFrame, label: Column, name: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    labelled = counts.groupBy(*by, fold(label).alias(name)).agg(F.sum(TOTAL).alias(TOTAL))
    top = top_n(labelled, name, n, by)
    order = [F.col(TOTAL).desc(), F.col(name).asc_nulls_first()]
    report = row_numbers(top, order, by=by).select(*by, "rank", title_case(F.col(name)).alias(name), TOTAL)
    return report if by else report.orderBy("rank")


# Totals and captions


def total_cases(
    cases: DataFrame, scope: Scopes, start: str | None = None, end: str | None = None, month: str | None = None
) -> DataFrame:
    """Cases in a period: one row, 0 if there are none. Of a list, a scope without cases has no row."""
    counts = scope_counts(cases, scope, (), report_period(start, end, month))
    return grand_total(counts, by=by_columns(scope)).withColumnRenamed("grand_total", TOTAL)


def report_caption(
    report: DataFrame,
    title: str | DataFrame,
    caption: Caption,
    start: str | date | None,
    end: str | date,
    values: Sequence[str] = (TOTAL,),
    taxonomy: Taxonomy = PORTUGUESE,
) -> DataFrame:
    """A report's caption: scope title, subject, total and period, one row.

    ``title`` is text, or a one-row frame with a ``label`` (see ``scope_label``). Without ``start``
    the period is one month.
    """
    name = F.lit(title) if isinstance(title, str) else title.select("label").scalar()
    months = [F.lit(first_of_month(m)) for m in (start, end) if m]
    period = F.concat_ws(caption.joiner, *[month_label(m, taxonomy.month_names) for m in months])
    counted = [F.col("grand_total").cast("string"), F.lit(f" {caption.noun} - ")] if caption.noun else []
    text = F.concat(name, F.lit(" \n"), F.lit(caption.subject), *counted, period)
    return grand_total(report, values).select(text.alias("caption"))
