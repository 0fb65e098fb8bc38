"""The registered queries. Every one reads whole tables through the library's operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from harness.bindings import (
    CHANNEL_END,
    CHANNEL_START,
    END,
    FOLDS,
    PARAMS,
    START,
    TAXONOMY,
    cases,
    catalogue,
    hierarchy,
    many_scopes,
    monthly_registry,
    registry,
    table,
)
from scopelens.functions import labels, months
from scopelens.model import CASE_SCHEMA, TOTAL
from scopelens.operators import aggregate, filters, heavy, joins, pivot, prefix, rank, sets
from scopelens.plans import attributes, monthly, pack, reports
from scopelens.plans.shared_counts import ONE_PASS, PER_KEY_SET
from scopelens.sources import scopes as scope_source
from scopelens.session import shared_folder, stored
from scopelens.sources.cases import TableSource, bad_months as months_unread, read_cases
from scopelens.sources.sinks import manifest, publish_report, read_published

Query = Callable[[SparkSession, str], DataFrame]

SCOPE, DIGITAL, TRADITIONAL = 1000, 8106, 9106
RAW = CASE_SCHEMA.names


def scope(scope_id: int = SCOPE):
    return registry().scope(scope_id)


def in_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.in_month_range(cases(spark, sf_dir), START, END)


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.type_is(in_period(spark, sf_dir), TAXONOMY.complaint)


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count_by(complaints(spark, sf_dir), "reason")


# Sources and sinks


def scan_cases(spark, d):
    return read_view(spark, cases(spark, d), "scan_cases").select(*RAW, "channel")


def read_view(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(f"cases_{name}")
    return read_cases(spark, TableSource(f"cases_{name}"))


def line_cases(spark: SparkSession, d: str, *moments: str) -> DataFrame:
    """Lines as cases; ``moments`` are the expressions of month and, perhaps, event_date."""
    texts = ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
    named = [F.expr(moment).alias(name) for moment, name in zip(moments, ("month", "event_date"))]
    labels_ = [F.col(texts[at % len(texts)]).cast("string").alias(name) for at, name in enumerate(RAW[1:])]
    return table(spark, d, "lineitem").select(*named, *labels_)


def read_cases_timestamp_day(spark, d):
    """Events with a time of day: the last day of a month counts to its end."""
    rows = line_cases(spark, d, "l_shipdate", "l_shipdate + make_interval(0, 0, 0, 0, 3 * l_linenumber)")
    read = read_view(spark, rows, "timestamp_day")
    return aggregate.count_by(filters.in_month_range(read, START, END), "case_type")


def read_cases_mid_month(spark, d):
    """Months stored as any day: cases are told by month all the same."""
    read = read_view(spark, line_cases(spark, d, "CAST(l_shipdate AS date)"), "mid_month")
    return aggregate.count_rows(filters.in_month_range(read, START, END), ["month"])


def scope_filter(spark, d):
    return scope_source.apply_scope(cases(spark, d), registry(), DIGITAL).select(*RAW)


def scope_label(spark, d):
    return scope_source.scope_label(catalogue(spark, d), 7)


def report_long(spark, d):
    return pack.report_pack(
        cases(spark, d), registry(), PARAMS, TAXONOMY, pack.SUMMARY_PACK, pack.PER_REPORT, style="capitalize"
    )


def report_manifest(spark, d):
    report = pack.report_pack(cases(spark, d), registry(), PARAMS, TAXONOMY, pack.SUMMARY_PACK)
    return manifest(report, [*pack.SUMMARY_PACK, "subcat2", "complaint_pareto"], pack.SKIPPED_IF_EMPTY)


def multi_scope_top(spark, d):
    chosen = registry().scopes(registry().ids())
    return reports.top_subcat2(cases(spark, d), chosen, START, END, taxonomy=TAXONOMY)


def multi_scope_complaints(spark, d):
    chosen = registry().scopes(registry().ids())
    return reports.complaint_pareto(cases(spark, d), chosen, START, END, taxonomy=TAXONOMY)


def multi_scope_types(spark, d):
    chosen = registry().scopes(registry().ids())
    return reports.type_breakdown(cases(spark, d), chosen, START, END, taxonomy=TAXONOMY)


def multi_scope_total(spark, d):
    """A hundred scopes, counted by the columns they are confined to."""
    known, ids = many_scopes(100)
    return reports.total_cases(cases(spark, d), known.scopes(ids), START, END)


def scopes_from_table(spark, d):
    """The same hundred scopes, defined by rows."""
    base = spark.sql(
        "SELECT * FROM VALUES (1000, NULL, NULL), (8006, 1000, \"channel = 'digital'\"), "
        "(9006, 1000, \"channel = 'traditional'\") AS t(scope_id, parent_id, condition)"
    )
    at = F.col("at")
    first = 1995 + (at / 2).cast("int") % 7
    end = first + 1 + (at / 14).cast("int")
    condition = F.format_string("month >= DATE'%d-01-01' AND month < DATE'%d-01-01'", first, end)
    numbers = table(spark, d, "part").select(((F.col("p_partkey") - 1) % 97).cast("int").alias("at")).distinct()
    more = numbers.select(
        (20000 + at).alias("scope_id"), F.when(at % 2 == 0, 8006).otherwise(9006).alias("parent_id"), condition.alias("condition")
    )
    known = scope_source.ScopeRegistry.from_table(base.union(more), ("channel", "month"))
    return reports.total_cases(cases(spark, d), known.scopes(known.ids()), START, END)


def multi_scope_total_by_case(spark, d):
    """The same from conditions evaluated on every case."""
    known, ids = many_scopes(100, declared=False)
    return reports.total_cases(cases(spark, d), known.scopes(ids), START, END)


# Filters


def month_start(spark, d):
    day = F.col("l_shipdate").cast("date")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        months.month_start(F.col("l_shipdate")).alias("month"),
        months.parse_month(F.date_format(day, "yyyy-MM")).alias("parsed"),
    )


def filter_month_range(spark, d):
    return in_period(spark, d).select(*RAW)


def filter_single_month(spark, d):
    return filters.in_month(cases(spark, d), END).select(*RAW)


def filter_optional_range(spark, d):
    """Half a range is no range, so the first part is every case."""
    everything = filters.in_optional_range(cases(spark, d), START, None)
    ranged = filters.in_optional_range(cases(spark, d), START, END)
    return sets.union_all(
        [
            aggregate.count_rows(everything, ["month"]).withColumn("part", F.lit("open")),
            aggregate.count_rows(ranged, ["month"]).withColumn("part", F.lit("closed")),
        ]
    )


def filter_type_eq(spark, d):
    return filters.type_is(cases(spark, d), "1-urgent").select(*RAW)


def filter_type_ne(spark, d):
    return filters.type_is_not(cases(spark, d), "1-urgent").select(*RAW)


def filter_in(spark, d):
    return filters.group_in(cases(spark, d), ["r"]).select(*RAW)


def filter_not_in(spark, d):
    return filters.group_not_in(cases(spark, d), ["r"]).select(*RAW)


def drop_null_rows(spark, d):
    return filters.not_null(cases(spark, d), ["brand", "subcat2"]).select(*RAW)


def having_drop_group(spark, d):
    return filters.drop_group(aggregate.count_by(in_period(spark, d), "case_group"), "case_group", "r")


# Joins


def full_join_months(spark, d):
    rows = filters.in_month_range(cases(spark, d), CHANNEL_START, CHANNEL_END)
    sides = [
        aggregate.count_rows(rows.where(scope(scope_id).predicate), ["month"]).withColumnRenamed(TOTAL, name)
        for scope_id, name in ((TRADITIONAL, "traditional"), (DIGITAL, "digital"))
    ]
    return rank.sort_asc(joins.full_join_counts(*sides, on="month"), "month")


def anti_join_null_aware(spark, d):
    counts = reason_counts(spark, d)
    return joins.remainder_of(counts, rank.top_n(counts, "reason"), "reason")


def anti_join_sum(spark, d):
    """A NULL label among the top ten: nothing is left, and the sum of nothing is NULL."""
    counts = aggregate.count_by(in_period(spark, d), "subcat2")
    top = rank.top_n(counts, "subcat2")
    return sets.union_all(
        [
            joins.sum_remainder(counts, top, "subcat2", "with null"),
            joins.sum_remainder(counts, filters.not_null(top, ["subcat2"]), "subcat2", "without null"),
        ]
    )


def lookup_default(spark, d):
    label = labels.type_reason_label(F.col("case_type"), F.col("reason"))
    counts = aggregate.count_by_expr(in_period(spark, d), ["case_type", "reason"], label, "label")
    keyed = counts.withColumn("prefix", labels.label_prefix(F.col("label")))
    kinds = table(spark, d, "orders").select(F.lower("o_orderpriority").alias("prefix")).distinct()
    colours = kinds.where(F.col("prefix") < "4").withColumn("colour", F.concat(F.lit("#"), F.left("prefix", F.lit(1))))
    return joins.lookup(keyed, colours, "prefix", "colour", "#other")


# Aggregations


def count_by_month(spark, d):
    return aggregate.count_rows(cases(spark, d), ["month"])


def count_by_type(spark, d):
    return aggregate.count_by(cases(spark, d), "case_type")


def count_by_label(spark, d):
    label = labels.reason_label(F.col("case_group"), F.col("reason"), FOLDS)
    return aggregate.count_by_expr(in_period(spark, d), ["case_group", "reason"], label, "label")


def count_constant_label(spark, d):
    social = filters.type_is(in_period(spark, d), TAXONOMY.social)
    return aggregate.count_as(
        filters.group_in(social, TAXONOMY.mention_groups), "case_type", TAXONOMY.mentions_label, "case_type"
    )


def global_sum(spark, d):
    return aggregate.sum_all(aggregate.count_by(in_period(spark, d), "case_type"))


def grand_total(spark, d):
    return aggregate.grand_total(r_channel_evolution(spark, d), ["traditional", "digital"])


def distinct_brands(spark, d):
    return aggregate.distinct_labels(cases(spark, d).where(scope().predicate), "brand")


def brand_list(spark, d):
    shown = reports.brand_names(cases(spark, d), scope(), TAXONOMY)
    return aggregate.ordered_label_list(
        shown, "brand", reports.title_last(TAXONOMY), "brands", pivot.MOST_LABELS
    )


def pivot_special_names(spark, d):
    """Labels with a dot, a backtick, no character, and the name of the row column."""
    odd = {"Brand#11": "Dr.Oetker", "Brand#12": "a`b", "Brand#14": "", "Brand#15": "subcat1"}
    rows = filters.in_month_range(cases(spark, d), START, END).withColumn("brand", labels.map_value(F.col("brand"), odd))
    counts = aggregate.count_rows(rows, ["subcat1", "brand"])
    wide = pivot.pivot_counts(counts, "subcat1", "brand", pivot.column_labels(counts, "brand", ""))
    return wide.toDF(*[name or "EMPTY" for name in wide.columns])


def pivot_brand(spark, d):
    rows = cases(spark, d)
    brands = pivot.column_labels(aggregate.distinct_labels(rows, "brand"), "brand", TAXONOMY.catch_all_brand)
    counts = aggregate.count_rows(filters.in_month_range(rows, START, END), ["subcat1", "brand"])
    return pivot.pivot_counts(counts, "subcat1", "brand", brands)


# Ranking


def top10_reasons(spark, d):
    return rank.top_n(reason_counts(spark, d), "reason")


def top10_with_remainder(spark, d):
    return rank.top_n_with_remainder(reason_counts(spark, d), "reason", TAXONOMY.complaint_remainder)


def top10_null_among(spark, d):
    counts = aggregate.count_by(in_period(spark, d), "subcat2")
    return rank.top_n_with_remainder(counts, "subcat2", "remainder")


def top10_null_outside(spark, d):
    """By variant the NULL label is far down, so it is left out of the remainder."""
    counts = aggregate.count_by(in_period(spark, d), "variant")
    return rank.top_n_with_remainder(counts, "variant", "remainder", 3)


def pareto_share(spark, d):
    ranked = top10_with_remainder(spark, d)
    return rank.cumulative_share(ranked, rank.report_order("reason"))


def share_of_total(spark, d):
    return rank.share_of_total(aggregate.count_by(in_period(spark, d), "case_type"))


def row_numbers(spark, d):
    top = filters.not_null(top10_null_among(spark, d), ["subcat2"])
    return rank.row_numbers(top, rank.report_order("subcat2"))


def explicit_order(spark, d):
    return rank.sort_by_explicit_order(
        aggregate.count_by(in_period(spark, d), "case_type"), "case_type", TAXONOMY.type_order
    )


def remainder_last(spark, d):
    ranked = top10_with_remainder(spark, d).drop(rank.BUCKET)
    return rank.remainder_last(ranked, "reason", TAXONOMY.complaint_remainder)


def pivot_sorted(spark, d):
    """Places by the first series, numbered in ranges of that order."""
    wide = pivot_brand(spark, d)
    return prefix.numbered(wide, rank.position_order(wide, 1, "subcat1"), "place")


def placed(report: DataFrame) -> DataFrame:
    """The place of each category in its report, by the report's own order; a report has few categories."""
    return rank.row_numbers(report, rank.position_order(report, 1, "category"), "place")


def top_n_two_phase(spark, d):
    """Where some labels are frequent, and where all are about equally frequent and have to be counted."""
    rows = cases(spark, d)
    frequent = heavy.top_n_two_phase(rows, F.col("reason"), "label")
    flat = heavy.top_n_two_phase(table(spark, d, "lineitem"), F.col("l_orderkey").cast("string"), "label", tracked=100)
    return sets.union_all([frequent.withColumn("part", F.lit("frequent")), flat.withColumn("part", F.lit("flat"))])


def pareto_all_reasons(spark, d):
    return prefix.pareto_classes(aggregate.count_by(in_period(spark, d), "reason"), "reason")


def pareto_all_suppliers(spark, d):
    """Suppliers by channel, many labels in each of two groups."""
    side = F.when(F.col("l_linestatus") == "O", "digital").otherwise("traditional").alias("channel")
    counts = table(spark, d, "lineitem").select(side, F.col("l_suppkey").alias("supplier")).groupBy("channel", "supplier").agg(F.count(F.lit(1)).alias(TOTAL))
    return prefix.pareto_classes(counts, "supplier", by=["channel"])


# Sets


def union_all_parts(spark, d):
    rows = in_period(spark, d)
    social = filters.type_is(rows, TAXONOMY.social)
    groups = TAXONOMY.mention_groups
    return sets.union_all(
        [
            filters.drop_group(aggregate.count_by(rows, "case_type"), "case_type", TAXONOMY.social),
            aggregate.count_as(
                filters.group_in(social, groups), "case_type", TAXONOMY.mentions_label, "case_type"
            ),
            aggregate.count_as(
                filters.group_not_in(social, groups), "case_type", TAXONOMY.others_label, "case_type"
            ),
        ]
    )


def present_categories(spark, d):
    return sets.present_in_order(in_period(spark, d), "case_type", TAXONOMY.type_order)


# Scalar expressions


def _labelled(spark, d, label, *columns):
    return cases(spark, d).select("month", *columns, label.alias("label"))


def label_reason(spark, d):
    label = labels.reason_label(F.col("case_group"), F.col("reason"), FOLDS)
    return _labelled(spark, d, label, "case_group", "reason")


def label_default(spark, d):
    return _labelled(spark, d, labels.default_label(F.col("subcat2"), TAXONOMY.default_subcat2), "subcat2")


def label_brand(spark, d):
    label = labels.brand_label(F.col("brand"), TAXONOMY.catch_all_brand, TAXONOMY.catch_all_label)
    return _labelled(spark, d, label, "brand")


def label_line_variant(spark, d):
    label = labels.line_variant_label(
        F.col("line"), F.col("variant"), TAXONOMY.regular_line, TAXONOMY.default_line
    )
    return _labelled(spark, d, label, "line", "variant")


def label_type_reason(spark, d):
    return _labelled(spark, d, labels.type_reason_label(F.col("case_type"), F.col("reason")), "case_type", "reason")


def _part_text():
    return F.concat_ws("/", F.col("p_name"), F.concat(F.lit("d'"), F.col("p_type")), F.concat(F.lit("x1"), "p_brand"))


def title_case(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.title_case(_part_text()).alias("label"))


def capitalize(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.capitalize(_part_text()).alias("label"))


def strip_brackets(spark, d):
    return catalogue(spark, d).select("scope_id", labels.strip_brackets(F.col("name")).alias("label"))


def month_label(spark, d):
    month = months.month_start(F.col("l_shipdate"))
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        months.month_label(month).alias("short"),
        months.month_label(month, year_digits=4, capitalized=True).alias("long"),
    )


def coerce_numeric(spark, d):
    text = F.when(F.col("l_returnflag") == "N", "#NÚM!").when(
        F.col("l_linestatus") == "O", F.col("l_quantity").cast("int").cast("string")
    )
    shown = F.coalesce(text, F.concat(F.lit("q"), F.col("l_linenumber")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", labels.coerce_number(shown).alias("number"))


def series_label(spark, d):
    return reports.channel_series(r_channel_evolution(spark, d), TAXONOMY)


def report_caption(spark, d):
    title = scope_source.scope_label(catalogue(spark, d), 7)
    rows = cases(spark, d)
    captions = TAXONOMY.captions
    total = reports.total_cases(rows, scope(), START, END)
    last = reports.total_cases(rows, scope(), month=END)
    return sets.union_all(
        [
            reports.report_caption(total, title, captions["type_breakdown"], START, END),
            reports.report_caption(last, title, captions["type_breakdown"], None, END),
            reports.report_caption(total, title, captions["category_brand"], START, END),
        ]
    )


# Reports


def r_channel_evolution(spark, d):
    return reports.channel_evolution(
        cases(spark, d), scope(TRADITIONAL), scope(DIGITAL), CHANNEL_START, CHANNEL_END, TAXONOMY
    )


def _report(make, last: bool = False, first: bool = False, **options) -> Query:
    span = {"month": END} if last else {"month": START} if first else {"start": START, "end": END}
    return lambda spark, d: make(cases(spark, d), scope(), **span, taxonomy=TAXONOMY, **options)


def r_total_cases(spark, d):
    return reports.total_cases(cases(spark, d), scope(), START, END)


def r_report_pack(spark, d):
    return pack.report_pack(cases(spark, d), registry(), PARAMS, TAXONOMY)


def r_report_pack_per_key_set(spark, d):
    return pack.report_pack(cases(spark, d), registry(), PARAMS, TAXONOMY, counting=PER_KEY_SET)


def r_report_pack_one_pass(spark, d):
    return pack.report_pack(cases(spark, d), registry(), PARAMS, TAXONOMY, counting=ONE_PASS)


def r_report_packs(spark, d):
    """The packs of five scopes together."""
    requests = [replace(PARAMS, scope=scope_id) for scope_id in registry().ids()]
    return pack.report_packs(cases(spark, d), registry(), requests, TAXONOMY)


def r_report_pack_given_brands(spark, d):
    """With the brands of the catalogue instead of a scan of all months."""
    brands = table(spark, d, "part").select(F.nullif("p_brand", F.lit("Brand#13")).alias("brand")).distinct()
    return pack.report_pack(cases(spark, d), registry(), PARAMS, TAXONOMY, brands=brands)


def r_report_pack_captions(spark, d):
    frames = pack.report_sheets(cases(spark, d), registry(), PARAMS, TAXONOMY)
    return pack.pack_captions(frames, PARAMS, scope_source.scope_label(catalogue(spark, d), 7), TAXONOMY)


def report_attributes(spark, d):
    """Colours of the types present, and of the types in front of the other reasons."""
    rows = cases(spark, d)
    types = attributes.type_colours(reports.type_breakdown(rows, scope(), START, END, taxonomy=TAXONOMY), taxonomy=TAXONOMY)
    others = attributes.prefix_colours(
        reports.other_pareto(rows, scope(), START, END, taxonomy=TAXONOMY), "reason", {"2-High": "#22", "5-LOW": "#55"}, "#00"
    )
    return sets.union_all([types.select(F.col("case_type").alias("label"), "colour"), others.select(F.col("reason").alias("label"), "colour")])


def r_report_pack_direct(spark, d):
    return pack.report_pack(cases(spark, d), registry(), PARAMS, TAXONOMY, counting=pack.PER_REPORT)


# Counts kept by month


def kept_months(spark: SparkSession, d: str) -> monthly.MonthlyCounts:
    """All months counted once, with other brands in May 1996; then that month counted again."""
    rows = stored(cases(spark, d).drop("event_date"))
    before = F.when(F.col("month") == F.lit("1996-05-01").cast("date"), F.concat(F.lit("old "), F.col("brand"))).otherwise(F.col("brand"))
    kept = monthly.MonthlyCounts(shared_folder(spark), ("channel",))
    kept.rebuild(rows.withColumn("brand", before))
    kept.refresh(rows, ["1996-05"])
    return kept


def r_pack_from_months(spark, d):
    return monthly.pack_from_months(spark, kept_months(spark, d), monthly_registry(), PARAMS, TAXONOMY)


def brands_maintained(spark, d):
    known = monthly_registry()
    return kept_months(spark, d).brands(spark, known.scopes(known.ids()))


def r_category_brand_kept(spark, d):
    """The category report with the kept brand list: no case outside the period is read."""
    brands = kept_months(spark, d).brands(spark, monthly_registry().scope(SCOPE)).select("brand")
    return reports.category_by_brand_long(cases(spark, d), scope(), START, END, taxonomy=TAXONOMY, brands=brands)


def multi_scope_from_months(spark, d):
    """Totals of a hundred scopes from kept counts."""
    known, ids = many_scopes(100)
    kept = kept_months(spark, d)
    return kept.counts(spark, known.scopes(ids), (), PARAMS.period)


# Many scopes, paths, labels with blanks, months as text


def multi_scope_2000(spark, d):
    known, ids = many_scopes(2000)
    return reports.total_cases(cases(spark, d), known.scopes(ids), START, END)


def scope_path(spark, d):
    return scope_source.scope_paths(hierarchy(spark, d)).drop("ids")


def padded(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose types end in blanks, as many as the month tells."""
    blanks = F.repeat(F.lit(" "), F.month("month") % 3)
    return cases(spark, d).withColumn("case_type", F.concat(F.col("case_type"), blanks))


def filter_type_padded(spark, d):
    return filters.type_is(padded(spark, d), "1-urgent  ").select(*RAW)


def count_by_padded(spark, d):
    return aggregate.count_by(padded(spark, d), "case_type")


def text_month_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their month as text in several spellings, and in none for some."""
    spelled = """CASE l_linenumber WHEN 1 THEN date_format(l_shipdate, 'yyyy-MM-dd') WHEN 2 THEN date_format(l_shipdate, 'MM/yyyy')
        WHEN 3 THEN date_format(l_shipdate, ' dd/MM/yyyy ') WHEN 4 THEN date_format(l_shipdate, 'yyyyMMdd') WHEN 5 THEN date_format(l_shipdate, 'yyyy-MM')
        WHEN 6 THEN concat('n/a ', l_returnflag) ELSE NULL END"""
    return line_cases(spark, d, spelled)


def read_cases_text_months(spark, d):
    return aggregate.count_rows(read_view(spark, text_month_rows(spark, d), "text_months"), ["month"])


def bad_months(spark, d):
    text_month_rows(spark, d).createOrReplaceTempView("cases_bad_months")
    return months_unread(spark, TableSource("cases_bad_months"))


def pivot_as_map(spark, d):
    counts = aggregate.count_rows(in_period(spark, d), ["subcat1", "brand"])
    cell = F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return pivot.pivot_map(counts, "subcat1", "brand").select("subcat1", F.array_join(cell, ",").alias("cells"))


def report_published(spark, d):
    """The newest of two published versions."""
    root, report = shared_folder(spark), report_long(spark, d)
    publish_report(report.where("sheet = 'channel_evolution'"), root)
    publish_report(report, root)
    return read_published(spark, root).select(*report.columns)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_cases,
        scope_filter,
        scope_label,
        report_long,
        report_manifest,
        multi_scope_top,
        multi_scope_complaints,
        multi_scope_types,
        multi_scope_total,
        multi_scope_total_by_case,
        month_start,
        filter_month_range,
        filter_single_month,
        filter_optional_range,
        filter_type_eq,
        filter_type_ne,
        filter_in,
        filter_not_in,
        drop_null_rows,
        having_drop_group,
        full_join_months,
        anti_join_null_aware,
        anti_join_sum,
        lookup_default,
        count_by_month,
        count_by_type,
        count_by_label,
        count_constant_label,
        global_sum,
        grand_total,
        distinct_brands,
        brand_list,
        pivot_brand,
        top10_reasons,
        top10_with_remainder,
        top10_null_among,
        top10_null_outside,
        pareto_share,
        share_of_total,
        row_numbers,
        explicit_order,
        remainder_last,
        pivot_sorted,
        union_all_parts,
        present_categories,
        label_reason,
        label_default,
        label_brand,
        label_line_variant,
        label_type_reason,
        title_case,
        capitalize,
        strip_brackets,
        month_label,
        coerce_numeric,
        series_label,
        report_caption,
        r_channel_evolution,
        r_total_cases,
        r_report_pack,
        r_report_pack_per_key_set,
        r_report_pack_one_pass,
        r_report_pack_given_brands,
        r_report_pack_captions,
        report_attributes,
        read_cases_timestamp_day,
        read_cases_mid_month,
        scopes_from_table,
        pivot_special_names,
        r_report_pack_direct,
        r_report_packs,
        top_n_two_phase,
        pareto_all_reasons,
        pareto_all_suppliers,
        r_pack_from_months,
        brands_maintained,
        r_category_brand_kept,
        multi_scope_from_months,
        multi_scope_2000,
        scope_path,
        filter_type_padded,
        count_by_padded,
        read_cases_text_months,
        bad_months,
        pivot_as_map,
        report_published,
    )
} | {
    "r_type_breakdown": _report(reports.type_breakdown),
    "r_type_breakdown_last": _report(reports.type_breakdown, last=True),
    "r_type_breakdown_first": _report(reports.type_breakdown, first=True),
    "r_type_breakdown_unknown": _report(reports.type_breakdown, include_unknown=True),
    "r_complaint_pareto": _report(reports.complaint_pareto),
    "r_complaint_pareto_last": _report(reports.complaint_pareto, last=True),
    "r_other_pareto": _report(reports.other_pareto),
    "r_other_pareto_last": _report(reports.other_pareto, last=True),
    "r_category_brand": lambda spark, d: placed(_report(reports.category_by_brand)(spark, d)),
    "r_category_brand_last": lambda spark, d: placed(_report(reports.category_by_brand, last=True)(spark, d)),
    "r_category_brand_long": _report(reports.category_by_brand_long),
    "r_top_line_variant": _report(reports.top_line_variant),
    "r_top_line_variant_last": _report(reports.top_line_variant, last=True),
    "r_top_subcat2": _report(reports.top_subcat2),
    "r_top_subcat2_last": _report(reports.top_subcat2, last=True),
}
