from datetime import date

import pytest
from pyspark.sql import functions as F

from scopelens.model import ReportParams
from scopelens.operators.filters import in_month_range
from scopelens.operators.joins import full_join_counts
from scopelens.plans import pack, reports
from scopelens.plans import shared_counts as sc
from scopelens.sources.scopes import ScopeRegistry
from scopelens.sources.sinks import manifest, write_report
from scopelens.vocabulary import PORTUGUESE
from tests.conftest import tuples

REGISTRY = (
    ScopeRegistry().add(1).add(2, "channel = 'phone'", parent=1).add(3, "channel = 'digital'", parent=1)
)
ALL, PHONE, DIGITAL = REGISTRY.scopes([1, 2, 3])
SPAN = {"start": "2024-01", "end": "2024-03"}


def sample(make_cases):
    groups = ["Comentários e Menções", "Dúvida", None]
    rows = [
        {"case_type": "Reclamação", "case_group": "INFESTAÇÃO", "reason": f"bicho {i}", "brand": "b1", "subcat1": "s1"}
        for i in range(4)
    ]
    rows += [{"case_type": "RECLAMAÇÃO", "reason": f"r{i:02}", "brand": "B1"} for i in range(12)]
    rows += [{"case_type": "reclamação", "reason": "r00", "brand": "Em Geral", "subcat1": "S1"}]
    rows += [{"case_type": "Redes Sociais", "case_group": g, "reason": "post", "subcat1": "s2"} for g in groups]
    rows += [{"case_type": "Elogio", "reason": None}, {"case_type": None, "reason": "x"}]
    rows += [{"month": "2024-03", "case_type": "Sugestão", "reason": "idea", "line": "regular", "variant": "v"}]
    rows += [{"month": "2023-12", "brand": "b9", "case_type": "Elogio"}]
    for at, row in enumerate(rows):
        row["channel"] = "phone" if at % 3 else "digital"
    return make_cases(*rows)


def test_type_breakdown(make_cases):
    found = reports.type_breakdown(sample(make_cases), ALL, **SPAN)
    expected = [
        ("Elogio", 1, 2),
        ("Reclamação", 17, 4),
        ("Sugestão", 1, 6),
        ("Comentários E Menções", 1, 7),
        ("Outras Interações", 1, 8),
        (None, 1, None),
    ]
    assert [(r.case_type, r.total, r["rank"]) for r in found.collect()] == expected
    assert sum(r.share for r in found.collect()) == pytest.approx(1.0)


def test_type_breakdown_with_unknown_group(make_cases):
    found = reports.type_breakdown(sample(make_cases), ALL, **SPAN, include_unknown=True, style="capitalize")
    assert {r.case_type: r.total for r in found.collect()}["Sem grupo"] == 1


def test_part_is_absent_not_zero(make_cases):
    cases = make_cases(*[{"case_type": "Redes Sociais", "case_group": "Dúvida"}] * 2)
    found = reports.type_breakdown(cases, ALL, month="2024-01")
    assert [(r.case_type, r.total) for r in found.collect()] == [("Outras Interações", 2)]


def test_a_type_named_like_a_part_stays_apart(make_cases):
    cases = make_cases(
        {"case_type": "Redes Sociais", "case_group": "Dúvida"}, {"case_type": PORTUGUESE.others_label}
    )
    found = reports.type_breakdown(cases, ALL, month="2024-01")
    assert [(r.case_type, r.total) for r in found.collect()] == [("Outras Interações", 1)] * 2


def test_complaint_pareto(make_cases):
    found = reports.complaint_pareto(sample(make_cases), ALL, **SPAN, n=3).collect()
    assert [(r["rank"], r.reason, r.total) for r in found] == [
        (1, "Infestação", 4),
        (2, "R00", 2),
        (3, "R01", 1),
        (4, "Reclamações Em Menor Volume", 10),
    ]
    assert [r.cum_share for r in found] == [4 / 17, 6 / 17, 7 / 17, 1.0]


def test_other_pareto_without_complaints_or_unknown_types(make_cases):
    found = reports.other_pareto(sample(make_cases), ALL, **SPAN).collect()
    assert [(r.reason, r.total) for r in found] == [
        ("Redes Sociais - Post", 3),
        (None, 1),
        ("Sugestão - Idea", 1),
    ]


def test_null_label_completes_the_remainder(make_cases):
    rows = [{"case_type": "Reclamação", "reason": r} for r in "aaaaa"]
    rows += [{"case_type": "Reclamação"}] * 4 + [{"case_type": "Reclamação", "reason": "b"}]
    cases = make_cases(*rows)
    plain = reports.complaint_pareto(cases, ALL, month="2024-01", n=2)
    assert [(r.reason, r.total) for r in plain.collect()] == [("A", 5), (None, 4)]
    named = reports.complaint_pareto(cases, ALL, month="2024-01", n=2, null_label="none")
    assert [(r.reason, r.total) for r in named.collect()] == [
        ("A", 5),
        ("None", 4),
        ("Reclamações Em Menor Volume", 1),
    ]


def test_category_by_brand(make_cases):
    cases = sample(make_cases)
    wide = reports.category_by_brand(cases, ALL, **SPAN)
    assert wide.columns == ["category", "B1", "B9", "Não Identificada"]
    assert tuples(wide) == [("Geral", 12, 0, 0), ("S1", 4, 0, 1), ("S2", 0, 0, 0)]
    long = reports.category_by_brand_long(cases, ALL, **SPAN)
    assert sorted(tuples(long), key=str) == [
        ("Geral", "B1", 12),
        ("S1", "B1", 4),
        ("S1", "Não Identificada", 1),
        ("S2", None, 0),
        (None, "B9", 0),
    ]


def test_category_with_given_brands(make_cases):
    wide = reports.category_by_brand(sample(make_cases), ALL, **SPAN, brands=["B1", "X"])
    assert tuples(wide) == [("Geral", 12, 0), ("S1", 4, 0), ("S2", 0, 0)]


def test_top_line_variant(make_cases):
    rows = [(None, None), ("regular", "v"), ("REGULAR", None), ("l", "v"), ("L", "V"), ("l", None), (None, "l")]
    cases = make_cases(*[{"line": a, "variant": b} for a, b in rows])
    found = reports.top_line_variant(cases, ALL, month="2024-01")
    assert [(r.line_variant, r.total) for r in found.collect()] == [
        ("L", 2),
        ("L-V", 2),
        (None, 1),
        ("Cortes Em Geral", 1),
        ("V", 1),
    ]


def test_top_subcat2(make_cases):
    cases = make_cases(*[{"subcat2": s} for s in ("a", "A", None, "em geral", "b")])
    found = reports.top_subcat2(cases, ALL, month="2024-01", n=2)
    assert tuples(found) == [(1, "A", 2), (2, "Em Geral", 2)]


def test_channels(make_cases):
    cases = make_cases(
        {"month": "2024-01", "channel": "phone"},
        {"month": "2024-02", "channel": "phone"},
        {"month": "2024-02", "channel": "digital"},
        {"month": "2024-03", "channel": "digital"},
        {"month": "2024-04", "channel": None},
        {"month": None, "channel": "phone"},
        {"month": None, "channel": "digital"},
    )
    found = tuples(reports.channel_evolution(cases, PHONE, DIGITAL))
    assert [row[2:] for row in found] == [(1, 0), (0, 1), (1, 0), (1, 1), (0, 1)] or [
        row[2:] for row in found
    ] == [(0, 1), (1, 0), (1, 0), (1, 1), (0, 1)]
    assert [row[1] for row in found] == [None, None, "Jan/24", "Fev/24", "Mar/24"]
    ranged = tuples(reports.channel_evolution(cases, PHONE, DIGITAL, "2024-02", "2024-03"))
    assert ranged == [(date(2024, 2, 1), "Fev/24", 1, 1), (date(2024, 3, 1), "Mar/24", 0, 1)]
    sides = [
        cases.where(scope.predicate).groupBy("month").agg(F.count(F.lit(1)).alias(name))
        for scope, name in ((PHONE, "traditional"), (DIGITAL, "digital"))
    ]
    joined = full_join_counts(*sides, on="month")
    assert sorted(tuples(joined), key=str) == sorted([(r[0], *r[2:]) for r in found], key=str)
    series = tuples(reports.channel_series(reports.channel_evolution(cases, PHONE, DIGITAL)))
    assert series == [("traditional", 3, "Tradicionais = 3"), ("digital", 3, "Digitais = 3")]


def test_caption(spark, make_cases):
    cases = sample(make_cases)
    total = reports.total_cases(cases, ALL, **SPAN)
    captions = PORTUGUESE.captions
    found = reports.report_caption(total, "Tudo", captions["type_breakdown"], "2024-01", "2024-03")
    assert tuples(found) == [("Tudo \nRepresentatividade de tipos de ocorrência\n23 manifestações - jan/24 a mar/24",)]
    found = reports.report_caption(total, "Tudo", captions["subcat2"], None, "2024-03")
    assert tuples(found)[0][0].endswith("10 Principais manifestações \nmar/24")


ALL_REPORTS = {
    "types": reports.type_breakdown,
    "complaints": reports.complaint_pareto,
    "others": reports.other_pareto,
    "category": reports.category_by_brand_long,
    "lines": reports.top_line_variant,
    "subcat2": reports.top_subcat2,
    "total": reports.total_cases,
}


@pytest.mark.parametrize("name", ALL_REPORTS)
def test_a_list_of_scopes_equals_each_alone(make_cases, name):
    cases, make = sample(make_cases), ALL_REPORTS[name]
    together = make(cases, [ALL, PHONE, DIGITAL], **SPAN)
    for scope in (ALL, PHONE, DIGITAL):
        chosen = together.where(F.col("scope_id") == scope.scope_id).drop("scope_id")
        assert sorted(tuples(chosen), key=str) == sorted(tuples(make(cases, scope, **SPAN)), key=str)


@pytest.mark.parametrize("name", ALL_REPORTS)
def test_nothing_in_the_period(make_cases, name):
    found = ALL_REPORTS[name](sample(make_cases), ALL, month="2030-01")
    rows = [row for row in found.collect() if name != "category" or row.category is not None]
    assert rows == ([(0,)] if name == "total" else [])


def test_wide_category_of_an_empty_period(make_cases):
    wide = reports.category_by_brand(sample(make_cases), ALL, month="2030-01")
    assert wide.columns == ["category", "B1", "B9", "Não Identificada"]
    assert wide.count() == 0
    assert reports.category_by_brand(make_cases({}), ALL, month="2030-01").columns == ["category"]


def test_channels_of_an_empty_period(make_cases):
    assert reports.channel_evolution(sample(make_cases), PHONE, DIGITAL, "2030-01", "2030-02").count() == 0


PARAMS = ReportParams(1, 2, 3, "2024-01", "2024-03", "2023-12", "2024-02", top=3)


@pytest.mark.parametrize(
    "channel_range, sheets",
    [
        (("2023-12", "2024-02"), pack.FULL_PACK),
        (("2024-01", "2024-02"), pack.FULL_PACK),
        (("2024-01", "2024-02"), pack.SUMMARY_PACK),
        ((None, None), pack.SUMMARY_PACK),
    ],
)
def test_shared_counts_equal_direct(make_cases, channel_range, sheets):
    cases = sample(make_cases)
    params = ReportParams(1, 2, 3, "2024-01", "2024-03", *channel_range, top=3)
    direct = tuples(pack.report_pack(cases, REGISTRY, params, sheets=sheets, counting=pack.PER_REPORT))
    # The sample has no complaint in the last month, so that sheet has no rows.
    assert {row[0] for row in direct} == set(sheets) - {"complaint_pareto_last"}
    for counting in (sc.ONE_PASS, sc.PER_KEY_SET):
        shared = pack.report_pack(cases, REGISTRY, params, sheets=sheets, counting=counting)
        assert sorted(tuples(shared), key=str) == sorted(direct, key=str)


def test_one_sheet_alone(make_cases):
    cases = sample(make_cases)
    for sheet in ("channel_evolution", "subcat2_last", "category_brand"):
        alone = tuples(pack.report_pack(cases, REGISTRY, PARAMS, sheets=[sheet]))
        whole = tuples(pack.report_pack(cases, REGISTRY, PARAMS).where(F.col("sheet") == sheet))
        assert sorted(alone, key=str) == sorted(whole, key=str)


def test_unknown_counting(make_cases):
    with pytest.raises(ValueError):
        pack.report_pack(make_cases({}), REGISTRY, PARAMS, counting="guess")


def test_sheets_are_the_single_reports(make_cases):
    cases = sample(make_cases)
    sheets = pack.report_sheets(cases, REGISTRY, PARAMS)
    assert list(sheets) == list(pack.FULL_PACK)
    last = {"month": "2024-03"}
    expected = {
        "channel_evolution": reports.channel_evolution(cases, PHONE, DIGITAL, "2023-12", "2024-02"),
        "type_breakdown": reports.type_breakdown(cases, ALL, **SPAN),
        "type_breakdown_last": reports.type_breakdown(cases, ALL, **last),
        "complaint_pareto": reports.complaint_pareto(cases, ALL, **SPAN, n=3),
        "other_pareto_last": reports.other_pareto(cases, ALL, **last, n=3),
        "category_brand_last": reports.category_by_brand_long(cases, ALL, **last),
        "line_variant": reports.top_line_variant(cases, ALL, **SPAN, n=3),
        "subcat2": reports.top_subcat2(cases, ALL, **SPAN, n=3),
    }
    for sheet, frame in expected.items():
        assert sorted(tuples(sheets[sheet].select(*frame.columns)), key=str) == sorted(tuples(frame), key=str), sheet


def test_writing_and_manifest(spark, make_cases, tmp_path):
    cases = sample(make_cases).where("month = DATE'2024-01-01'")
    report = pack.report_pack(cases, REGISTRY, PARAMS)
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        write_report(report, path, fmt)
        reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
        assert reader.format(fmt).load(path).count() == report.count()
    states = {r.sheet: r.state for r in manifest(report, pack.FULL_PACK, pack.SKIPPED_IF_EMPTY).collect()}
    assert states["complaint_pareto"] == "written"
    assert states["complaint_pareto_last"] == "empty"
    assert states["subcat2_last"] == "skipped"
    with pytest.raises(ValueError):
        write_report(report, str(tmp_path / "x"), "xlsx")


def test_one_label_with_most_cases(spark):
    """A third of the cases in one month and one label; a few tasks see all of it."""
    hot = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('r', id % 1000) END"
    cases = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN DATE'2024-01-01' ELSE add_months(DATE'2024-01-01', CAST(id % 24 AS INT)) END AS month",
        "'Reclamação' AS case_type", "CAST(NULL AS STRING) AS case_group", f"{hot} AS reason", f"{hot} AS brand",
        f"{hot} AS subcat1", f"{hot} AS subcat2", f"{hot} AS line", f"{hot} AS variant", "'phone' AS channel",
    )
    found = reports.complaint_pareto(cases, ALL, "2024-01", "2025-12").collect()
    assert (found[0].reason, found[0].total) == ("Hot", 10000)
    assert sum(r.total for r in found) == 30000


def test_totals_agree(make_cases):
    cases = sample(make_cases)
    complaints = in_month_range(cases, "2024-01", "2024-03").where("lower(case_type) = 'reclamação'").count()
    pareto = reports.complaint_pareto(cases, ALL, **SPAN, n=2).collect()
    assert sum(r.total for r in pareto) == complaints
    assert pareto[-1].cum_share == 1.0
    branded = in_month_range(cases, "2024-01", "2024-03").where("brand IS NOT NULL").count()
    wide = reports.category_by_brand(cases, ALL, **SPAN).collect()
    assert sum(sum(row[1:]) for row in wide) == branded


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("counting, dimensions", [(sc.ONE_PASS, ()), (sc.PER_KEY_SET, ("channel",))])
def test_many_packs_equal_each_alone(make_cases, counting, dimensions):
    cases = sample(make_cases)
    known = ScopeRegistry(dimensions).add(1).add(2, "channel = 'phone'", parent=1).add(3, "channel = 'digital'", parent=1)
    sides = {1: (2, 3), 2: (3, 1), 3: (2, 3)}
    requests = [ReportParams(i, *sides[i], "2024-01", "2024-03", "2023-12", "2024-02", top=3) for i in sides]
    together = pack.report_packs(cases, known, requests, counting=counting).collect()
    for request in requests:
        alone = tuples(pack.report_pack(cases, known, request))
        mine = [tuple(r[c] for c in ("sheet", "position", "label", "series", "value")) for r in together if r.scope_id == request.scope]
        assert sorted(mine, key=str) == sorted(alone, key=str)


def test_packs_that_cannot_be_made_together(make_cases):
    other = ReportParams(2, 2, 3, "2024-01", "2024-02", "2023-12", "2024-02", top=3)
    for requests in ([], [PARAMS, other], [PARAMS, PARAMS]):
        with pytest.raises(ValueError):
            pack.report_packs(make_cases({}), REGISTRY, requests)


KEY_SETS = (reports.KIND_KEYS, reports.PAIR_KEYS, reports.LINE_KEYS, reports.SUBCAT2_KEYS)


@pytest.mark.parametrize("channel_range, scans", [(("2024-01", "2024-02"), 1), (("2023-12", "2024-02"), 2)])
def test_one_pass_scans_once(spark, make_cases, tmp_path, channel_range, scans):
    sample(make_cases).write.parquet(str(tmp_path / "c"))
    cases = spark.read.parquet(str(tmp_path / "c"))
    params = ReportParams(1, 2, 3, "2024-01", "2024-03", *channel_range)
    plan = plan_of(sc.pack_counts(cases, REGISTRY, params, KEY_SETS, brands=False, counting=sc.ONE_PASS))
    assert plan.count("FileScan") == plan.count("Exchange") == scans
    assert "GreaterThanOrEqual(month,2024-01-01), LessThanOrEqual(month,2024-03-01)" in plan


def test_a_scan_per_key_set_reads_its_columns_only(spark, make_cases, tmp_path):
    sample(make_cases).write.parquet(str(tmp_path / "c"))
    cases = spark.read.parquet(str(tmp_path / "c"))
    plan = plan_of(
        sc.pack_counts(cases, REGISTRY, PARAMS, KEY_SETS, channels=False, brands=False, counting=sc.PER_KEY_SET)
    )
    schemas = sorted(part.split("\n")[0] for part in plan.split("ReadSchema: ")[1:])
    assert schemas == [
        "struct<month:date,brand:string,subcat1:string>",
        "struct<month:date,case_type:string,case_group:string,reason:string>",
        "struct<month:date,line:string,variant:string>",
        "struct<month:date,subcat2:string>",
    ]
