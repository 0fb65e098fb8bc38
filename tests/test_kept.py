"""Counts kept by month, places and sums over ranges, two-phase top n, memberships, paths, versions."""

import random
import shutil
import subprocess
import sys
from collections import Counter
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scopelens.model import ReportParams
from scopelens.operators import aggregate, filters, heavy, pivot, prefix, sets
from scopelens.plans import membership, monthly, pack, reports
from scopelens.plans.counts import scope_counts
from scopelens.session import stored
from scopelens.sources import sinks
from scopelens.sources.cases import FileSource, bad_months, read_cases, write_cases
from scopelens.sources.scopes import ScopeRegistry, scope_paths
from tests.conftest import tuples

ROOT = Path(__file__).resolve().parents[1]


def registry():
    return ScopeRegistry(("channel", "month")).add(1).add(2, "channel = 'a'", parent=1).add(3, "month >= DATE'2024-02-01'", parent=2)


@pytest.fixture
def rows(make_cases):
    source = random.Random(4)
    return make_cases(
        *[
            {
                "month": source.choice(["2024-01", "2024-02", "2024-03"]),
                "channel": source.choice(["a", "b", None]),
                "case_type": source.choice(["Reclamação", "reclamação ", "Elogio", None]),
                "case_group": source.choice(["g", None]),
                "reason": source.choice(["Late", "late", "broken", "lost ", None]),
                "brand": source.choice(["X", "Y", None]),
                "subcat1": source.choice(["s", "t", None]),
                "subcat2": source.choice(["u", "v", None]),
                "line": source.choice(["l", None]),
                "variant": source.choice(["w", None]),
            }
            for _ in range(150)
        ]
    )


# Counts kept by month


def test_kept_counts_equal_counts_of_the_cases(spark, rows, tmp_path):
    kept = monthly.MonthlyCounts(str(tmp_path / "kept"), ("channel",))
    kept.rebuild(rows)
    known = registry()
    for keys in (("subcat1", "brand"), ("line", "variant"), ()):
        for scope in (known.scope(2), known.scopes([1, 2, 3])):
            found = kept.counts(spark, scope, keys, None)
            direct = scope_counts(rows, scope, keys, None)
            direct = direct.groupBy(*[c for c in direct.columns if c != "total"]).agg(F.sum("total").alias("total"))
            assert Counter(tuples(found)) == Counter(tuples(direct.select(*found.columns)))
    with pytest.raises(ValueError):
        kept.counts(spark, known.scope(1), ("variant",), None)


def test_a_pack_from_kept_counts_is_the_pack(spark, rows, tmp_path):
    kept = monthly.MonthlyCounts(str(tmp_path / "kept"), ("channel",))
    kept.rebuild(rows)
    params = ReportParams(1, 2, 3, "2024-01", "2024-02")
    for sheets in (pack.FULL_PACK, pack.SUMMARY_PACK):
        found = monthly.pack_from_months(spark, kept, registry(), params, sheets=sheets)
        assert Counter(tuples(found)) == Counter(tuples(pack.report_pack(rows, registry(), params, sheets=sheets).select(*found.columns)))


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("part-*")}


def test_a_month_is_replaced_alone(spark, rows, make_cases, tmp_path):
    kept = monthly.MonthlyCounts(str(tmp_path / "kept"), ("channel",))
    kept.rebuild(rows)
    before = files(kept.path)
    changed = rows.where("month <> DATE'2024-02-01'").unionByName(make_cases({"month": "2024-02", "brand": "New", "channel": "a"}))
    kept.refresh(changed, ["2024-02"])
    after = files(kept.path)
    assert {f for f in before if "2024-02" not in f} == {f for f in after if "2024-02" not in f}
    assert not {f for f in before if "2024-02" in f} & after
    assert tuples(kept.counts(spark, registry().scope(1), (), None)) == [(changed.count(),)]
    kept.refresh(changed.where("month <> DATE'2024-02-01'"), ["2024-02"])  # nothing is left of the month
    assert tuples(kept.counts(spark, registry().scope(1), (), None)) == [(changed.count() - 1,)]


def test_a_range_reads_its_months_alone(spark, rows, tmp_path):
    kept = monthly.MonthlyCounts(str(tmp_path / "kept"), ("channel",))
    kept.rebuild(rows)
    found = kept.counts(spark, registry().scope(1), ("subcat2",), ReportParams(1, 2, 3, "2024-03", "2024-03").period)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "month#" in plan.split("PartitionFilters")[1]
    scanned = found._jdf.queryExecution().executedPlan()
    assert "2024-01" not in str(scanned.toString()).split("PartitionFilters")[1].split("PushedFilters")[0]


def test_brands_come_and_go_with_their_months(spark, make_cases, tmp_path):
    kept = monthly.MonthlyCounts(str(tmp_path / "kept"), ("channel",))
    one = [{"month": m, "brand": b, "channel": c} for m, b, c in (("2024-01", "X", "a"), ("2024-02", "Y", "a"), ("2024-03", "X", "b"), ("2024-02", None, "a"))]
    kept.rebuild(make_cases(*one))
    january, february, march = date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)
    known = registry()
    assert sorted(tuples(kept.brands(spark, known.scope(1)))) == [("X", january, march), ("Y", february, february)]
    assert sorted(tuples(kept.brands(spark, known.scopes([2, 3])))) == [(2, "X", january, january), (2, "Y", february, february), (3, "Y", february, february)]
    kept.refresh(make_cases(*one[:1], *one[2:]), ["2024-02"])
    assert sorted(tuples(kept.brands(spark, known.scope(2)))) == [("X", january, january)]


# Places and sums over ranges


def test_running_sums_over_ranges(spark):
    source = random.Random(1)
    rows = [(source.choice(["g", "h", None]), k, source.randrange(5)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, total long")
    found = prefix.running(df, [F.desc("total"), F.asc("k")], by=["g"])
    expected = []
    for group in ("g", "h", None):
        total = 0
        for place, (g, k, value) in enumerate(sorted([r for r in rows if r[0] == group], key=lambda r: (-r[2], r[1])), start=1):
            total += value
            expected.append((g, k, value, place, total))
    assert Counter(tuples(found)) == Counter(expected)
    assert prefix.running(df.where("k < 0"), [F.asc("k")]).count() == 0
    numbered = prefix.numbered(df, [F.asc("k")], "place")
    assert sorted(tuples(numbered.select("k", "place"))) == [(k, k + 1) for k in range(300)]


def test_pareto_classes(make_counts):
    found = prefix.pareto_classes(make_counts(("a", 70), ("b", 15), ("c", 11), ("d", 3), (None, 1)), "label")
    assert sorted(tuples(found)) == [
        (1, "a", 70, 0.7, "A"),
        (2, "b", 15, 0.85, "A"),
        (3, "c", 11, 0.96, "B"),
        (4, "d", 3, 0.99, "C"),
        (5, None, 1, 1.0, "C"),
    ]


# Top n in two phases


def labels(spark, counts):
    return spark.createDataFrame([(name,) for name, n in counts.items() for _ in range(n)], "label string")


def test_two_phase_top_n(spark):
    frequent = {f"big{k}": 200 + k for k in range(12)} | {f"small{k}": 1 for k in range(900)} | {None: 205, "BIG3 ": 50}
    flat = {f"l{k}": 2 for k in range(400)} | {"l5": 3}
    for counts in (frequent, flat, {"a": 1, None: 4}, {}):
        df = labels(spark, counts)
        expected = Counter()
        for name, n in counts.items():
            expected[name and name.rstrip().lower()] += n
        order = sorted(expected.items(), key=lambda item: (-item[1], item[0] is not None, item[0] or ""))[:10]
        for tracked in (20, 10_000):
            assert Counter(tuples(heavy.top_n_two_phase(df, F.col("label"), "label", 10, tracked))) == Counter(order)


def test_the_summary_bounds_what_it_leaves_out(spark):
    counts = {f"big{k}": 300 for k in range(5)} | {f"small{k}": 1 + k % 7 for k in range(2000)}
    known = heavy.summary(labels(spark, counts), "label", 64)
    assert len(known.candidates) <= 64 and known.rows == sum(counts.values())
    assert all(n <= known.unseen for name, n in counts.items() if name not in known.candidates)
    small = heavy.summary(labels(spark, {"a": 3, "b": 1}), "label", 64)
    assert sorted(small.candidates) == ["a", "b"] and small.unseen == 0


# Thousands of scopes


def test_memberships_equal_conditions(spark, rows):
    known = registry()
    for k in range(250):
        known.add(100 + k, f"month >= DATE'2024-0{k % 3 + 1}-01'" + (f" AND channel <> 'z{k}'" if k % 2 else ""), parent=(1, 2)[k % 2])
    ids = known.ids()
    assert len(ids) >= membership.MANY_SCOPES
    found = scope_counts(rows, known.scopes(ids), ("subcat1",), None)
    few = sets.union_all([scope_counts(rows, known.scopes(ids[at : at + 100]), ("subcat1",), None) for at in range(0, len(ids), 100)])
    together = few.groupBy("scope_id", "subcat1").agg(F.sum("total").alias("total"))
    assert Counter(tuples(found)) == Counter(tuples(together))
    by_month = scope_counts(rows, known.scopes(ids), ("month",), None)
    assert by_month.agg(F.sum("total")).first() == found.agg(F.sum("total")).first()


def test_no_plan_holds_a_condition_for_each_scope(spark, rows):
    known = ScopeRegistry(("channel", "month")).add(1)
    for k in range(2000):
        known.add(100 + k, f"month >= DATE'2024-01-01' AND channel <> 'z{k}'", parent=1)
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        words = membership.condition_words(stored(rows.select("channel", "month").distinct()), membership.distinct_conditions(known.scopes(known.ids())))
        plan = words._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Project") >= 2000 // 60 and "*(" in plan
        assert max(line.count("z1") for line in plan.splitlines()) <= 60
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


# Scope paths


def test_scope_paths(spark):
    catalogue = spark.createDataFrame(
        [(1, None, "[ROOT]"), (2, 1, "child one"), (3, 2, None), (4, 9, "lost"), (5, 4, "below lost"), (6, 7, "x"), (7, 6, "y"), (8, 8, "self"), (None, 1, "no id")],
        "scope_id long, parent_id long, name string",
    )
    found = {row["scope_id"]: tuple(row)[1:] for row in scope_paths(catalogue).collect()}
    assert found == {
        1: ("Root", [1], 0, "complete"),
        2: ("Root / Child One", [1, 2], 1, "complete"),
        3: ("Root / Child One / ", [1, 2, 3], 2, "complete"),
        4: ("Lost", [4], 0, "orphan"),
        5: ("Lost / Below Lost", [4, 5], 1, "orphan"),
        6: ("X / Y / X", [6, 7, 6], 2, "circle"),
        7: ("Y / X / Y", [7, 6, 7], 2, "circle"),
        8: ("Self / Self", [8, 8], 1, "circle"),
    }
    with pytest.raises(Exception, match="defined twice"):
        scope_paths(catalogue.union(catalogue)).collect()
    assert scope_paths(catalogue.where("scope_id < 0")).count() == 0


def test_scope_paths_of_more_rows_than_a_recursion_may_return(spark):
    """Trees, unknown parents, circles and ways into them, each against a walk from scope to scope."""
    parents = {k: (k // 4 if k >= 4 else None) for k in range(1, 40)}
    parents |= {100: None, 300: 999, 400: 405, 500: 402, 501: 500, 502: 501}
    parents |= {k: k - 1 for k in (*range(101, 200), *range(301, 306), *range(401, 406))}
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "20")
    try:
        catalogue = spark.createDataFrame([(k, up, f"s{k}") for k, up in parents.items()], "scope_id long, parent_id long, name string")
        found = {row["scope_id"]: (row["ids"], row["path"], row["depth"], row["state"]) for row in scope_paths(catalogue).collect()}
    finally:
        spark.conf.set(limit, before)
    expected = {}
    for k in parents:
        way, at, state = [k], parents[k], "complete"
        while at is not None and state == "complete":
            state = "orphan" if at not in parents else "circle" if at in way else state
            way, at = ([at, *way], parents[at]) if at in parents else (way, None)
        expected[k] = (way, " / ".join(f"S{x}" for x in way), len(way) - 1, state)
    assert found == expected
    assert scope_paths(catalogue.where("scope_id between 100 and 102"), levels=3).count() == 3
    with pytest.raises(Exception, match="levels"):
        scope_paths(catalogue.where("scope_id between 100 and 103"), levels=3).collect()


# Labels with blanks at their end


def test_labels_that_differ_in_blanks_at_the_end_are_one(make_cases):
    rows = make_cases({"case_type": "Reclamação "}, {"case_type": "reclamação"}, {"case_type": " reclamação"}, {"case_type": "Elogio"}, {})
    assert filters.type_is(rows, "RECLAMAÇÃO  ").count() == 2
    assert filters.type_is_not(rows, "reclamação").count() == 2
    assert filters.group_in(rows, ["elogio "], "case_type").count() == 1
    assert Counter(tuples(aggregate.count_by(rows, "case_type"))) == Counter([(" reclamação", 1), ("Elogio", 1), ("Reclamação ", 2), (None, 1)])
    assert tuples(sets.present_in_order(rows, "case_type", ["Elogio ", "RECLAMAÇÃO", "other"])) == [("Elogio ", 1), ("RECLAMAÇÃO", 2)]


def test_brands_and_categories_that_compare_equal_are_one(make_cases):
    rows = make_cases({"brand": "ab ", "subcat1": "c"}, {"brand": "AB", "subcat1": "C  "})
    found = reports.category_by_brand_long(rows, ScopeRegistry().add(1).scope(1), month="2024-01")
    assert tuples(found) == [("C", "Ab", 2)]


# Months as text, stored cases


def test_text_months_and_bad_rows(spark, make_cases, tmp_path):
    texts = ["2024-02-17", "2024-03", " 05/04/2024 ", "06/2024", "20240731", "2024-08-09 10:11:12", "n/a", "", "2024-13", None]
    rows = make_cases(*[{"reason": str(k)} for k in range(len(texts))]).withColumn(
        "month", F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("reason").cast("int") + 1)
    )
    rows.write.parquet(str(tmp_path / "raw"))
    source = FileSource(str(tmp_path / "raw"))
    found = {row["reason"]: (row["month"], row["event_date"]) for row in read_cases(spark, source).collect()}
    assert found == {
        "0": (date(2024, 2, 1), date(2024, 2, 17)),
        "1": (date(2024, 3, 1), date(2024, 3, 1)),
        "2": (date(2024, 4, 1), date(2024, 4, 5)),
        "3": (date(2024, 6, 1), date(2024, 6, 1)),
        "4": (date(2024, 7, 1), date(2024, 7, 31)),
        "5": (date(2024, 8, 1), date(2024, 8, 9)),
        "9": (None, None),
    }
    bad = bad_months(spark, source)
    assert sorted(tuples(bad)) == [("", 1), ("2024-13", 1), ("n/a", 1)]
    assert len(found) + sum(n for _, n in tuples(bad)) == len(texts)


def scanned_rows(df):
    df.collect()
    plan, nodes = df._jdf.queryExecution().executedPlan(), []
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        if "FileSourceScanExec" in node.getClass().getSimpleName():
            nodes.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        waiting += [children.apply(k) for k in range(children.size())]
        for inner in ("executedPlan", "plan"):
            if "AdaptiveSparkPlan" in node.getClass().getSimpleName() and inner == "executedPlan":
                waiting.append(node.executedPlan())
            if "QueryStage" in node.getClass().getSimpleName() and inner == "plan":
                waiting.append(node.plan())
    return sum(nodes)


def test_stored_cases_skip_row_groups(spark, tmp_path):
    names = "case_type case_group reason brand subcat1 subcat2 line variant channel".split()
    rows = spark.range(40_000).select(
        F.lit("2024-01-01").cast("date").alias("month"),
        *[F.concat(F.lit(f"{name} "), (F.col("id") * 7919 % 4001).cast("string")).alias(name) for name in names[:-1]],
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("channel"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(32 * 1024))
    hadoop.set("parquet.page.row.count.limit", "100")
    try:
        write_cases(rows.coalesce(1), str(tmp_path / "plain"))
        write_cases(rows.coalesce(1), str(tmp_path / "kept"), sort_by=["channel", "subcat1"], looked_up=["reason"])
        one = "reason = 'reason 77'"
        plain, kept = (spark.read.parquet(str(tmp_path / name)) for name in ("plain", "kept"))
        assert plain.where(one).count() == kept.where(one).count() == 10
        assert scanned_rows(kept.where(one)) < scanned_rows(plain.where(one)) / 2
        assert scanned_rows(kept.where("channel = 'a'")) < 30_000
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.row.count.limit")
        spark.conf.unset("spark.sql.adaptive.enabled")


# Maps, versions, entry


def test_pivot_map(make_cases):
    rows = make_cases({"subcat1": "s", "brand": "X"}, {"subcat1": "s", "brand": "X"}, {"subcat1": "s", "brand": "Y"}, {"subcat1": "t"}, {"brand": "X"})
    found = pivot.pivot_map(aggregate.count_rows(rows, ["subcat1", "brand"]), "subcat1", "brand")
    assert {row["subcat1"]: row["cells"] for row in found.collect()} == {"s": {"X": 2, "Y": 1}, "t": {}, None: {"X": 1}}


def test_a_failed_version_leaves_the_last_one(spark, tmp_path):
    root = str(tmp_path / "report")
    report = spark.createDataFrame([("s", 1, "l", "x", 2.0)], "sheet string, position long, label string, series string, value double")
    first = sinks.publish_report(report, root)
    broken = report.withColumn("label", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        sinks.publish_report(broken, root)
    assert tuples(sinks.read_published(spark, root).select(*report.columns)) == tuples(report)
    second = sinks.publish_report(report.withColumn("value", F.lit(3.0)), root)
    assert sinks.read_published(spark, root).first()["value"] == 3.0
    assert sinks.read_published(spark, root, first).first()["value"] == 2.0
    assert {row["version"] for row in sinks.published_versions(spark, root).collect()} == {first, second}
    empty = sinks.publish_report(report.where("false"), root)
    assert sinks.read_published(spark, root, empty).count() == 0
    with pytest.raises(LookupError):
        sinks.read_published(spark, root, "none")


@pytest.mark.parametrize("left_out", ["scopelens/llm", "corpus_pipeline.py", "both"])
def test_the_entry_works_without_optional_parts(tmp_path, left_out):
    copy = tmp_path / "copy"
    gone = {"both": ["llm", "corpus_pipeline.py"]}.get(left_out, [Path(left_out).name])
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    from harness.queries import QUERIES

    count, operators, pipeline = out.stdout.split()
    assert int(count) >= len(QUERIES) and pipeline == "False"
    assert (operators == "0") == (left_out != "corpus_pipeline.py")
