from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scopelens.functions import labels, months
from scopelens.model import Period, first_of_month, optional_period
from tests.conftest import tuples


def one(spark, rows, schema, column):
    return [row[0] for row in spark.createDataFrame(rows, schema).select(column).collect()]


def text(spark, values, make):
    return one(spark, [(v,) for v in values], "x string", make(F.col("x")))


def test_title_case(spark):
    values = ["sabor/odor ALTERADO", "COMENTÁRIOS e menções", "a-b d'água x1y", "", None]
    expected = ["Sabor/Odor Alterado", "Comentários E Menções", "A-B D'Água X1Y", "", None]
    assert text(spark, values, labels.title_case) == expected


def test_title_case_is_python_title(spark):
    """Over texts of letters, digits, marks and signs, many at a time."""
    alphabet = "aAbBzZéÉçÇãÃñÑ019 -/'.,ºª中_\n"

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=20), min_size=50, max_size=200))
    def check(values):
        assert text(spark, values, labels.title_case) == [v.title() for v in values]

    check()


def test_capitalize(spark):
    values = ["RECLAMAÇÃO", "çA vA", "", None]
    assert text(spark, values, labels.capitalize) == ["Reclamação", "Ça va", "", None]


def test_strip_brackets(spark):
    assert text(spark, ["[a] b [c]", None], labels.strip_brackets) == ["a b c", None]


def test_coerce_number(spark):
    assert text(spark, ["12", "#NÚM!", "abc", None], labels.coerce_number) == [12.0, None, None, None]


def test_label_prefix(spark):
    assert text(spark, ["elogio - sabor - bom", "resto"], labels.label_prefix) == ["elogio", "resto"]


def test_line_variant(spark):
    rows = [(None, None), ("regular", "v"), ("REGULAR", None), ("l", "v"), ("l", None), (None, "v")]
    label = labels.line_variant_label(F.col("l"), F.col("v"), "regular", "default")
    assert one(spark, rows, "l string, v string", label) == ["default", "v", None, "l-v", "l", "v"]


def test_reason_label_folds_groups(spark):
    rows = [("Infestação", "bug"), ("INFESTAÇÃO", None), ("other", "r"), (None, "r")]
    label = labels.reason_label(F.col("g"), F.col("r"), [("INFESTAÇÃO", "Infestação")])
    assert one(spark, rows, "g string, r string", label) == ["Infestação", "Infestação", "r", "r"]


def test_type_reason_label(spark):
    rows = [("Elogio", "Sabor"), (None, "x"), ("Elogio", None)]
    label = labels.type_reason_label(F.col("t"), F.col("r"))
    assert one(spark, rows, "t string, r string", label) == ["elogio - sabor", None, None]


def test_brand_label(spark):
    make = lambda c: labels.brand_label(c, "EM GERAL", "Não identificada")
    assert text(spark, ["em geral", "b", None], make) == ["Não identificada", "b", None]


def test_month_label(spark):
    row = spark.range(1).select(
        months.month_label(F.lit(date(2024, 2, 1))),
        months.month_label(F.lit(date(2024, 12, 1)), year_digits=4, capitalized=True),
        months.month_label(F.lit(None).cast("date")),
    )
    assert tuples(row) == [("fev/24", "Dez/2024", None)]


def test_month_start_and_parse(spark):
    row = spark.sql("SELECT timestamp'2024-02-29 23:59:59' AS t, timestamp_ntz'2024-02-29 23:59:59' AS n, '2024-02' AS s")
    found = row.select(
        months.month_start(F.col("t")), months.month_start(F.col("n")), months.parse_month(F.col("s")),
        months.parse_month(F.lit("soon")),
    )
    assert tuples(found) == [(date(2024, 2, 1),) * 3 + (None,)]


@pytest.mark.parametrize("month, expected", [("2024-02", "2024-03"), ("2023-12", "2024-01"), ("2023-11", "2023-12")])
def test_following(month, expected):
    assert months.following(first_of_month(month)) == first_of_month(expected)


def test_periods():
    assert Period.month("2024-05") == Period(date(2024, 5, 1), date(2024, 5, 1))
    assert optional_period("2024-01", None) is None
    assert optional_period("2024-01", "2024-03") == Period(date(2024, 1, 1), date(2024, 3, 1))
    with pytest.raises(ValueError):
        Period.of("2024", "2024-02")
