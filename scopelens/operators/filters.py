"""Row filters. A NULL satisfies neither a comparison nor its opposite."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, functions as F

from scopelens.functions.labels import fold, same_text, text_in
from scopelens.functions.months import within
from scopelens.model import CASE_GROUP, CASE_TYPE, Period, optional_period


def in_period(cases: DataFrame, period: Period | None) -> DataFrame:
    return cases if period is None else cases.where(within(period, cases.columns))


def in_month_range(cases: DataFrame, start: str | date, end: str | date) -> DataFrame:
    return in_period(cases, Period.of(start, end))


def in_month(cases: DataFrame, month: str | date) -> DataFrame:
    return in_period(cases, Period.month(month))


def in_optional_range(cases: DataFrame, start: str | date | None = None, end: str | date | None = None) -> DataFrame:
    """The range applies only if both ends are given."""
    return in_period(cases, optional_period(start, end))


def type_is(cases: DataFrame, value: str, column: str = CASE_TYPE) -> DataFrame:
    return cases.where(same_text(F.col(column), value))


def type_is_not(cases: DataFrame, value: str, column: str = CASE_TYPE) -> DataFrame:
    return cases.where(~same_text(F.col(column), value))


def group_in(cases: DataFrame, values: Iterable[str], column: str = CASE_GROUP) -> DataFrame:
    return cases.where(text_in(F.col(column), values))


def group_not_in(cases: DataFrame, values: Iterable[str], column: str = CASE_GROUP) -> DataFrame:
    return cases.where(~text_in(F.col(column), values))


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def drop_group(counts: DataFrame, column: str, value: str) -> DataFrame:
    """Counted groups without the named one; the NULL group stays."""
    return counts.where(~fold(F.col(column)).eqNullSafe(fold(F.lit(value))))
