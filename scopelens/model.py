"""Names shared by every module: the case table's columns and the report parameters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import types as T

MONTH = "month"
CASE_TYPE = "case_type"
CASE_GROUP = "case_group"
REASON = "reason"
BRAND = "brand"
SUBCAT1 = "subcat1"
SUBCAT2 = "subcat2"
LINE = "line"
VARIANT = "variant"

# Optional: the day or moment the case arrived, within ``month``. Where a table has it, month filters
# bound it too, because Catalyst can push a bound on a plain column to the scan but not one on
# trunc(date).
EVENT_DATE = "event_date"

TOTAL = "total"
SCOPE_ID = "scope_id"

# Which months of a pack a count is for: all of its range, or its first or last month alone.
MONTHS = "months"
RANGE, FIRST, LAST = "range", "first", "last"

CASE_SCHEMA = T.StructType(
    [T.StructField(MONTH, T.DateType(), False)]
    + [
        T.StructField(name, T.StringType(), True)
        for name in (CASE_TYPE, CASE_GROUP, REASON, BRAND, SUBCAT1, SUBCAT2, LINE, VARIANT)
    ]
)


def first_of_month(value: str | date) -> date:
    """``'2024-02'`` or any date of that month, as the first day of the month."""
    if isinstance(value, str):
        value = datetime.strptime(value, "%Y-%m").date()
    return date(value.year, value.month, 1)


@dataclass(frozen=True)
class Period:
    """An inclusive range of months."""

    start: date
    end: date

    @classmethod
    def of(cls, start: str | date, end: str | date) -> Period:
        return cls(first_of_month(start), first_of_month(end))

    @classmethod
    def month(cls, month: str | date) -> Period:
        return cls.of(month, month)


@dataclass(frozen=True)
class ReportParams:
    """What a user fills in to ask for one report pack.

    The channel range is its own; left out, the channel report covers every month. Half a range
    counts as none.
    """

    scope: int
    traditional_scope: int
    digital_scope: int
    start: str
    end: str
    channel_start: str | None = None
    channel_end: str | None = None
    top: int = 10

    @property
    def period(self) -> Period:
        return Period.of(self.start, self.end)

    @property
    def months(self) -> dict[str, Period]:
        return {RANGE: self.period, FIRST: Period.month(self.start), LAST: Period.month(self.end)}

    @property
    def channel_period(self) -> Period | None:
        return optional_period(self.channel_start, self.channel_end)


def optional_period(start: str | date | None, end: str | date | None) -> Period | None:
    return Period.of(start, end) if start and end else None
