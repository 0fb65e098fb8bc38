"""Month expressions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, functions as F

from scopelens.model import EVENT_DATE, MONTH, Period
from scopelens.vocabulary import MONTH_NAMES


def parse_month(text: Column) -> Column:
    """``'yyyy-MM'`` text as the first day of the month; NULL where it is no month."""
    return F.try_to_date(text, "yyyy-MM")


def day_of(text: Column, formats: Sequence[str]) -> Column:
    """Text as a day, by the first of the formats it fits; NULL where it fits none.

    Blanks around it do not matter. A format without a day gives the first of the month.
    """
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_date(trimmed, fmt) for fmt in formats])


def month_start(moment: Column) -> Column:
    """The first day of the month of a date or timestamp."""
    return F.trunc(moment.cast("date"), "MM")


def month_label(
    month: Column,
    names: tuple[str, ...] = MONTH_NAMES,
    year_digits: int = 2,
    capitalized: bool = False,
) -> Column:
    """``fev/24``; with four year digits ``fev/2024``; capitalized ``Fev/24``."""
    shown = [name.capitalize() for name in names] if capitalized else list(names)
    name = F.element_at(F.array(*[F.lit(n) for n in shown]), F.month(month))
    return F.concat(name, F.lit("/"), F.date_format(month, "y" * year_digits))


def within(period: Period, columns: list[str]) -> Column:
    """True for the months of a period, ends included.

    ``month`` is always bounded, so that a table stored by month is pruned. Where the table keeps the
    moment of the case as well, that is bounded by the same days, the end excluded: it reaches the scan
    when ``month`` is computed from it, and holds for dates and timestamps alike.
    """
    months = F.col(MONTH).between(F.lit(period.start), F.lit(period.end))
    if EVENT_DATE not in columns:
        return months
    day = F.col(EVENT_DATE)
    return months & (day.isNull() | ((day >= F.lit(period.start)) & (day < F.lit(following(period.end)))))


def following(month: date) -> date:
    """The first day of the next month."""
    return date(month.year + month.month // 12, month.month % 12 + 1, 1)
