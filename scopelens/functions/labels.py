"""Label expressions: comparing, rewriting and composing the texts reports are grouped by.

Text comparison ignores case and blanks at the end and keeps accents, as a SQL server's usual collation
does. It is done on a folded form, which hashes and aggregates as plain text; collated columns would carry
their collation into every result.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from scopelens.vocabulary import NUMBER_ERROR

# A run of cased characters or a run of anything else, so that what follows a digit, quote, slash
# or uncased letter starts a new word. initcap starts one only after white space.
WORD_RUNS = r"([\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}]+|[^\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}]+)"


def fold(text: Column) -> Column:
    """The form two labels share when they differ in case, or in blanks at their end, only."""
    return F.lower(F.rtrim(text))


def same_text(text: Column, value: str) -> Column:
    return fold(text) == fold(F.lit(value))


def text_in(text: Column, values: Iterable[str]) -> Column:
    return fold(text).isin([fold(F.lit(value)) for value in values])


def title_case(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(WORD_RUNS), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


def shown_label(text: Column) -> Column:
    """Title case, equal for all labels that compare equal."""
    return title_case(F.rtrim(text))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


LABEL_STYLES = {"title": title_case, "capitalize": capitalize}


def strip_brackets(text: Column) -> Column:
    return F.translate(text, "[]", "")


def reason_label(group: Column, reason: Column, folds: Iterable[tuple[str, str]]) -> Column:
    """The reason, but one label for all cases of a folded group."""
    return _chain([(same_text(group, name), F.lit(label)) for name, label in folds], reason)


def default_label(text: Column, default: str) -> Column:
    return F.coalesce(text, F.lit(default))


def brand_label(brand: Column, catch_all: str, shown: str) -> Column:
    return _chain([(same_text(brand, catch_all), F.lit(shown))], brand)


def line_variant_label(line: Column, variant: Column, regular: str, default: str) -> Column:
    """Product line and variant in one label; of the regular line only the variant is shown."""
    return (
        F.when(line.isNull() & variant.isNull(), F.lit(default))
        .when(same_text(line, regular), variant)
        .when(line.isNotNull() & variant.isNotNull(), F.concat(line, F.lit("-"), variant))
        .otherwise(F.coalesce(line, variant))
    )


def type_reason_label(case_type: Column, reason: Column) -> Column:
    """NULL if either part is."""
    return F.lower(F.concat(case_type, F.lit(" - "), reason))


def label_prefix(label: Column, separator: str = " - ") -> Column:
    return F.split_part(label, F.lit(separator), F.lit(1))


def map_folded(text: Column, pairs: Mapping[str, object]) -> Column:
    """Lookup of a label in a small literal mapping of labels; NULL for others."""
    return _chain([(same_text(text, k), F.lit(v)) for k, v in pairs.items()], F.lit(None))


def map_value(key: Column, pairs: Mapping[str, object], default: object | None = None) -> Column:
    """Lookup in a small literal mapping."""
    return _chain([(key == F.lit(k), F.lit(v)) for k, v in pairs.items()], F.lit(default))


def coerce_number(text: Column, error: str = NUMBER_ERROR) -> Column:
    """Text as a number; NULL for the error mark and for anything else that is no number."""
    return F.nullif(text, F.lit(error)).try_cast("double")


def series_label(name: Column, total: Column) -> Column:
    return F.concat(name, F.lit(" = "), total.cast("string"))


def _chain(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    if not branches:
        return otherwise
    (condition, value), *more = branches
    chain = F.when(condition, value)
    for condition, value in more:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)
