"""Attributes of report rows: colours by case type, and by the type in front of a label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from scopelens.functions.labels import label_prefix, map_value
from scopelens.model import CASE_TYPE
from scopelens.operators.rank import explicit_rank
from scopelens.vocabulary import DEFAULT_COLOUR, PORTUGUESE, PREFIX_COLOURS, TYPE_COLOURS, Taxonomy


def type_colours(
    report: DataFrame,
    label: str = CASE_TYPE,
    taxonomy: Taxonomy = PORTUGUESE,
    colours: Sequence[str] = TYPE_COLOURS,
    name: str = "colour",
) -> DataFrame:
    """The colour of each type present, by its place in the report order; NULL for types not in it."""
    place = explicit_rank(F.col(label), taxonomy.type_order)
    return report.withColumn(name, F.try_element_at(F.array(*[F.lit(colour) for colour in colours]), place.cast("int")))


def prefix_colours(
    report: DataFrame,
    label: str,
    colours: Mapping[str, str] = PREFIX_COLOURS,
    default: str = DEFAULT_COLOUR,
    name: str = "colour",
) -> DataFrame:
    """The colour of the type in front of a label, ignoring case, or the default."""
    known = {prefix.lower(): colour for prefix, colour in colours.items()}
    return report.withColumn(name, F.coalesce(map_value(F.lower(label_prefix(F.col(label))), known), F.lit(default)))
