"""The case table: reading it, and storing it so that reports read little of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scopelens.functions.months import day_of, month_start
from scopelens.model import CASE_SCHEMA, EVENT_DATE, MONTH, TOTAL


@dataclass(frozen=True)
class FileSource:
    """A table in files, one format and one or more paths."""

    path: str
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).options(**self.options).load(self.path)


@dataclass(frozen=True)
class TableSource:
    """A table of the session's catalog."""

    name: str

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


@dataclass(frozen=True)
class JdbcSource:
    """A table in a database, read in parallel by ranges of a date, timestamp or numeric column.

    Without a partition column Spark would read it through one connection, in one task, so there
    is none without.
    """

    url: str
    table: str
    partition_column: str
    lower: str
    upper: str
    partitions: int
    options: Mapping[str, str] = field(default_factory=dict)

    def settings(self) -> dict[str, str]:
        return {
            "fetchsize": "10000",
            **self.options,
            "url": self.url,
            "dbtable": self.table,
            "partitionColumn": self.partition_column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.partitions),
        }

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(**self.settings()).load()


#: How months and days are spelled where they are stored as text, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM", "dd/MM/yyyy", "MM/yyyy", "yyyyMMdd")
#: A moment that is no date, as ``bad_months`` shows it.
BAD_MONTH = "bad_month"


def read_cases(
    spark: SparkSession,
    source: FileSource | TableSource | JdbcSource,
    columns: Mapping[str, str] | None = None,
    formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """The case table under this library's column names.

    ``columns`` maps our names to the table's; others are kept for scope conditions. ``month`` and
    ``event_date``, if there is one, are dates or timestamps; ``month`` may be text in one of the ``formats``. It
    becomes the first day of its month, whatever day is stored; without an ``event_date`` the stored day is
    kept as one, so that month filters still reach the scan (of dates; a text has to be read first).

    A row whose month is a text that is no date is left out here, and is in ``bad_months``.
    """
    cases = _named(spark, source, columns)
    if dict(cases.dtypes)[MONTH] == "string":
        cases = cases.where(~_is_bad(cases, formats))
    cases = cases.withColumn(MONTH, _day(cases, formats))
    if EVENT_DATE not in cases.columns:
        cases = cases.withColumn(EVENT_DATE, F.col(MONTH))
    return cases.withColumn(MONTH, month_start(F.col(MONTH)))


def bad_months(
    spark: SparkSession,
    source: FileSource | TableSource | JdbcSource,
    columns: Mapping[str, str] | None = None,
    formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """The texts that ``read_cases`` cannot read as a month, with the number of their rows.

    Together with the cases read they are all rows of the table. A missing month is not bad: it is read as NULL.
    """
    cases = _named(spark, source, columns)
    bad = cases.where(_is_bad(cases, formats)).select(F.col(MONTH).cast("string").alias(BAD_MONTH))
    return bad.groupBy(BAD_MONTH).agg(F.count(F.lit(1)).alias(TOTAL))


def _named(spark: SparkSession, source: FileSource | TableSource | JdbcSource, columns: Mapping[str, str] | None) -> DataFrame:
    cases = source.load(spark).withColumnsRenamed({theirs: ours for ours, theirs in (columns or {}).items()})
    missing = [name for name in CASE_SCHEMA.names if name not in cases.columns]
    if missing:
        raise ValueError(f"case table lacks {', '.join(missing)}")
    kinds = dict(cases.dtypes)
    moments = ("date", "timestamp", "timestamp_ntz")
    for name, known in ((MONTH, (*moments, "string")), (EVENT_DATE, moments)):
        if kinds.get(name, "date") not in known:
            raise ValueError(f"{name} must be one of {', '.join(known)}, not {kinds[name]}")
    return cases


def _day(cases: DataFrame, formats: Sequence[str]) -> Column:
    return day_of(F.col(MONTH), formats) if dict(cases.dtypes)[MONTH] == "string" else F.col(MONTH)


def _is_bad(cases: DataFrame, formats: Sequence[str]) -> Column:
    return F.col(MONTH).isNotNull() & _day(cases, formats).isNull()


def write_cases(
    cases: DataFrame, path: str, mode: str = "errorifexists", sort_by: Sequence[str] = (), looked_up: Sequence[str] = ()
) -> None:
    """Stores cases by month, so that a month range becomes a choice of directories.

    The rebalance hint has AQE split a month that holds most of the cases into several tasks and
    join small ones into one, where a repartition by month would give each month one task.

    Rows of a month are sorted by ``sort_by``, the columns scopes are confined to, so that row groups hold few
    of their values and are skipped by their statistics. ``looked_up`` columns get bloom filters, by
    which row groups without a label are skipped however it is spread.
    """
    rows = cases.hint("rebalance", F.col(MONTH))
    if sort_by:
        rows = rows.sortWithinPartitions(MONTH, *sort_by)
    writer = rows.write.partitionBy(MONTH).mode(mode)
    for name in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)
