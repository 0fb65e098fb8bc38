"""Writing reports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMATS = ("parquet", "csv", "json")


def write_report(report: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a long report table, one directory per sheet. An empty sheet has no directory."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    options = {"header": "true"} if fmt == "csv" else {}
    report.hint("rebalance", F.col("sheet")).write.partitionBy("sheet").mode(mode).format(fmt).options(
        **options
    ).save(path)


def manifest(report: DataFrame, sheets: Sequence[str], skipped_if_empty: Sequence[str] = ()) -> DataFrame:
    """Every sheet asked for, with its number of rows and whether it is written, empty or skipped."""
    counts = report.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows"))
    expected = report.sparkSession.createDataFrame([(s, s in skipped_if_empty) for s in sheets], "sheet string, optional boolean")
    rows = F.coalesce("rows", F.lit(0))
    state = F.when(rows > 0, "written").when(F.col("optional"), "skipped").otherwise("empty")
    return expected.join(counts, "sheet", "left").select("sheet", rows.alias("rows"), state.alias("state"))


PUBLISHED = "version string, published long, schema string"


def publish_report(report: DataFrame, root: str) -> str:
    """Writes a report as a new version and makes it the one that readers see.

    The rows go to a folder of their own. Only when they are complete is one row added to the list of
    published versions, in one file that is renamed into place; until then, and if anything fails, readers
    see the version before. Versions do not touch each other, so writers may overlap. Returns the version.
    """
    spark, version = report.sparkSession, uuid.uuid4().hex
    write_report(report, f"{root}/versions/{version}")
    row = [(version, time.time_ns(), report.schema.toDDL())]
    spark.createDataFrame(row, PUBLISHED).coalesce(1).write.mode("append").parquet(f"{root}/published")
    return version


def published_versions(spark: SparkSession, root: str) -> DataFrame:
    """Published versions; the newest has the greatest ``published``."""
    return spark.read.schema(PUBLISHED).parquet(f"{root}/published")


def read_published(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The newest published version of a report, or the one asked for; an error if there is none."""
    known = published_versions(spark, root)
    chosen = known if version is None else known.where(F.col("version") == version)
    newest = chosen.orderBy(F.desc("published"), "version").first()
    if newest is None:
        raise LookupError("no such version is published")
    return spark.read.schema(newest["schema"]).parquet(f"{root}/versions/{newest['version']}")
