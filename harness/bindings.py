"""The driver's tables as cases, scopes and catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scopelens.functions.months import month_start
from scopelens.model import ReportParams
from scopelens.sources.scopes import ScopeRegistry
from scopelens.vocabulary import Taxonomy

TAXONOMY = Taxonomy(
    complaint="1-URGENT",
    social="5-LOW",
    mention_groups=("R",),
    mentions_label="MENTIONS",
    others_label="OTHER INTERACTIONS",
    unknown_label="NO GROUP",
    type_order=("3-MEDIUM", "1-URGENT", "2-HIGH", "MENTIONS", "OTHER INTERACTIONS"),
    folded_reasons=(),
    complaint_remainder="remainder",
    other_remainder="remainder",
    catch_all_brand="Brand#1",
    catch_all_label="Unidentified",
    default_subcat1="general",
    default_subcat2="GENERAL",
    regular_line="STANDARD",
    default_line="GENERAL",
)
FOLDS = (("R", "Returned"), ("A", "Accepted"))

START, END = "1996-01", "1996-12"
CHANNEL_START, CHANNEL_END = "1995-06", "1999-12"
PARAMS = ReportParams(1000, 9106, 8106, START, END, CHANNEL_START, CHANNEL_END)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per line item.

    Lines and orders are large on both sides and join by a shuffle, which adaptive execution splits
    where one order is hot. No broadcast hints: parts are broadcast if their size allows it.
    """
    lines = table(spark, sf_dir, "lineitem").withColumn("event_date", F.col("l_shipdate"))
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    product_type = F.nullif("p_type", F.lit("PROMO"))
    return joined.select(
        month_start(F.col("event_date")).alias("month"),
        "event_date",
        F.when(F.col("l_linestatus") == "O", "digital").otherwise("traditional").alias("channel"),
        F.col("o_orderpriority").alias("case_type"),
        F.nullif("l_returnflag", F.lit("N")).alias("case_group"),
        F.col("p_name").alias("reason"),
        F.nullif("p_brand", F.lit("Brand#13")).alias("brand"),
        product_type.alias("subcat1"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).alias("subcat2"),
        product_type.alias("line"),
        F.nullif(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("hot")).alias("variant"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope names, one per brand of the part table."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    number = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    name = F.concat(F.lit("["), F.upper("p_brand"), F.lit("] cases/"), F.lower("p_brand"))
    return brands.select(number.alias("scope_id"), name.alias("name"))


def registry() -> ScopeRegistry:
    # Months are bounded by the event date, which is the form that reaches the scan.
    return (
        ScopeRegistry()
        .add(1000)
        .add(8006, "channel = 'digital'", parent=1000)
        .add(9006, "channel = 'traditional'", parent=1000)
        .add(8106, "event_date < DATE'1999-01-01'", parent=8006)
        .add(9106, "event_date >= DATE'1997-01-01'", parent=9006)
    )


def many_scopes(count: int, declared: bool = True) -> tuple[ScopeRegistry, list[int]]:
    """A registry of ``count`` overlapping scopes: a channel, or a run of years within one."""
    scopes = ScopeRegistry(("channel", "month") if declared else ())
    scopes.add(1000).add(8006, "channel = 'digital'", parent=1000).add(9006, "channel = 'traditional'", parent=1000)
    for at in range(count - 3):
        first = 1995 + at // 2 % 7
        condition = f"month >= DATE'{first}-01-01' AND month < DATE'{first + 1 + at // 14}-01-01'"
        scopes.add(20000 + at, condition, parent=(8006, 9006)[at % 2])
    return scopes, scopes.ids()[:count]


def monthly_registry() -> ScopeRegistry:
    """The scopes of ``registry`` by channel and month alone, as counts kept by month need them."""
    return (
        ScopeRegistry(("channel", "month"))
        .add(1000)
        .add(8006, "channel = 'digital'", parent=1000)
        .add(9006, "channel = 'traditional'", parent=1000)
        .add(8106, "month < DATE'1999-01-01'", parent=8006)
        .add(9106, "month >= DATE'1997-01-01'", parent=9006)
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope for each part, four below each other one; some narrow themselves, some name an unknown parent."""
    number = F.col("p_partkey").cast("long")
    above = F.when(number % 97 == 0, number).when(number % 101 == 0, F.lit(-1)).when(number >= 4, F.floor(number / 4))
    return table(spark, sf_dir, "part").select(
        number.alias("scope_id"), above.cast("long").alias("parent_id"), F.concat(F.lit("["), F.upper("p_name"), F.lit("]")).alias("name")
    )
