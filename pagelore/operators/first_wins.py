"""Order-dependent deduplication and group reports that tolerate hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.operators.joins import HOT_ROWS, join_unique


def first_per_key(df: DataFrame, keys: list[Column | str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key in the given order.

    The filter on the row number is pushed below the shuffle as a group limit, so
    each task forwards at most ``n`` rows of a key however often that key occurs.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def repeated_groups(df: DataFrame, key: str, member: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every member of every key that occurs more than once, with the group size.

    One row per member, so no group is ever gathered in one place.
    """
    members = df.select(F.col(key).alias("key"), F.col(member).alias("member"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return join_unique(members, sizes, "key", "member", hot_rows=hot_rows)
