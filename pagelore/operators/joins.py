"""Joins of a large side with hot keys to a side with unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.session import materialize

# A key with at least this many rows is spread over several tasks.
HOT_ROWS = 1_000_000
# Only so many of the hottest keys are marked. Any other key then has less than one row in
# so many of the whole side, which is no more than an even share of a large job's tasks.
MARKED_KEYS = 100_000


def hot_keys(left: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, marked_keys: int = MARKED_KEYS) -> DataFrame:
    """Stored rows (_hot_key, _salts): values that the columns ``keys`` together hold ``hot_rows`` times or more.

    One partially aggregated count serves all columns.
    """
    listed = left.select(F.explode(F.array(*keys)).alias("_key")) if len(keys) > 1 else left.select(F.col(keys[0]).alias("_key"))
    counts = listed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_rows)
    return materialize(
        counts.orderBy(F.desc("n"), "_key").limit(marked_keys)
        .select(F.col("_key").alias("_hot_key"), F.ceil(F.col("n") * 4 / hot_rows).cast("int").alias("_salts")),
        "hot-keys",
    )


def join_unique(
    left: DataFrame,
    unique: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    marked_keys: int = MARKED_KEYS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to a table that holds every ``key`` once.

    Hot keys are found by a partially aggregated count. Each is spread by a hash of
    ``spread_by`` over as many join keys as its own count asks for, four for every
    ``hot_rows`` rows; only its single row on the other side is repeated. The marks are
    a table of one narrow row per hot key, bounded by ``marked_keys``; ``hot`` gives it
    where one count serves several joins.
    """
    if hot is None:
        hot = hot_keys(left, [key], hot_rows, marked_keys)
    if hot.isEmpty():
        return left.join(unique, key, how)
    marks = F.broadcast(hot)
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread_by), F.col("_salts"))).otherwise(F.lit(0))
    salted = left.join(marks, left[key] == F.col("_hot_key"), "left").withColumn("_salt", salt.cast("int")).drop("_salts", "_hot_key")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = unique.join(marks, unique[key] == F.col("_hot_key"), "left").withColumn("_salt", F.explode(copies)).drop("_salts", "_hot_key")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
