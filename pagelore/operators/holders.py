"""Which documents hold a passage, so that it passes on when the first of them is replaced.

The holder table has a point for every passage of every document; the point table has a passage
once, under its first holder: the document that came earliest, by the place of its URL
among those that came together. Both are tables of ``points.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.operators.points import read_points, upsert_stored, write_points
from pagelore.session import Scratch, path_exists

_ORDER = ("arrival", "canonical_url", "document_id", "chunk_index", "id")


def first_holders(rows: DataFrame) -> DataFrame:
    """(chunk_hash, document_id, id) of the first holder of every passage. Reads narrow columns only."""
    first = rows.groupBy("chunk_hash").agg(F.min(F.struct(*_ORDER)).alias("first"))
    return first.select("chunk_hash", "first.document_id", "first.id")


def _each_id_once(new: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of every id; only rows whose id comes again are compared as a whole."""
    ids = new.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    again = scratch.keep(ids.filter("n > 1").select("_id"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    repeated = new.join(again, same, "left_semi").dropDuplicates(["id"])
    return new.join(again, same, "left_anti").unionByName(repeated)


def _with_ids(rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose id is wanted, found by the ids that are not: those are few where most rows are."""
    rest = scratch.keep(rows.select("id").join(wanted, "id", "left_anti"))
    return rows.join(rest, "id", "left_anti")


def replace_documents(new: DataFrame, gone: DataFrame, points_path: str, dimension: int) -> None:
    """Put the points ``new`` in place of all points of the documents ``gone`` (document_id).

    ``new`` has every passage of the documents that came, also passages that other documents
    hold; a document in ``gone`` without new points disappears. A passage whose holder goes passes
    to the next one, one that another document already holds stays there. The holder table is
    written last, so a batch that is run again after a failure does the same.
    """
    spark, holders_path = new.sparkSession, f"{points_path}/_holders"
    with Scratch(spark, "holders") as scratch:
        if not path_exists(spark, f"{holders_path}/_notes"):
            fresh = scratch.keep(_each_id_once(new, scratch).withColumn("arrival", F.lit(0)))
            first = first_holders(fresh).select("id")
            write_points(_with_ids(fresh.drop("arrival"), first, scratch), points_path, dimension)
            write_points(fresh, holders_path, dimension)
            return
        before = read_points(spark, holders_path)
        arrival = before.agg(F.coalesce(F.max("arrival"), F.lit(-1))).first()[0] + 1
        fresh = scratch.keep(_each_id_once(new, scratch).withColumn("arrival", F.lit(arrival)))
        gone = scratch.keep(gone.select("document_id").unionByName(fresh.select("document_id")).distinct())
        narrow = ("chunk_hash", *_ORDER)
        lost = before.join(gone, "document_id", "left_semi").select("chunk_hash")
        touched = scratch.keep(lost.unionByName(fresh.select("chunk_hash")).distinct())
        held = scratch.keep(before.select(*narrow).join(touched, "chunk_hash", "left_semi"))
        stay = held.join(gone, "document_id", "left_anti").select(*narrow)
        # A first holder that was so before, and stays, is stored already.
        settled = first_holders(held).join(gone, "document_id", "left_anti").select("id")
        first = first_holders(stay.unionByName(fresh.select(*narrow))).join(settled, "id", "left_anti")
        first = scratch.keep(first.select("id"))
        # Ids of the holders that stay: whole rows of the holder table meet these alone.
        passed = scratch.keep(stay.select("id").join(first, "id", "left_semi"))
        handed_on = before.join(passed, "id", "left_semi")
        rows = scratch.keep(handed_on.unionByName(_with_ids(fresh, first, scratch).select(*before.columns)).drop("arrival"))
        upsert_stored(rows, points_path, replaced=gone)
        upsert_stored(fresh.select(*before.columns), holders_path, replaced=gone)
