"""The point table: id, vector and payload of every embedded chunk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions.ids import point_id
from pagelore.operators.embedding import require_fields
from pagelore.operators.first_wins import first_per_key
from pagelore.schemas import PAYLOAD_NUMBER_FIELDS, PAYLOAD_TEXT_FIELDS
from pagelore.session import Scratch, list_names, path_exists, remove_path

DISTANCE = "cosine"


def build_points(embedded: DataFrame, dimension: int | None = None) -> DataFrame:
    """Embedded chunks as points; absent payload fields get their defaults.

    Fails on a row without chunk id, hash, text or a vector of ``dimension``.
    """
    checked = require_fields(embedded, ("chunk_id", "chunk_hash", "text"))
    vector = F.col("embedding")
    if dimension is not None:
        wrong = F.raise_error(F.lit(f"an embedding does not have {dimension} dimensions"))
        vector = F.when(F.coalesce(F.size("embedding"), F.lit(-1)) == dimension, vector).otherwise(wrong)
    have = set(checked.columns)

    def field(name: str, default, kind: str):
        if name not in have:
            return F.lit(default).cast(kind).alias(name)
        return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)).alias(name)

    texts = [
        field(n, "general" if n == "page_type" else "", "string") for n in PAYLOAD_TEXT_FIELDS
    ]
    numbers = [field(n, 0, "int") for n in PAYLOAD_NUMBER_FIELDS]
    return checked.select(
        point_id(F.col("chunk_id"), F.col("chunk_hash")).alias("id"),
        vector.alias("vector"),
        *texts,
        *numbers,
        field("embedding_model", "", "string"),
        field("embedding_version", "", "string"),
    )


def latest_points(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert: a new point replaces an old one of the same id, the last new one wins.

    ``order`` names a column of ``new`` that tells later rows from earlier ones. Without
    it, and among rows of one place, the greatest hash of the whole row wins, so that a
    rerun gives the same result.
    """
    place = F.col(order).cast("long") if order else F.lit(1).cast("long")
    shared = list(old.columns)
    both = old.withColumn("_seq", F.lit(None).cast("long")).unionByName(
        new.withColumn("_seq", place).select(*shared, "_seq")
    )
    # NULL sorts last in descending order: an old row loses against any new one.
    ranking = [F.col("_seq").desc_nulls_last(), F.xxhash64(*shared).desc()]
    return first_per_key(both, ["id"], ranking).drop("_seq")


def _each_id_once(given: DataFrame, columns: list[str], order: str | None) -> tuple[DataFrame, int]:
    """The last row of every id of stored rows, and the number of ids.

    Ids are counted first; whole rows are shuffled only where an id comes again.
    """
    ids = given.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    found = ids.agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if not found.repeated:
        return given.select(*columns), found.ids
    return latest_points(given.limit(0).select(*columns), given, order), found.ids


# How the stored table is laid out. Every write adds a folder of its own and then a note that
# lists the folders that make up the table, in order; readers take the latest finished note.
# What a note names is never changed, so a write that fails leaves the table as it was.
_NOTE = (
    "dimension int, distance string, "
    "parts array<struct<folder:string,kind:string,version:int,rows:long>>"
)
# Deltas are folded into a new base when their rows exceed this share of it, or their number this. A delta that
# large whose rows are all new becomes a base folder itself, and nothing stored is written again.
COMPACT_SHARE = 0.25
COMPACT_DELTAS = 32
# Rows of a file at most, however large the table is.
FILE_ROWS = 1_000_000


def _notes(spark, path: str) -> list[int]:
    done = (n for n in list_names(spark, f"{path}/_notes") if n.isdigit())
    return sorted(int(n) for n in done if path_exists(spark, f"{path}/_notes/{n}/_SUCCESS"))


def _write_note(spark, path: str, dimension: int, distance: str, parts: list) -> None:
    version = max(_notes(spark, path), default=0) + 1
    rows = spark.createDataFrame([(dimension, distance, [tuple(p) for p in parts])], _NOTE)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/_notes/{version}")


def table_description(spark, path: str):
    """The latest note: dimension, distance and the parts of the table."""
    versions = _notes(spark, path)
    if not versions:
        raise RuntimeError("the point table has no description")
    return spark.read.schema(_NOTE).json(f"{path}/_notes/{versions[-1]}").first()


def describe_table(spark, path: str, dimension: int, distance: str) -> None:
    """Note how the stored vectors are compared."""
    _write_note(spark, path, dimension, distance, table_description(spark, path).parts)


def check_table(spark, path: str, dimension: int, distance: str = DISTANCE) -> None:
    """Raise unless the stored table holds vectors of this size for this distance."""
    found = table_description(spark, path)
    if found.dimension != dimension:
        raise RuntimeError(f"table dimension mismatch: {found.dimension} != {dimension}")
    if found.distance != distance:
        raise RuntimeError(f"table distance mismatch: {found.distance} != {distance}")


def _store(points: DataFrame, path: str) -> tuple[str, int]:
    """Write rows into a folder of their own: pages clustered in files, files of bounded size.

    The number of files follows the data: partitions are merged and split to the
    session's advisory size, and a file never holds more than ``FILE_ROWS`` rows.
    """
    folder = f"data-{uuid.uuid4().hex}"
    arranged = points.hint("rebalance", "url").sortWithinPartitions("url", "id")
    arranged.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/{folder}")
    return folder, points.sparkSession.read.parquet(f"{path}/{folder}").count()


def write_points(points: DataFrame, path: str, dimension: int) -> None:
    """(Re)build the table. The old one stays readable until the new one is complete."""
    folder, rows = _store(points, path)
    _write_note(points.sparkSession, path, dimension, DISTANCE, [(folder, "base", 0, rows)])


def read_points(spark, path: str) -> DataFrame:
    """The points of the table: the latest row of every id, less those of replaced documents.

    Base rows are read as they are; only ids and document ids of the deltas, which are
    small next to the base, are compared with them.
    """
    return _read_parts(spark, path, table_description(spark, path).parts)


def _read_parts(spark, path: str, parts: list) -> DataFrame:
    schema = spark.read.parquet(f"{path}/{parts[0].folder}").schema

    def read(kind: str) -> DataFrame | None:
        out = None
        for p in parts:
            if p.kind == kind:
                rows = spark.read.parquet(f"{path}/{p.folder}").withColumn("_version", F.lit(p.version))
                out = rows if out is None else out.unionByName(rows)
        return out

    points = spark.read.schema(schema).parquet(*[f"{path}/{p.folder}" for p in parts if p.kind == "base"])
    deltas, replaced = read("delta"), read("replaced")
    if replaced is not None:
        replaced = replaced.groupBy("document_id").agg(F.max("_version").alias("_replaced"))
        points = points.join(replaced, "document_id", "left_anti")
    if deltas is not None:
        latest = first_per_key(deltas, ["id"], [F.col("_version").desc()])
        if replaced is not None:
            latest = latest.join(replaced, "document_id", "left").filter(
                F.coalesce(F.col("_replaced") <= F.col("_version"), F.lit(True))
            )
        points = points.join(deltas.select("id").distinct(), "id", "left_anti").unionByName(latest.select(*schema.names))
    return points.select(*schema.names)


def upsert_points(
    new: DataFrame, path: str, order: str | None = None, replace_documents: bool = False, replaced: DataFrame | None = None
) -> None:
    """Add points to a stored table without touching what is stored; the last of an id wins.

    With ``replace_documents`` all stored points of the documents in ``new`` go, so no
    passage of an older version of a page can be found any more; ``replaced`` (document_id)
    names such documents outright, also those that have no new points. A repeated batch
    changes nothing that a reader sees.
    """
    with Scratch(new.sparkSession, "new-points") as scratch:
        given = scratch.keep(new)
        if replace_documents and replaced is None:
            replaced = given.select("document_id").distinct()
        upsert_stored(given, path, order, replaced)


def upsert_stored(given: DataFrame, path: str, order: str | None = None, replaced: DataFrame | None = None) -> None:
    """``upsert_points`` of rows that are stored already, which are therefore not copied first."""
    spark = given.sparkSession
    note = table_description(spark, path)
    if given.isEmpty() and (replaced is None or replaced.isEmpty()):
        return
    schema = spark.read.parquet(f"{path}/{note.parts[0].folder}").columns
    version = 1 + max(p.version for p in note.parts)
    parts = [tuple(p) for p in note.parts]
    if replaced is not None:
        folder = f"replaced-{uuid.uuid4().hex}"
        replaced.select("document_id").write.parquet(f"{path}/{folder}")
        parts.append((folder, "replaced", version, 0))
    folder, rows = _store(_each_id_once(given, schema, order)[0], path)
    parts.append((folder, "delta", version, rows))
    base = sum(p[3] for p in parts if p[1] == "base")
    if rows > COMPACT_SHARE * base and _all_new(spark, path, note.parts, parts[len(note.parts):]):
        # Readers see the same rows; each such folder makes the base larger by that share, so they stay few.
        parts = [*(tuple(p) for p in note.parts), (folder, "base", 0, rows)]
        _write_note(spark, path, note.dimension, note.distance, parts)
        return
    _write_note(spark, path, note.dimension, note.distance, parts)
    deltas = [p for p in parts if p[1] == "delta"]
    if len(deltas) > COMPACT_DELTAS or sum(p[3] for p in deltas) > COMPACT_SHARE * base:
        write_points(read_points(spark, path), path, note.dimension)


def _all_new(spark, path: str, before: list, added: list[tuple]) -> bool:
    """Whether no stored row has an id or a replaced document of the ``added`` parts. Only ids are compared.

    Deltas before them would have to give way to the new base, so there must be none.
    """
    if any(p.kind != "base" for p in before):
        return False
    stored = _read_parts(spark, path, before)
    columns = {"replaced": "document_id", "delta": "id"}
    return all(
        stored.join(spark.read.parquet(f"{path}/{folder}").select(columns[kind]), columns[kind], "left_semi").isEmpty()
        for folder, kind, _, _ in added
    )


def drop_old_versions(spark, path: str) -> None:
    """Delete the folders and notes that the latest note does not need. No reader may be at work on them."""
    wanted = {p.folder for p in table_description(spark, path).parts}
    for name in list_names(spark, path):
        if name.startswith(("data-", "replaced-")) and name not in wanted:
            remove_path(spark, f"{path}/{name}")
    for version in _notes(spark, path)[:-1]:
        remove_path(spark, f"{path}/_notes/{version}")


def index_points(
    points: DataFrame,
    path: str,
    dimension: int,
    rebuild: bool = True,
    order: str | None = None,
    replace_documents: bool = False,
) -> DataFrame:
    """Store points, from scratch or merged into what is there, and verify the table."""
    spark = points.sparkSession
    if not rebuild:
        check_table(spark, path, dimension)
        upsert_points(points, path, order, replace_documents)
        return verify_points(spark, path, dimension)
    with Scratch(spark, "points") as scratch:
        stored = scratch.keep(points)
        plain = [c for c in stored.columns if c != order]
        once, expected = _each_id_once(stored, plain, order)
        write_points(once, path, dimension)
    return verify_points(spark, path, dimension, expected)


def verify_points(spark, path: str, dimension: int, expected: int | None = None) -> DataFrame:
    """One status row; raises if the table is not what was to be stored."""
    status = (
        read_points(spark, path)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != dimension).alias("wrong_size"),
        )
    )
    found = status.first()
    if expected is not None and found.points != expected:
        raise RuntimeError(f"point count {found.points} does not match {expected}")
    if not found.points:
        raise RuntimeError("the table contains no readable points")
    if found.wrong_size:
        raise RuntimeError(f"stored vectors do not have {dimension} dimensions")
    return status


def health(spark, path: str) -> DataFrame:
    """One row ``status, error, points``: healthy where the table can be read.

    ``not_ready`` where no table has been written yet.
    """
    schema = "status string, error string, points long"
    try:
        if not _notes(spark, path):
            return spark.createDataFrame([("not_ready", "no point table", None)], schema)
        count = read_points(spark, path).count()
    except Exception as exc:  # any failure to read means unhealthy
        return spark.createDataFrame([("unhealthy", f"{type(exc).__name__}", None)], schema)
    return spark.createDataFrame([("healthy", None, count)], schema)


def readiness(state: DataFrame) -> DataFrame:
    """``health`` rows with the ``status_code`` a request would get: 200 where the table is healthy, else 503 and why."""
    healthy = F.col("status") == "healthy"
    reason = F.coalesce(F.col("error"), F.lit("the point table cannot be read"))
    return state.select(
        F.when(healthy, F.lit(200)).otherwise(F.lit(503)).alias("status_code"),
        "status",
        F.when(~healthy, reason).alias("detail"),
        "points",
    )
