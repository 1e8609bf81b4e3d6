"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
    # Recording a call site for every expression makes large plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app: str = "pagelore", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    A local session that names none gets a temporary one; a cluster has to name it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
    # One folder per local session; the user's own checkpoint setting is left alone.
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[key] = tempfile.mkdtemp(prefix="pagelore-")
    return _LOCAL_FOLDERS[key]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else writes to."""
    return f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning and
    filter pushdown for every later use.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored there. Any other trouble, such as a time-out, is raised."""
    files, place = _file_system(spark, path)
    return files.exists(place)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none where there is no such folder."""
    files, place = _file_system(spark, path)
    if not files.exists(place):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(place))


def remove_path(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


class Scratch:
    """Stored intermediate tables with an owner: they are deleted when the block ends.

    Results that outlive the block must have been written elsewhere by then.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.made = spark, new_folder(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove_path(self.spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A table written round by round and read as one scan, however many rounds there are."""

    def __init__(self, spark: SparkSession, name: str, number: str = "round") -> None:
        self.spark, self.number = spark, number
        self.path = new_folder(spark, name)
        self.schema: T.StructType | None = None

    def write(self, df: DataFrame, number: int) -> DataFrame:
        """Store the rows of one round; the result carries the round as a column."""
        path = f"{self.path}/{self.number}={number}"
        df.write.parquet(path)
        self.schema = T.StructType([*df.schema.fields, T.StructField(self.number, T.IntegerType())])
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core work where the input has fewer splits than there are cores.

    A large input has many splits and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
