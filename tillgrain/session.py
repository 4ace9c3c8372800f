"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_marked: set[str] = set()
#: shuffled bytes that one task reads, where partitions are joined at run time
SHARE = "16MB"


def build_session(app: str = "tillgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and a fixed time zone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # call-site capture makes every column expression several times slower to build
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Runtime settings every analysis relies on, for sessions made elsewhere.

    A hot join key is split even where that costs one more shuffle behind the join:
    without it an aggregation on the join key would keep the hot key in one task.

    Rows of numbers take some 25 times their shuffled bytes in the sorts and hash tables of a
    task, so a task is given ``SHARE`` of them, unless the session says otherwise.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHARE)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tillgrain-")
    return _local_scratch[app]


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables, removed when its driver ends."""
    root = f"{shared_folder(spark)}/tillgrain-{spark.sparkContext.applicationId}"
    if root not in _marked:
        path, files = hadoop_path(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(root)
    return root


def hadoop_path(spark: SparkSession, location: str):
    """A location and the file system it lies on, whatever its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Intermediate tables with a life span.

    ``write`` stores a frame and reads it back; ``drop`` removes tables that nothing reads any
    more. As a context manager it removes all of its tables at the end, for callers that have
    stored their result by then. What is left goes with the application.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def folder(self) -> str:
        """A new folder name under the shared folder."""
        return f"{scratch_root(self.spark)}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        path = self.folder()
        df.write.options(**options).parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(stored)] = (stored, path)
        return stored

    def drop(self, *stored: DataFrame) -> None:
        for frame in stored:
            _, location = self._paths.pop(id(frame))
            path, files = hadoop_path(self.spark, location)
            files.delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[frame for frame, _ in self._paths.values()])


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back; the table lives as long as the application.

    Used where several later steps read the same aggregate. The table cuts the lineage,
    outlives lost executors, is read column by column, and shows Spark its true size, so
    that a join against it is broadcast only below ``autoBroadcastJoinThreshold``.
    """
    return Scratch(df.sparkSession).write(df)
