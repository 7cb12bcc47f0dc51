"""Session settings, the shared folder for intermediate tables, and versioned tables on it."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
WAREHOUSE_KEY = "spark.sql.warehouse.dir"

_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def build_session(master: str | None = None, name: str = "faultline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names, or below its warehouse where it names none."""
    root = _scratch.get() or spark.conf.get(CHECKPOINT_KEY, None) or f"{spark.conf.get(WAREHOUSE_KEY)}/scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Folder for the tables of one unit of work, removed when the work has written its results."""
    folder = shared_folder(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        fs, hadoop_path = _file_system(spark, folder)
        fs.delete(hadoop_path, True)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later stages start from the files."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def can_broadcast(written: DataFrame) -> bool:
    """Whether a written table lies within Spark's own broadcast threshold, by the bytes of its files."""
    spark = written.sparkSession
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= threshold


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Move a file, over another one if there is one."""
    fs, source_path = _file_system(spark, source)
    _, target_path = _file_system(spark, target)
    fs.mkdirs(target_path.getParent())
    fs.delete(target_path, False)
    if not fs.rename(source_path, target_path):
        raise OSError(f"cannot move {source} to {target}")


def files_in(spark: SparkSession, folder: str, ending: str) -> list[str]:
    fs, hadoop_path = _file_system(spark, folder)
    return sorted(p for p in (s.getPath().toString() for s in fs.listStatus(hadoop_path)) if p.endswith(ending))


def subfolders(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Folders of a folder whose names start with a prefix."""
    fs, hadoop_path = _file_system(spark, folder)
    if not fs.exists(hadoop_path):
        return []
    paths = [status.getPath() for status in fs.listStatus(hadoop_path) if status.isDirectory()]
    return sorted(path.toString() for path in paths if path.getName().startswith(prefix))


def delete_folder(spark: SparkSession, folder: str) -> None:
    fs, hadoop_path = _file_system(spark, folder)
    fs.delete(hadoop_path, True)


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table; a half-written one has no success marker."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return []
    found = []
    for status in fs.listStatus(hadoop_path):
        folder = status.getPath()
        name = folder.getName()
        if name.startswith("version=") and path_exists(spark, f"{folder.toString()}/_SUCCESS"):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def write_version(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write the next version; readers of the previous one, this frame included, are undisturbed."""
    versions = committed_versions(df.sparkSession, path)
    target = f"{path}/version={versions[-1] + 1 if versions else 1}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(target)
    return target


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    versions = committed_versions(spark, path)
    if not versions:
        return None
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def mark_complete(spark: SparkSession, folder: str) -> None:
    """Success marker of a version made of several tables."""
    fs, marker = _file_system(spark, f"{folder}/_SUCCESS")
    fs.create(marker, True).close()


def write_buckets(df: DataFrame, path: str, by: str, buckets: int, sort: tuple[str, ...] = ()) -> None:
    """Write a table in hash buckets of a column, a file each, rows in order; the catalogue keeps no entry."""
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by, *sort)
    writer.option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"drop table {name}")


def read_buckets(spark: SparkSession, path: str, layout: T.StructType, by: str, buckets: int) -> DataFrame:
    """A table of `write_buckets`: joins on its column leave it where it lies, a filter on it opens only its bucket."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout.fields)
    spark.sql(
        f"create table {name} ({columns}) using parquet clustered by (`{by}`) sorted by (`{by}`) "
        f"into {buckets} buckets location '{path}'"
    )
    found = spark.table(name)
    spark.sql(f"drop table {name}")
    return found
