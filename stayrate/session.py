"""Session helpers: builder for local runs, scratch folder shared by all executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "stayrate") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STAYRATE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session with nothing named gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named is None and current is not None:
        return os.path.dirname(current.rstrip("/"))
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="stayrate-")
    if current is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def named_path(spark: SparkSession, name: str) -> str:
    """A path of this name in this application's part of the shared folder, removed when the application ends."""
    root = f"{shared_folder(spark).rstrip('/')}/stayrate-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{root}/{name}"


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path there."""
    return named_path(spark, f"{purpose}-{uuid.uuid4().hex}")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stamp(spark: SparkSession, folder: str, *parts: object) -> str:
    """Digest of the names, sizes and times of all files below a folder, and of the parts."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while files.hasNext():
        file = files.next()
        found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return hashlib.md5("\n".join([*sorted(found), *map(str, parts)]).encode()).hexdigest()


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: ends the lineage, survives executor loss, stays columnar."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
