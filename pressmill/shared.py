"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table, not by keeping blocks on executors: a lost
executor then costs a re-read, never a failed job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="pressmill-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_folder(spark).removeprefix("file://")
    for file in df.inputFiles():
        folder = file.rsplit("/", 1)[0]
        if root not in folder:
            raise ValueError(f"{folder} is not an intermediate table")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import pathlib
    import zipfile

    package = pathlib.Path(__file__).parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="pressmill-code-")) / "pressmill.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
