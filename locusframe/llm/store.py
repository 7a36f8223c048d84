"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset, as in tests, a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="locusframe-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/locusframe/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later step reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def sweep(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Deletes all tables that this application has written here but those named in keep (by the start of their name). Only for steps
    whose input is a table of its own and whose predecessors' results have been written elsewhere."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path.rsplit("/", 1)[1].startswith(keep or ("\0",)):
            _made.setdefault(spark.sparkContext.applicationId, []).append(path)
        else:
            drop(spark, path)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: computed once, and read again by whatever follows, also after an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
