"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections import defaultdict
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: The tables that each application has written and not removed yet.
_written: dict[str, list[str]] = defaultdict(list)


@cache
def _own_folder() -> str:
    own = tempfile.mkdtemp(prefix="refloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names. A session on one machine that names none gets a temporary one, which goes with the process; any other one has to name it."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return f"file://{_own_folder()}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The frame, written and read again: what comes after has a short plan and sees the same rows whatever executor is lost."""
    spark = rows.sparkSession
    path = shared_path(spark, name)
    rows.write.parquet(path)
    _written[spark.sparkContext.applicationId].append(path)
    return spark.read.schema(rows.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    return list(_written[spark.sparkContext.applicationId])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that `stored` wrote; frames that read them can't be used any more."""
    ours = _written[spark.sparkContext.applicationId]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in set(paths) & set(ours):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        ours.remove(path)
