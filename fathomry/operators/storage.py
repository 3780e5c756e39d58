"""The folder that executors share, and tables built once a session and read again by many queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folder of each table that this process has built: (application, name) to path.
_BUILT: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may leave it unset and gets a folder of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def built(spark: SparkSession, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The table `name`: what `build` gives, written once a session and read from then on."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/built-{uuid.uuid4().hex}"
        build().write.partitionBy(*partition_by).parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def forget(spark: SparkSession) -> None:
    """Lets all tables be built again, as after a change of what they were built from."""
    for key in [k for k in _BUILT if k[0] == spark.sparkContext.applicationId]:
        del _BUILT[key]
