"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: Settings that change results or plan quality; cluster sizing stays with the submitter.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where a later aggregate then needs its own shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names the cluster's shared folder.  Only a local
    run, where it is unset, falls back to a fresh scratch folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(shared)
    return shared


_scratch: list[str] = []


def drop_path(path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = SparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def _file_system(path: str):
    jvm = SparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(SparkContext._active_spark_context._jsc.hadoopConfiguration()), p


def mark(path: str) -> None:
    """Put an empty file there, at once or not at all."""
    fs, p = _file_system(path)
    fs.create(p, True).close()


def names_in(path: str) -> list[str]:
    """Names in a folder of the shared file system; none if there is no such folder."""
    fs, p = _file_system(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _drop_scratch() -> None:
    try:
        while _scratch and SparkContext._jvm is not None:
            drop_path(_scratch.pop())
    except Exception:  # noqa: BLE001  the gateway may be gone, and nobody is left to tell
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, deleted when the driver ends."""
    if not _scratch:
        atexit.register(_drop_scratch)
    _scratch.append(os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}"))
    return _scratch[-1]


def ship_package() -> None:
    """Send the Python that runs in tasks along with the tasks.

    Functions and classes of this package are serialised whole, so executors
    need no copy of it.
    """
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__package__])
