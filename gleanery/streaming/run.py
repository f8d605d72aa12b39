"""Run a stream over what is there now and read its result as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gleanery import schemas as S
from gleanery.session import scratch_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a count of all rows costs a look-up with every write
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # sessions of a task are merged before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64, files: str = "events*.parquet") -> DataFrame:
    """The event table as an unbounded file source."""
    source = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    return source.option("pathGlobFilter", files).parquet(folder)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keep state in RocksDB for the queries started inside.

    State with several values or lists per key needs it, and it keeps large
    state off the heap.  A query copies the setting when it starts.
    """
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a written table and return it."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    with rocksdb_state(spark):
        writer = stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        query = writer.option("path", f"{root}/data").option("checkpointLocation", f"{root}/progress").start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def drain_to_end(source: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, end: tuple) -> DataFrame:
    """Process all input of a finite stream, then close what waits for later events.

    ``build`` makes the job from the source.  When all input has been read,
    ``end``, a row of the source with a key of its own and a time beyond every
    delay and gap, follows through a second folder; it carries the watermark
    past all windows and timers.  A restart goes on from the same progress.
    """
    spark = source.sparkSession
    root = scratch_path(spark, name)
    marks = f"{root}/marks"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    stream = build(source.unionByName(spark.readStream.schema(source.schema).parquet(marks)))

    def available() -> None:
        with rocksdb_state(spark):
            writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            writer.option("path", f"{root}/data").option("checkpointLocation", f"{root}/progress").start().awaitTermination()

    available()
    spark.createDataFrame([end], source.schema).coalesce(1).write.mode("append").parquet(marks)
    available()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def drain_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int, str], None]) -> str:
    """Process all available input through ``each(batch, number, root)``."""
    root = scratch_path(stream.sparkSession, name)
    writer = stream.writeStream.foreachBatch(lambda df, n: each(df, n, root)).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{root}/progress").start().awaitTermination()
    return root
