"""Event-time jobs on built-in streaming operators, and their batch twins.

``delay`` is the caller's: how far the input may be out of order.  A row later
than that is dropped, as nothing else bounds the state; windows still open at
the end of a finite input close with :func:`gleanery.streaming.run.drain_to_end`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.stores import latest_per_source
from gleanery.session import drop_path, mark, names_in
from gleanery.streaming.run import drain_batches

# Thread limits and the write-back interval.
MAX_POSTS = 50
FLUSH_SECONDS = 15


def stream_once(operations: DataFrame, delay: str) -> DataFrame:
    """Each operation takes effect once, however often it is replayed.

    ``operations``: ``op_id, ts, …``.  State is kept per id for ``delay`` past
    its time, so it stays bounded.
    """
    return operations.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["op_id"])


class VersionedIndex:
    """Latest record per key, as a base and the versions written since.

    ``versions/version=<n>`` holds the newest records of batch n,
    ``bases/upto=<n>`` those of all batches up to n, and an empty file
    ``current/<n>`` says that this base is whole.  The mark comes last, so a
    crash before it leaves the earlier base and its versions in force; all
    that it replaces goes only when the next one stands.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, every: int) -> None:
        self.spark, self.root, self.schema, self.every = spark, root, schema, every

    def _marks(self) -> list[int]:
        return sorted(int(n) for n in names_in(f"{self.root}/current"))

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in names_in(f"{self.root}/{folder}") if "=" in n)

    def add(self, batch: DataFrame, number: int) -> None:
        """Write a batch, again with the same effect, and compact after each ``every`` batches."""
        latest_per_source(batch).write.mode("overwrite").parquet(f"{self.root}/versions/version={number}")
        if number % self.every == self.every - 1 and number not in self._marks():
            self.compact(number)

    def compact(self, number: int) -> None:
        self.read(number).write.mode("overwrite").parquet(f"{self.root}/bases/upto={number}")
        before = self._marks()[-1:]
        mark(f"{self.root}/current/{number}")
        for old in before:
            for folder, name, last in (("bases", "upto", old - 1), ("versions", "version", old)):
                for n in self._numbers(folder):
                    if n <= last:
                        drop_path(f"{self.root}/{folder}/{name}={n}")
            for n in self._marks():
                if n < old:
                    drop_path(f"{self.root}/current/{n}")

    def read(self, upto: int | None = None) -> DataFrame:
        """The index after batch ``upto``, or now: one base and at most ``every`` versions are read."""
        marks = [n for n in self._marks() if upto is None or n <= upto]
        base = marks[-1] if marks else -1
        paths = [f"{self.root}/versions/version={n}" for n in self._numbers("versions") if n > base and (upto is None or n <= upto)]
        if marks:
            paths.append(f"{self.root}/bases/upto={base}")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return latest_per_source(self.spark.read.schema(self.schema).parquet(*paths))


def stream_saved_index(saves: DataFrame, name: str = "saved-index", every: int = 16) -> DataFrame:
    """Latest record per key, kept up to date batch by batch (:class:`VersionedIndex`)."""
    spark, schema = saves.sparkSession, saves.schema
    root = drain_batches(saves, name, lambda batch, number, root: VersionedIndex(spark, root, schema, every).add(batch, number))
    return VersionedIndex(spark, root, schema, every).read()


def thread_sessions(events: DataFrame, gap: str, max_posts: int = MAX_POSTS, max_time: int | None = None) -> DataFrame:
    """Collections per key that close after an idle gap; capped ones are partial.

    ``events``: ``key, ts``.  The same expression serves batch and stream.
    """
    window = F.session_window("ts", gap)
    grouped = events.groupBy("key", window).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    limit = F.col("n") > max_posts
    timeout = F.lit(False) if max_time is None else F.unix_micros("last_ts") - F.unix_micros("first_ts") >= max_time * 1_000_000
    return grouped.select(
        "key", F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "n",
        limit.alias("limit"), timeout.alias("timeout"), (limit | timeout).alias("partial"),
    )


def stream_threads(events: DataFrame, gap: str, delay: str, **limits: int) -> DataFrame:
    return thread_sessions(events.withWatermark("ts", delay), gap, **limits)


def flush_batches(units: DataFrame, seconds: int = FLUSH_SECONDS) -> DataFrame:
    """Finished units per key and write-back interval (``key, ts``).

    Windows are aligned to the clock; the interval of a live job starts at its
    first finished unit.
    """
    grouped = units.groupBy("key", F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("units"), F.max("ts").alias("last_ts"))
    return grouped.select("key", F.col("window.start").alias("opened"), "units", "last_ts")


def stream_batches(units: DataFrame, delay: str, seconds: int = FLUSH_SECONDS) -> DataFrame:
    return flush_batches(units.withWatermark("ts", delay), seconds)
