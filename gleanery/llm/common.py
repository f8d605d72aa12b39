"""What the training-data operators share: inputs, scratch tables, shipped code."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id`` and ``text`` (NULL: empty) and the columns in ``also``.

    Whatever else the input has is left out here, so an extra column cannot
    clash with one that an operator adds.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)


def wrapped(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one column ``row``, safe from clashing names, beside ``keys``."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(v.alias(k) for k, v in keys.items()))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of :func:`wrapped` with the columns of ``docs``."""
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def only(docs: DataFrame, kept: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are a row of ``kept``, NULL equal to NULL."""
    rows = wrapped(docs, **keys)
    on = F.lit(True)
    for k in keys:
        on &= rows[k].eqNullSafe(kept[k])
    return unwrapped(rows.join(kept, on, "left_semi"), docs)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: a lost executor costs its running tasks only, and several
    readers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship() -> None:
    """Send this package's functions along with the tasks that call them."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def worker_for(operator: str) -> None:
    """Say which operator a task works for; what others kept in the worker is let go."""
    store = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store")).__dict__
    if store.get("operator") != operator:
        for name in [n for n in store if not n.startswith("__")]:
            del store[name]
        gc.collect()
        store["operator"] = operator


def kept_in_worker(name: str, make: Callable[[], object]):
    """``make()`` once per worker process.

    Functions that travel by value have no module of their own in the worker,
    so what outlives a task (a tokenizer, a table of words) is kept here.
    """
    store = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
