"""Sinks: stored records and sidecars."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import schemas as S
from gleanery.session import ship_package

#: Order of writing: what a record points to is there before the record is.
PARTS = ["attachments", "documents", "index"]


def write_clips(path: str, batch: str, attachments: DataFrame | None, documents: DataFrame, index: DataFrame) -> None:
    """Persist one batch; the index comes last.

    A failure on the way leaves files without a record, never a record that
    points nowhere.  Each part replaces only its own batch partition, so a
    batch that is run again ends in the same state.
    """
    for name, df in zip(PARTS, (attachments, documents, index), strict=True):
        if df is None:
            continue
        keys = ["batch", "medium"] if "medium" in df.columns else ["batch"]
        rows = df.withColumn("batch", F.lit(batch))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
        writer.parquet(f"{path}/{name}")


def write_files(files: DataFrame, root: str) -> None:
    """Each row ``file, content`` (binary) as a file below ``root``, on any file system that pyarrow opens.

    Tasks write into a hidden folder of their own and then move a file to its
    place, so a reader never sees half a file, a task that runs again ends in
    the same state, and tasks do not wait for each other to create files in one
    folder.
    """
    ship_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        own, made = f"{base}/.{uuid.uuid4().hex}", set()
        try:
            for batch in batches:
                names, contents = batch.column("file").to_pylist(), batch.column("content").to_pylist()
                for name, content in zip(names, contents, strict=True):
                    if not made:
                        system.create_dir(own, recursive=True)
                    folder, _, last = f"{base}/{name}".rpartition("/")
                    if folder not in made:
                        above = folder.rpartition("/")[0]
                        system.create_dir(folder, recursive=above not in made)
                        made |= {folder, above}
                    with system.open_output_stream(f"{own}/next", compression=None) as out:
                        out.write(content)
                    if system.get_file_info(f"{folder}/{last}").type != fs.FileType.NotFound:
                        system.delete_file(f"{folder}/{last}")
                    system.move(f"{own}/next", f"{folder}/{last}")
                yield pa.RecordBatch.from_arrays([batch.column("file")], ["file"])
        finally:
            if made:
                system.delete_dir(own)

    files.select("file", "content").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def write_library(path: str, documents: DataFrame, attachments: DataFrame | None = None, index: DataFrame | None = None) -> None:
    """A library folder: ``<file>.md`` per document and ``.assets/<id>/<n>.<ext>`` per attachment.

    ``documents``: ``file, document``; ``attachments``: ``id, index, ext,
    content``; ``index``: the records, as Parquet in ``.index``.  What a
    document points to is there before it, and the index comes last.
    """
    if attachments is not None:
        name = F.concat(F.lit(".assets/"), F.col("id").cast("string"), F.lit("/"), F.col("index").cast("string"), F.lit("."), F.col("ext"))
        write_files(attachments.select(name.alias("file"), "content"), path)
    write_files(documents.select("file", F.encode("document", "UTF-8").alias("content")), path)
    if index is not None:
        index.write.mode("overwrite").parquet(f"{path}/.index")


def sidecar_json(df: DataFrame) -> DataFrame:
    """One JSON object per media record, keys in the declared order."""
    fields: list[Column] = [F.col(name).cast(kind).alias(name) for name, kind in S.MEDIA_META.items()]
    return df.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_sidecars(df: DataFrame, path: str) -> None:
    """Sidecars as JSON lines below ``path/.meta``, as :func:`read_sidecars` reads them."""
    sidecar_json(df).select("value").write.mode("overwrite").text(f"{path}/.meta")
