"""Scans: crawled pages, stored clip documents, sidecars, page streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import schemas as S
from gleanery.functions.text import trim_ws
from gleanery.session import ship_package

# The media kinds a sidecar may name.
MEDIA_KINDS = ["image", "audio", "video", "pdf", "epub"]


#: Tables whose rows are whole texts, so the work on them is per-row CPU.
TEXT_TABLES = {"pages", "documents"}


#: Bytes of a text table up to which its rows are dealt out anew.
SMALL_TABLE = 256 << 20
#: Bytes of files that are handed on at a time.
FILE_BYTES = 4 << 20


def spread(df: DataFrame, most: int = SMALL_TABLE) -> DataFrame:
    """Deal the rows of a small table out to all cores.

    A file of one row group is one task, however many cores there are.  Only a
    table of at most ``most`` bytes, by the optimizer's estimate, is shuffled
    for that; a larger one is read as its scan splits it.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    small = size <= most
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def as_captures(pages: DataFrame) -> DataFrame:
    """Pages in the capture schema; nested parts are absent for plain pages."""
    given = {"url": F.col("url"), "html": F.col("html"), "kind": F.lit("page"), "text_length": F.lit(0)}
    columns = [F.col("page_id")]
    for name, kind in S.CAPTURE.items():
        absent = F.lit("") if kind == "string" and name not in S.NULLABLE else F.lit(None)
        columns.append(given.get(name, absent).cast(kind).alias(name))
    return pages.select(*columns)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Crawled pages as captures (batch)."""
    return as_captures(spark.read.schema(S.PAGES).parquet(f"{folder}/pages.parquet"))


def stream_captures(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """The same captures as an unbounded file source; the table is a file, or a folder of files of any names."""
    source = spark.readStream.schema(S.PAGES).option("maxFilesPerTrigger", files_per_trigger)
    return as_captures(source.parquet(f"{folder}/pages*.parquet"))


def _header_value(block: Column, key: str) -> Column:
    raw = F.get(F.regexp_extract_all(block, F.lit(rf"(?m)^{key}: (.*)$"), 1), F.lit(0))
    return raw


def parse_documents(documents: DataFrame) -> DataFrame:
    """Header fields and body of stored documents (columns ``path, value``).

    Every header value is a JSON literal.  A missing or malformed value reads
    as NULL; an ``id`` that is no JSON literal falls back to its raw text.
    """
    header = F.regexp_extract(F.col("value"), r"(?s)^---\n(.*?)\n---\n", 1)
    staged = documents.select("path", "value", F.when(header != "", header).alias("block"))

    def text(key: str) -> Column:
        raw = _header_value(F.col("block"), key)
        return F.when(raw.rlike(r'^\s*".*"\s*$'), F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0)))

    raw_id, raw_tags = _header_value(F.col("block"), "id"), _header_value(F.col("block"), "tags")
    literal = F.try_parse_json(raw_id)
    quoted_only = r'^\s*\[\s*(?:"(?:[^"\\]++|\\.)*+"\s*(?:,\s*"(?:[^"\\]++|\\.)*+"\s*)*+)?\]\s*$'
    return staged.select(
        "path",
        F.when(literal.isNull(), trim_ws(raw_id)).otherwise(text("id")).alias("id"),
        text("title").alias("title"),
        F.when(raw_tags.rlike(quoted_only), F.from_json(raw_tags, "array<string>")).alias("tags"),
        text("note").alias("note"),
        F.when(F.col("block").isNull(), F.col("value"))
        .otherwise(F.regexp_replace(F.col("value"), r"(?s)\A---\n.*?\n---\n", ""))
        .alias("body"),
    )


def read_files(spark: SparkSession, path: str, folders: bool, most: int = FILE_BYTES) -> DataFrame:
    """``folder, name, content`` of the files in a folder or, with ``folders``, in each of its folders.

    On any file system that pyarrow opens.  A task lists the folder, all tasks
    read: the driver neither lists nor plans file by file.  Hidden files and
    files of no bytes are left out, as Spark's own scans do.
    """
    ship_package()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for _ in batches:
            system, base = fs.FileSystem.from_uri(path)
            kind = fs.FileType.Directory if folders else fs.FileType.File
            found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
            names = pa.array([f.base_name for f in found if f.type == kind and f.base_name[0] not in "._" and (folders or f.size)], pa.string())
            for at in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([names[at : at + 10_000]], ["entry"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["folder", "name", "content"])

        system, base = fs.FileSystem.from_uri(path)
        rows, size = [], 0
        for batch in batches:
            for entry in batch.column("entry").to_pylist():
                names = [(".", entry)]
                if folders:
                    found = system.get_file_info(fs.FileSelector(f"{base}/{entry}"))
                    names = [(entry, f.base_name) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.size]
                for folder, name in names:
                    with system.open_input_file(f"{base}/{folder}/{name}" if folders else f"{base}/{name}") as one:
                        rows.append((folder, name, one.read()))
                    size += len(rows[-1][2])
                    if size >= most:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    # names say nothing about the bytes behind them: as many tasks as shuffles have partitions
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = spark.range(0, 1, 1, 1).mapInArrow(entries, "entry string").repartition(tasks, "entry")
    return listed.mapInArrow(read, "folder string, name string, content binary")


def read_library_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: name and text of the ``.md`` files of a library folder."""
    files = read_files(spark, path, folders=False).where(F.endswith("name", F.lit(".md")))
    return files.select(F.col("name").alias("path"), F.col("content").cast("string").alias("value"))


def read_clip_library(spark: SparkSession, path: str) -> DataFrame:
    """The ``.md`` documents of a library folder."""
    return parse_documents(read_library_files(spark, path))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """``id, index, ext, content`` of the attachments of a library folder; files of no bytes are left out."""
    files = read_files(spark, f"{path}/.assets", folders=True)
    part = lambda i: F.regexp_extract("name", r"^([0-9]+)\.([^/]+)$", i)
    return files.select(F.col("folder").alias("id"), F.expr("try_cast(regexp_extract(name, '^([0-9]+)[.]', 1) AS int)").alias("index"), part(2).alias("ext"), "content")


def parse_sidecars(raw: DataFrame, column: str = "value") -> DataFrame:
    """Sidecar JSON text to the media schema, field by field with defaults."""
    doc = F.try_parse_json(F.col(column))
    staged = raw.withColumn("_doc", doc).where(F.schema_of_variant(F.col("_doc")).startswith("OBJECT"))

    def typed(name: str, want: str) -> Column:
        value = F.try_variant_get(F.col("_doc"), f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == want, F.try_variant_get(F.col("_doc"), f"$.{name}", "string"))

    tags = F.try_variant_get(F.col("_doc"), "$.tags", "array<variant>")
    columns = []
    for name, kind_ in S.MEDIA_META.items():
        if name == "tags":
            strings = F.transform(
                F.filter(tags, lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string")
            )
            column_ = F.coalesce(strings, F.array().cast("array<string>"))
        elif name == "bytes":
            kind = F.schema_of_variant(F.try_variant_get(F.col("_doc"), "$.bytes", "variant"))
            number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(F.col("_doc"), "$.bytes", "double"))
            column_ = F.coalesce(number.cast("bigint"), F.lit(0))
        elif name == "medium":
            column_ = F.when(typed(name, "STRING").isin(MEDIA_KINDS), typed(name, "STRING")).otherwise("image")
        else:
            column_ = F.coalesce(typed(name, "STRING"), F.lit(""))
        columns.append(column_.cast(kind_).alias(name))
    return staged.select(*columns)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """The sidecars below ``.meta`` of a library folder.

    A ``.json`` file is one record; a ``.txt`` file, as the sink writes them,
    has one on every line.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(f"{path}/.meta", wholetext=True)
    lines = spark.read.option("pathGlobFilter", "*.txt").text(f"{path}/.meta")
    return parse_sidecars(files.unionByName(lines))
