import json

import pytest
from pyspark.sql import functions as F

from gleanery.catalog import QUERIES
from gleanery.sources.readers import parse_sidecars, read_assets, read_clip_library, read_sidecars, stream_captures
from gleanery.sources.writers import sidecar_json, write_clips, write_library, write_sidecars
from gleanery.streaming.run import drain


def test_clip_library(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nid: "i1"\ntitle: "T \\"q\\""\ntags: ["x", "y"]\nnote: "n"\n---\nbody\n---\nmore\n')
    (tmp_path / "b.md").write_text("---\nid: raw id\ntitle: [1]\ntags: [1]\n---\nb")
    (tmp_path / "c.md").write_text("no header")
    (tmp_path / "d.txt").write_text("ignored")
    got = {r.path: r for r in read_clip_library(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.md", "c.md"}
    assert tuple(got["a.md"])[1:] == ("i1", 'T "q"', ["x", "y"], "n", "body\n---\nmore\n")
    assert got["b.md"].id == "raw id" and got["b.md"].title is None and got["b.md"].tags is None
    assert got["c.md"].id is None and got["c.md"].body == "no header"


def test_sidecars(spark, tmp_path):
    raw = [
        {"id": "1", "medium": "pdf", "bytes": 12, "tags": ["a", 1, "b"], "note": 5, "title": "t"},
        {"id": 2, "medium": "nope", "bytes": "12", "tags": "x"},
        ["not an object"],
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in raw], "value string")
    got = parse_sidecars(df).orderBy("title").collect()
    assert [(r.id, r.medium, r.bytes, r.tags, r.note, r.title) for r in got] == [("", "image", 0, [], "", ""), ("1", "pdf", 12, ["a", "b"], "", "t")]
    write_sidecars(parse_sidecars(df), str(tmp_path / "lib"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "lib" / ".meta")).collect()]
    assert list(lines[0]) == ["id", "file", "source", "media_url", "medium", "title", "site", "captured", "bytes", "mime", "tags", "note"]
    assert sorted(map(tuple, read_sidecars(spark, str(tmp_path / "lib")).collect())) == sorted(map(tuple, parse_sidecars(df).collect()))
    folder = tmp_path / "one" / ".meta"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text(json.dumps(raw[0], indent=2))
    assert read_sidecars(spark, str(tmp_path / "one")).first().id == "1"
    assert sidecar_json(parse_sidecars(df)).count() == 2


def test_write_clips_again_is_the_same(spark, tmp_path):
    path = str(tmp_path / "clips")
    index = spark.createDataFrame([("1", "web"), ("2", "link")], "id string, medium string")
    docs = index.withColumn("document", F.lit("d"))
    write_clips(path, "b1", None, docs, index)
    write_clips(path, "b2", None, docs.where("id = '1'"), index.where("id = '1'"))
    write_clips(path, "b1", None, docs, index)
    assert spark.read.parquet(f"{path}/index").groupBy("batch").count().orderBy("batch").collect() == [("b1", 2), ("b2", 1)]


def test_library_of_files(spark, tmp_path):
    path = str(tmp_path / "lib")
    docs = spark.createDataFrame([("a.md", '---\nid: "a"\ntitle: "é"\n---\nbody'), ("b (2).md", "plain")], "file string, document string")
    files = spark.createDataFrame([("a", 1, "png", b"\x00\xff"), ("a", 2, "bin", b""), ("b", 1, "txt", b"t" * 100_000)], "id string, index int, ext string, content binary")
    for _ in range(2):  # again is the same
        write_library(path, docs, files, files.select("id"))
    assert {(r.path, r.id, r.title, r.body) for r in read_clip_library(spark, path).collect()} == {("a.md", "a", "é", "body"), ("b (2).md", None, None, "plain")}
    assert sorted((r.id, r["index"], r.ext, bytes(r.content)) for r in read_assets(spark, path).collect()) == sorted(tuple(r) for r in [("a", 1, "png", b"\x00\xff"), ("b", 1, "txt", b"t" * 100_000)])
    assert {p.name for p in (tmp_path / "lib").iterdir()} == {"a.md", "b (2).md", ".assets", ".index"}


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_table_is_a_file_or_a_folder(spark, folder, tmp_path, files):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    pages.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    for d in (folder, str(tmp_path)):
        got = drain(stream_captures(spark, d).select("page_id", "url", "html"), "captures")
        assert sorted(r.page_id for r in got.collect()) == sorted(r.page_id for r in pages.collect())


def test_the_driver_lists_no_files(spark, tmp_path):
    path = str(tmp_path / "lib")
    docs = spark.range(30).select(F.concat("id", F.lit(".md")).alias("file"), F.lit("d").alias("document"))
    files = spark.range(30).select("id", F.lit(3).alias("index"), F.lit("txt").alias("ext"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    write_library(path, docs, files)
    for df in (read_assets(spark, path), read_clip_library(spark, path)):
        assert df.inputFiles() == [] and df.count() == 30
    assert all(r.id == bytes(r.content).decode() and r["index"] == 3 for r in read_assets(spark, path).collect())


def test_files_that_were_read_back_are_not_broadcast(spark, folder):
    """The planner takes what tasks list and read for a row, however large the library is."""
    back = QUERIES["s4_write_clips"](spark, folder)
    assert "Broadcast" not in back._jdf.queryExecution().sparkPlan().toString()
    assert back.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_a_task_that_fails_leaves_nothing_hidden(spark, tmp_path):
    path = tmp_path / "lib"
    (path / "b.md").mkdir(parents=True)
    (path / "b.md" / "x").touch()
    docs = spark.createDataFrame([("a.md", "d"), ("b.md", "d")], "file string, document string").coalesce(1)
    with pytest.raises(Exception, match="b.md"):
        write_library(str(path), docs)
    assert {p.name for p in path.iterdir()} == {"a.md", "b.md"}
