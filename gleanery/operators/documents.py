"""Stored documents: header block, four layouts, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import markdown as M
from gleanery.functions import urls as U
from gleanery.functions.text import (
    collapse,
    format_bytes,
    format_seconds,
    iso_timestamp,
    normalize_published,
    trim_ws,
    yaml_string,
    yaml_tags,
)

# Header keys in their order, and the words of the layouts.
HEADER_KEYS = ["id", "source", "medium", "title", "author", "published", "captured", "site", "tags", "note", "extract"]
STREAM_KEYS = ["platform", "video_id", "embed", "duration", "cover"]
WORDS = {
    "source": "Source",
    "quotes": "Quotes - ",
    "jump": "Jump to source",
    "from": "From ",
    "video": "video",
    "audio": "audio",
    "full_post": "Full post",
    "post": "Post",
    "x_video": "Video",
    "untitled": "Untitled",
}
PLATFORM_LABELS = {
    "youtube": "YouTube",
    "bilibili": "Bilibili",
    "x": "X video",
    "baidupan": "Baidu Pan",
    "115": "115",
    "quark": "Quark",
}


def header_lines() -> Column:
    """The keyed lines every document shares, keys in fixed order."""
    plain = {k: F.coalesce(F.col(k), F.lit("")) for k in HEADER_KEYS if k not in ("captured", "site", "tags", "published")}
    plain["published"] = normalize_published(F.coalesce(F.col("published"), F.lit("")))
    plain["captured"] = iso_timestamp(F.col("captured"))
    plain["site"] = U.site_of(F.col("source"))
    values = {**{k: yaml_string(v) for k, v in plain.items()}, "tags": yaml_tags(F.col("tags"))}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), values[k]) for k in HEADER_KEYS])


def stream_lines() -> Column:
    """The five further lines of a stream."""
    values = {k: yaml_string(F.coalesce(F.col(k), F.lit(""))) for k in STREAM_KEYS if k != "duration"}
    values["duration"] = F.coalesce(F.floor(F.col("duration") + 0.5).cast("bigint").cast("string"), F.lit("null"))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), values[k]) for k in STREAM_KEYS])


def header() -> Column:
    """The block between ``---`` lines, from the staged lines."""
    return F.concat(F.lit("---\n"), F.col("_lines"), F.lit("\n---\n"))


def _assemble(head: Column, parts: list[Column]) -> Column:
    """Header, blank line, the non-empty parts, exactly one final newline."""
    body = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n\n")
    return F.concat(F.regexp_replace(F.concat(head, F.lit("\n"), body), r"\s+\z", ""), F.lit("\n"))


def _source_link() -> Column:
    return F.concat(F.lit(f"[{WORDS['source']}]("), U.link_destination(F.col("source")), F.lit(")"))


def _image(target: Column) -> Column:
    return F.when(target == "", "").otherwise(F.concat(F.lit("![]("), U.link_destination(target), F.lit(")")))


def article(heading: Column) -> Column:
    return _assemble(header(), [F.concat(F.lit("# "), collapse(heading)), _source_link(), trim_ws(F.col("body"))])


def bookmark() -> Column:
    title = F.concat(F.lit("["), M.link_text(F.col("title")), F.lit("]("), U.link_destination(F.col("source")), F.lit(")"))
    return _assemble(header(), [title, trim_ws(F.col("description")), _image(F.col("cover"))])


def play_line() -> Column:
    """One line naming platform, length or size, and author."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in PLATFORM_LABELS.items() for x in kv]), F.col("platform"))
    what = F.when(F.col("stream_medium") == "audio", WORDS["audio"]).otherwise(WORDS["video"])
    named = F.when(label.endswith(what), label).otherwise(F.concat(label, F.lit(" "), what))
    length = F.coalesce(F.concat(F.lit(" ("), format_seconds(F.col("duration")), F.lit(")")), F.lit(""))
    by = F.regexp_replace(collapse(F.coalesce(F.col("author"), F.lit(""))), r"^(?=.)", " · ")
    direct = F.concat(F.lit("Direct "), what, F.coalesce(F.concat(F.lit(" · "), format_bytes(F.col("bytes"))), F.lit("")))
    return F.concat(F.lit("▶ "), F.when(F.col("platform") == "other", direct).otherwise(F.concat(named, length, by)))


def stream() -> Column:
    text = trim_ws(F.col("description"))
    page = F.concat(
        F.lit(f"{WORDS['from']}["),
        M.link_text(F.coalesce(F.when(F.col("page_title") != "", F.col("page_title")), F.col("page_url"))),
        F.lit("]("),
        U.link_destination(F.col("page_url")),
        F.lit(")"),
    )
    from_page = F.when((F.col("platform") == "other") & (F.col("page_url") != ""), page).otherwise("")
    parts = [
        F.concat(F.lit("# "), collapse(F.col("title"))),
        _source_link(),
        _image(F.col("cover")),
        play_line(),
        from_page,
        F.when(text == "-", "").otherwise(text),
    ]
    return _assemble(header(), parts)


def quote() -> Column:
    heading = F.concat(F.lit(f"# {WORDS['quotes']}"), collapse(F.col("title")))
    return F.concat(header(), F.lit("\n"), heading, F.lit("\n\n"), _source_link(), F.lit("\n\n"), F.col("body"), F.lit("\n"))


_NEEDED = {
    "author": "", "published": "", "note": "", "description": "", "cover": "", "platform": "", "video_id": "", "embed": "",
    "stream_medium": "video", "page_url": "", "page_title": "", "body": "",
}


def clip_documents(clips: DataFrame, *keep: str) -> DataFrame:
    """The stored text of each record ``(id, source, medium, title, …)``, beside the columns to ``keep``.

    Layout by ``medium``: web and x are articles, link a bookmark, video and
    audio a stream, quote a quote file.  Absent optional columns read as ''.
    """
    filled = clips.withColumns({k: F.lit(v) for k, v in _NEEDED.items() if k not in clips.columns})
    for name, kind in (("duration", "double"), ("bytes", "bigint"), ("heading", "string")):
        if name not in filled.columns:
            filled = filled.withColumn(name, F.lit(None).cast(kind))
    medium = F.col("medium")
    shared = filled.withColumn("_lines", header_lines())
    streamed = F.when(medium.isin("video", "audio"), F.concat(F.col("_lines"), F.lit("\n"), stream_lines()))
    staged = shared.withColumn("_lines", F.coalesce(streamed, F.col("_lines")))
    document = (
        F.when(medium.isin("web", "x"), article(F.coalesce("heading", "title")))
        .when(medium == "link", bookmark())
        .when(medium.isin("video", "audio"), stream())
        .when(medium == "quote", quote())
    )
    return staged.select("id", *keep, document.alias("document"))


def plain_texts(docs: DataFrame) -> DataFrame:
    staged = docs.select("doc_id", M.plain_text(F.col("text")).alias("text"))
    return staged.withColumn("length", F.length("text"))
