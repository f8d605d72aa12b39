"""Metadata of platform video pages from their embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import urls as U
from gleanery.functions.platforms import stream_of
from gleanery.functions.text import blank_to_null, decode_entities, iso_timestamp, let, normalize_published, trim_ws

#: Strings, braces and the runs between them.
_JSON_PIECES = r'(?s)"(?:[^"\\]++|\\.)*+"|[{}]|[^"{}]++|"'


def leading_object(text: Column) -> Column:
    """The text from its opening brace to the brace that closes it, at any depth; NULL if none does."""

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        after = F.struct(depth.alias("depth"), (acc["size"] + F.length(piece)).alias("size"), (depth == 0).alias("closed"))
        return F.when(acc["closed"], acc).otherwise(after)

    pieces = F.regexp_extract_all(text, F.lit(_JSON_PIECES), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))
    end = F.aggregate(pieces, start, step)
    return let(end, lambda e: F.when(e["closed"], F.substring(text, F.lit(1), e["size"])))


def assigned_object(html: Column, name: str) -> Column:
    """JSON text of the first ``name = {…}`` that parses; NULL if none."""
    parts = F.split(html, rf"{name}\s*=\s*(?=\{{)")
    tails = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.get(F.filter(F.transform(tails, leading_object), lambda h: F.try_parse_json(h).isNotNull()), F.lit(0))


def _text(doc: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(doc, f"$.{path}"), F.lit(""))


def _number(raw: Column) -> Column:
    value = F.nullif(trim_ws(raw), F.lit("")).try_cast("double")
    return F.when((value >= 0) & (value < float("inf")), value)


def _first(*options: Column) -> Column:
    return F.coalesce(*[blank_to_null(o) for o in options], F.lit(""))


def canonical_href(html: Column) -> Column:
    links = F.filter(
        F.regexp_extract_all(html, F.lit(H.LINK_TAG), 0), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b""")
    )
    return trim_ws(decode_entities(F.coalesce(H.attribute(F.get(links, F.lit(0)), "href"), F.lit(""))))


def stream_page_meta(pages: DataFrame) -> DataFrame:
    """``page_id, state, title, author, duration, …, video_ids`` of video pages.

    ``pages``: ``page_id, url, html`` with platform addresses; other pages drop
    out.  Fields come from the page's JSON state, else from its ``og:`` tags.
    ``state`` is ``full`` only if the page names the id that was asked for;
    otherwise just the address is kept, ``partial``.
    """
    asked = pages.withColumn("s", stream_of(F.col("url"))).where(F.col("s.platform").isin("youtube", "bilibili"))
    tube = F.col("s.platform") == "youtube"
    staged = asked.withColumns(
        {
            "m": H.meta_entries(F.col("html")),
            "t": H.html_title(F.col("html")),
            "link": canonical_href(F.col("html")),
            "j": F.when(tube, assigned_object(F.col("html"), "ytInitialPlayerResponse")).otherwise(
                assigned_object(F.col("html"), r"(?:window\.)?__INITIAL_STATE__")
            ),
        }
    )
    m = F.col("m")
    tags = {k: H.meta_value(m, k) for k in (
        "og:title", "og:description", "og:image", "og:video", "og:video:url", "og:url", "author", "video:duration", "video:release_date"
    )}
    read = staged.select("page_id", "url", "s", "j", "t", "link", F.struct(*[v.alias(k.replace(":", "_")) for k, v in tags.items()]).alias("g"))
    j, g = F.col("j"), F.col("g")
    renderer = "microformat.playerMicroformatRenderer"
    pubdate = _number(F.get_json_object(j, "$.videoData.pubdate"))
    has_video = F.get_json_object(j, "$.videoData").isNotNull()
    aid = _number(F.get_json_object(j, "$.videoData.aid"))
    episodes = F.flatten(
        F.transform(F.array(g["og_url"], F.col("link")), lambda u: F.regexp_extract_all(u, F.lit(r"(?:^|/)((?:ep|ss)\d+)(?=[/?#]|$)"), 1))
    )
    own_ids = F.when(tube, F.array(_text(j, "videoDetails.videoId"))).otherwise(
        F.when(has_video, F.array(_text(j, "videoData.bvid"), F.coalesce(F.concat(F.lit("av"), aid.cast("bigint").cast("string")), F.lit("")))).otherwise(episodes)
    )
    named = F.filter(own_ids, lambda i: i != "")
    linked = F.array_distinct(
        F.filter(
            F.transform(F.array(g["og_url"], F.col("link")), lambda u: F.when(stream_of(u)["platform"] == F.col("s.platform"), stream_of(u)["video_id"])),
            lambda i: i.isNotNull() & (i != ""),
        )
    )
    cover = F.regexp_replace(F.regexp_replace(_text(j, "videoData.pic"), "(?i)^http://", "https://"), "^//", "https://")
    page_image = F.when(g["og_image"] == "", "").otherwise(F.coalesce(U.resolve(F.col("url"), g["og_image"]), F.lit("")))
    thumbs = F.from_json(F.get_json_object(j, "$.videoDetails.thumbnail.thumbnails"), "array<struct<url:string>>")
    player = _first(g["og_video_url"], g["og_video"])
    frame = _first(g["og_video"], g["og_video_url"])
    fields = {
        "title": F.when(tube, _first(_text(j, "videoDetails.title"), g["og_title"], F.regexp_replace("t", r" - YouTube\z", ""))).otherwise(
            _first(_text(j, "videoData.title"), F.regexp_replace(_first(g["og_title"], F.col("t")), r"_哔哩哔哩_bilibili\z", ""))
        ),
        "author": F.when(tube, _first(_text(j, "videoDetails.author"), _text(j, f"{renderer}.ownerChannelName"))).otherwise(
            _first(_text(j, "videoData.owner.name"), g["author"])
        ),
        "duration": F.when(tube, _number(F.get_json_object(j, "$.videoDetails.lengthSeconds"))).otherwise(
            F.coalesce(_number(F.get_json_object(j, "$.videoData.duration")), _number(g["video_duration"]))
        ),
        "description": F.when(tube, _first(_text(j, "videoDetails.shortDescription"), g["og_description"])).otherwise(_text(j, "videoData.desc")),
        "published": F.when(tube, normalize_published(_first(_text(j, f"{renderer}.publishDate"), _text(j, f"{renderer}.uploadDate")))).otherwise(
            F.coalesce(iso_timestamp(F.timestamp_millis((pubdate * 1000).cast("bigint"))), normalize_published(g["video_release_date"]))
        ),
        "cover": F.when(tube, _first(page_image, F.coalesce(F.try_element_at(thumbs, F.lit(-1))["url"], F.lit("")))).otherwise(_first(cover, page_image)),
        "page_embed": F.when(tube, player).otherwise(frame),
        "video_ids": F.when(F.size(named) > 0, named).otherwise(linked),
    }
    found = read.withColumns(fields)
    full = F.array_contains("video_ids", F.col("s.video_id"))
    embed = _first(F.col("s.embed"), F.when(full, F.col("page_embed")).otherwise(""))
    return found.select(
        "page_id",
        F.col("s.canonical").alias("url"),
        F.when(full, "full").otherwise("partial").alias("state"),
        F.when(full & (trim_ws(F.col("title")) != ""), trim_ws(F.col("title"))).otherwise(F.col("s.canonical")).alias("title"),
        *[F.when(full, F.col(c)).otherwise("").alias(c) for c in ("author", "description", "published", "cover")],
        F.when(full, F.col("duration")).alias("duration"),
        embed.alias("embed"),
        "video_ids",
    )
