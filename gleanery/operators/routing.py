"""What a captured item becomes: record shape, save route, platform stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls as U
from gleanery.functions.platforms import X_HOSTS, status_of, stream_of
from gleanery.operators.media import kind_of_type, mime_of


def classify_captures(captures: DataFrame) -> DataFrame:
    """Add ``medium`` and ``extract``; the first matching shape wins."""
    kind = F.col("kind")
    page = (kind == "page") & F.col("markdown").isNotNull()
    has_x = page & F.col("x").isNotNull()
    shapes = [
        ((kind == "quote") & F.col("quote").isNotNull(), "quote", F.lit("full")),
        ((kind == "media") & F.col("media").isNotNull(), "media", F.lit("full")),
        ((kind == "stream") & F.col("stream").isNotNull(), "stream", F.lit("full")),
        (has_x, "x", F.when(F.col("x.partial").isNotNull(), "partial").otherwise("full")),
        (page, "web", F.lit("full")),
        (kind == "link", "link", F.when(F.col("fetched"), "full").otherwise("partial")),
    ]
    medium, extract = F.when(shapes[0][0], shapes[0][1]), F.when(shapes[0][0], shapes[0][2])
    for condition, name, state in shapes[1:]:
        medium, extract = medium.when(condition, name), extract.when(condition, state)
    return captures.withColumns({"medium": medium.otherwise("link"), "extract": extract.otherwise("fallback")})


def route_pages(tabs: DataFrame) -> DataFrame:
    """Route of a page ``(id, url, content_type)``: stream, media or page."""
    staged = tabs.select("id", stream_of(F.col("url")).alias("s"), mime_of(F.col("content_type")).alias("m"))
    kind = F.when(~F.col("m").isin("", "text/html", "application/xhtml+xml"), kind_of_type(F.col("m")))
    action = F.when(F.col("s").isNotNull(), "stream").when(kind.isNotNull(), "media").otherwise("page")
    return staged.select("id", action.alias("action"), F.col("s.platform").alias("platform"), F.when(action == "media", kind).alias("kind"))


def route_items(items: DataFrame) -> DataFrame:
    """Route of a media item ``(id, kind, src, page_url, frame_url)``.

    Playable items first try the platform of their page or frame, then the
    post they are in; downloadable addresses are media; ``blob:`` sound and
    video keep only the page; anything else fails.
    """
    staged = items.withColumns(
        {"_page": stream_of(F.col("page_url")), "_frame": stream_of(F.col("frame_url")), "_post": status_of(F.col("page_url"))}
    )
    playable = F.col("kind") != "image"
    hit = F.coalesce(F.col("_page"), F.col("_frame"))
    on_x = U.host_of(F.col("page_url")).isin(X_HOSTS)
    action = (
        F.when(playable & (F.col("_page.platform") == "x"), "x-video")
        .when(playable & (hit["platform"] != "x"), "stream")
        .when(playable & on_x, F.when(F.col("_post").isNotNull(), "x-video").otherwise("fail"))
        .when(F.col("src").rlike(r"(?i)^(https?:|data:)"), "media")
        .when(~playable, "fail")
        .otherwise("blob-stream")
    )
    post = F.coalesce(F.when(F.col("_page.platform") == "x", F.col("_page.video_id")), F.col("_post.id"))
    return staged.select(
        "id",
        action.alias("action"),
        F.when(action == "stream", hit["video_id"]).when(action == "x-video", post).alias("target"),
    )


def stream_links(links: DataFrame) -> DataFrame:
    """The links that name a platform video or share, in canonical form."""
    keep = [c for c in links.columns]
    found = links.withColumn("_s", stream_of(F.col("url"))).where(F.col("_s").isNotNull())
    return found.select(*keep, "_s.platform", "_s.video_id", "_s.canonical", "_s.embed")
