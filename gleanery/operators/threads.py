"""Post threads: range around a post, assembled document, links, videos, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import markdown as M
from gleanery.functions import urls as U
from gleanery.functions.text import format_seconds, let, trim_ws
from gleanery.operators.documents import WORDS

#: Most posts of one thread.
MAX_POSTS = 50
TITLE_POINTS = 30
SITE = "https://x.com"


def _in_range(posts: DataFrame, focal: DataFrame) -> DataFrame:
    """Posts of the author's run around the focal post of their thread.

    The ends of the run are extreme positions of the posts that stop it:
    the last other author before, the last break up to, and the first other
    author after the focal post.  Those are partial aggregates, so a thread
    of any length needs no ordered pass in one task.
    """
    target = focal.join(posts.select("thread_id", F.col("id").alias("focal_id"), "pos", "handle"), ["thread_id", "focal_id"]).select(
        "thread_id", F.col("pos").alias("_at"), F.lower("handle").alias("_author")
    )
    placed = posts.join(target, "thread_id")
    other = F.lower("handle") != F.col("_author")
    bounds = placed.groupBy("thread_id").agg(
        F.max(F.when(other & (F.col("pos") < F.col("_at")), F.col("pos"))).alias("_before"),
        F.max(F.when(F.col("break_before") & (F.col("pos") <= F.col("_at")), F.col("pos"))).alias("_break"),
        F.min(F.when(other & (F.col("pos") > F.col("_at")), F.col("pos"))).alias("_after"),
    )
    inside = (
        (F.col("_before").isNull() | (F.col("pos") > F.col("_before")))
        & (F.col("_break").isNull() | (F.col("pos") >= F.col("_break")))
        & (F.col("_after").isNull() | (F.col("pos") < F.col("_after")))
    )
    return posts.join(bounds, "thread_id").where(inside).drop("_before", "_break", "_after")


def thread_ranges(posts: DataFrame, focal: DataFrame, max_posts: int = MAX_POSTS) -> DataFrame:
    """``start, end`` positions of the run, its length, and whether it is cut.

    ``posts``: ``thread_id, pos, id, handle, break_before``; ``focal``:
    ``thread_id, focal_id``.  ``end`` is the last post of the whole run.
    """
    found = _in_range(posts, focal).groupBy("thread_id").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n")
    )
    return found.withColumn("limit", F.col("n") > max_posts)


def _link(label: Column, target: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]("), U.link_destination(target), F.lit(")"))


def media_blocks(media: Column) -> Column:
    """Markdown blocks of a post's media, in order."""

    def blocks(m: Column) -> Column:
        image = lambda u: F.concat(F.lit("![]("), U.link_destination(u), F.lit(")"))
        clock = format_seconds(F.floor(m["duration_ms"] / 1000))
        video = F.coalesce(F.concat(F.lit(f"▶ {WORDS['x_video']} ("), clock, F.lit(")")), F.lit(f"▶ {WORDS['x_video']}"))
        label = F.when(m["kind"] == "gif", "▶ GIF").otherwise(video)
        poster = F.when(F.coalesce(m["poster"], F.lit("")) == "", "").otherwise(image(m["poster"]))
        return F.when(m["kind"] == "photo", F.array(image(m["url"]))).otherwise(F.array(poster, _link(label, m["href"])))

    return F.flatten(F.transform(media, blocks))


def text_block(text: Column, truncated: Column, full_url: Column) -> Column:
    """Paragraphs; a truncated text ends in a link to the whole post."""
    more = F.concat(F.lit("… "), _link(F.lit(WORDS["full_post"]), full_url))
    return let(
        M.paragraphs(text),
        lambda t: F.when(~truncated, t).when(t == "", more).otherwise(F.concat(t, F.lit(" "), more)),
    )


def _blocks(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda b: b != ""), "\n\n")


def _no_media() -> Column:
    return F.array().cast("array<string>")


def quoted_post(q: Column, outer_url: Column) -> Column:
    """A quoted post as one blockquote."""
    name = F.when(q["name"] == "", q["handle"]).otherwise(q["name"])
    who = F.when(q["handle"] == "", q["name"]).otherwise(F.concat(name, F.lit(" (@"), q["handle"], F.lit(")")))
    day = F.date_format(F.try_to_timestamp(q["datetime"]), "yyyy-MM-dd")
    head = F.concat_ws(
        " · ",
        F.concat(F.lit("**"), M.escape_inline(who), F.lit("**")),
        day,
        F.when(q["url"] != "", _link(F.lit(WORDS["post"]), q["url"])),
    )
    source = F.when(q["url"] == "", outer_url).otherwise(q["url"])
    text = text_block(q["text_md"], q["truncated"], source)
    parts = F.concat(F.array(head, text), F.coalesce(media_blocks(q["media"]), _no_media()))
    return M.prefix_lines(_blocks(parts))


def post_markdown() -> Column:
    """Text, media, card and quoted post of a post row, blocks a blank line apart."""
    card = F.col("card")
    parts = F.concat(
        F.array(text_block(F.col("text_md"), F.col("truncated"), F.col("url"))),
        F.coalesce(media_blocks(F.col("media")), _no_media()),
        F.when(card.isNull(), _no_media()).otherwise(F.array(_link(M.escape_inline(card["label"]), card["url"]))),
        F.when(F.col("quote").isNull(), _no_media()).otherwise(F.array(quoted_post(F.col("quote"), F.col("url")))),
    )
    return _blocks(parts)


def _lead(text_md: Column, fallback: Column) -> Column:
    return let(M.plain_text(text_md), lambda t: F.when(t == "", fallback).otherwise(F.substring(t, 1, TITLE_POINTS)))


def thread_documents(posts: DataFrame, focal: DataFrame, max_posts: int = MAX_POSTS) -> DataFrame:
    """The author's thread around each focal post as one document.

    The cap applies before unreadable posts (``text_md`` NULL) drop out.  The
    rank filter is a group limit, so at most ``max_posts`` rows per thread and
    task reach the shuffle and at most that many meet in a document.
    """
    ordered = Window.partitionBy("thread_id").orderBy("pos")
    run = _in_range(posts, focal)
    kept = run.withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= max_posts + 1)
    cut = F.max(F.when(F.col("_n") > max_posts, 1).otherwise(0)) == 1
    readable = (F.col("_n") <= max_posts) & F.col("text_md").isNotNull()
    short = F.col("truncated") | F.coalesce(F.col("quote.truncated"), F.lit(False))
    staged = kept.select("thread_id", "_n", readable.alias("_ok"), short.alias("_short"), "id", "handle", "text_md", post_markdown().alias("_md"))
    bodies = F.filter(F.transform(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("_n", "_md")))), lambda p: p["_md"]), lambda m: m != "")
    threads = staged.groupBy("thread_id").agg(
        F.count(F.when(F.col("_ok"), 1)).alias("posts"),
        F.count(F.when(F.col("_ok") & F.col("_short"), 1)).alias("truncated"),
        cut.alias("limit"),
        F.min_by(F.struct("handle", "id", "text_md"), F.when(F.col("_ok"), F.col("_n"))).alias("head"),
        F.array_join(bodies, "\n\n").alias("markdown"),
    )
    title = F.concat(F.lit("@"), F.col("head.handle"), F.lit(" - "), _lead(F.col("head.text_md"), F.col("head.id")))
    return threads.where("posts > 0").select(
        "thread_id",
        F.when(F.col("posts") > 1, "thread").otherwise("post").alias("form"),
        "posts",
        "truncated",
        "limit",
        (F.col("limit") | (F.col("truncated") > 0)).alias("partial"),
        title.alias("title"),
        "markdown",
    )


def resolve_short_links(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Text of each post with its links written out.

    ``posts``: ``post_id, parts`` where a part is ``text`` (already escaped) or
    a link ``href, visible``; ``links``: ``short, url``.  Target: the map, else
    the visible text if that is an address, else the short link itself.
    """
    parts = posts.select("post_id", F.posexplode("parts").alias("pos", "p")).select("post_id", "pos", "p.text", "p.href", "p.visible")
    known = links.select(F.col("short").alias("href"), F.col("url").alias("_target"))
    joined = parts.join(known, "href", "left")
    shown = F.regexp_replace(trim_ws(F.coalesce("visible", F.lit(""))), r"…\z", "")
    from_text = F.when(shown.rlike(r"(?i)^https?://\S+\z"), shown)
    target = F.coalesce("_target", from_text, "href")
    tag = F.coalesce(
        F.nullif(F.regexp_replace(trim_ws(F.col("visible")), "^[#＃]", ""), F.lit("")),
        U.decode_component(F.regexp_extract("href", r"^/hashtag/([^?]*)", 1)),
    )
    mention = F.regexp_extract("href", r"^/([A-Za-z0-9_]{1,50})/?\z", 1)
    label = F.when(trim_ws(F.coalesce("visible", F.lit(""))) != "", trim_ws(F.col("visible"))).otherwise(F.col("href"))

    def md(text: Column, url: Column) -> Column:
        return _link(M.escape_inline(text), url)

    link = (
        F.when(F.col("href").startswith("/hashtag/"), md(F.concat(F.lit("#"), tag), F.concat(F.lit(f"{SITE}/hashtag/"), U.encode_component(tag))))
        .when(F.col("href").startswith("/") & (mention != ""), md(F.concat(F.lit("@"), mention), F.concat(F.lit(f"{SITE}/"), mention)))
        .when(F.col("href").startswith("/"), md(label, U.resolve(F.lit(f"{SITE}/"), F.col("href"))))
        .otherwise(md(F.regexp_replace(target, r"(?i)^https?://", ""), target))
    )
    written = joined.select("post_id", "pos", F.coalesce("text", link).alias("md"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda p: p["md"])
    return written.groupBy("post_id").agg(trim_ws(F.array_join(ordered, "")).alias("expanded"))


def post_videos(posts: DataFrame) -> DataFrame:
    """The first video of each post as a record; posts without one drop out.

    A row may name what is asked for: ``page_url`` (its video number counts
    only for that post) and ``in_quote`` (the quoted post's video is meant).
    Media are an array of the row, so nothing is shuffled.
    """
    quoted = posts.where(F.col("in_quote") & F.col("quote").isNotNull()).select(
        "page_url", F.regexp_extract("quote.url", r"/status/([0-9]+)", 1).alias("id"), "quote.handle", "quote.name", "quote.datetime",
        "quote.text_md", "quote.media",
    ).where("id <> ''")
    own = posts.where(~F.col("in_quote")).select("page_url", "id", "handle", "name", "datetime", "text_md", "media")
    numbered = own.unionByName(quoted).withColumn(
        "_video", F.get(F.filter(F.transform("media", lambda m, i: F.struct((i + 1).alias("n"), m.alias("m"))), lambda x: x["m"]["kind"] == "video"), F.lit(0))
    ).where(F.col("_video").isNotNull())
    asked = F.when(
        F.contains("page_url", F.concat(F.lit("/status/"), F.col("id"), F.lit("/"))),
        F.nullif(F.regexp_extract("page_url", r"/status/\d+/video/(\d{1,2})(?:[/?#]|\z)", 1), F.lit("")).cast("int"),
    )
    n = F.coalesce(asked, F.col("_video.n"))
    return numbered.select(
        F.col("id").alias("post_id"),
        n.alias("n"),
        F.concat(F.lit(f"{SITE}/"), "handle", F.lit("/status/"), "id", F.lit("/video/"), n.cast("string")).alias("url"),
        F.concat(F.lit("@"), "handle", F.lit(" - "), _lead(F.col("text_md"), F.col("id"))).alias("title"),
        F.concat("name", F.lit(" (@"), "handle", F.lit(")")).alias("author"),
        F.col("_video.m.poster").alias("cover"),
        F.floor(F.col("_video.m.duration_ms") / 1000).cast("bigint").alias("duration"),
        M.paragraphs(F.col("text_md")).alias("description"),
    )


