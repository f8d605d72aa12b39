"""Inputs of the registered queries, derived from the given tables by Spark.

The tables have no media, platform links or images; these jobs build such
columns from what they do have, row by row, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.pages import page_links
from gleanery.plans.ordered import next_row, rank_in_key
from gleanery.sources.readers import table

# Stand-ins for headers a server would send.
BRAND_TYPE = {
    "Brand#1": "image/jpeg",
    "Brand#2": "Image/PNG; charset=x",
    "Brand#3": "application/octet-stream",
    "Brand#5": "video/mp4",
    "Brand#6": "audio/mpeg",
    "Brand#7": "application/pdf",
    "Brand#8": "text/html",
    "Brand#9": "application/zip",
    "Brand#10": "image/svg+xml",
    "Brand#11": "audio/x-unknown",
    "Brand#12": "application/json",
    "Brand#13": "video/x-matroska",
}
TYPE_SUFFIX = {"STANDARD": ".jpeg", "ECONOMY": ".mp4", "MEDIUM": ".epub", "PROMO": ".SVG", "SMALL": ".flac?x=1"}
TYPE_KIND = {"STANDARD": "image", "ECONOMY": "video", "MEDIUM": "epub", "PROMO": "image", "SMALL": "audio", "LARGE": "pdf"}
MIB = 1024 * 1024


def _case(column: str, table_: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for item in table_.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(default))


def media_items(spark: SparkSession, d: str) -> DataFrame:
    """Parts as media items: address, server type and name, size, page."""
    size = F.col("p_size")
    url = F.concat(F.lit("https://cdn.example.com/f/"), F.replace("p_name", F.lit(" "), F.lit("-")), _case("p_type", TYPE_SUFFIX, ""))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        _case("p_type", TYPE_KIND, "image").alias("kind"),
        _case("p_brand", BRAND_TYPE, "").alias("content_type"),
        F.when(size < 10, "")
        .when(size < 20, F.concat("p_name", F.lit(".pdf")))
        .when(size < 30, F.concat("p_name", F.lit(".jpeg")))
        .otherwise(F.concat("p_name", F.lit(".1706")))
        .alias("file_name"),
        url.alias("url"),
        F.when(size < 5, url).otherwise(F.concat(F.lit("https://site.example.org/p/"), F.col("p_partkey").cast("string"))).alias("page_url"),
        F.when(size <= 45, size.cast("bigint") * 4 * MIB).alias("bytes"),
    )


def headed_items(spark: SparkSession, d: str) -> DataFrame:
    """The media items with the header a server would send instead of a name."""
    n, form = F.col("id").cast("string"), F.col("id") % 6
    header = (
        F.when(form == 0, F.concat(F.lit('attachment; filename="dir/part '), n, F.lit(' \\"x\\".jpeg"')))
        .when(form == 1, F.concat(F.lit("inline; FileName = part "), n, F.lit(".PDF ; size=3")))
        .when(form == 2, F.concat(F.lit("attachment; filename=\"plain.zip\"; filename*=UTF-8''d%C3%A9%20"), n, F.lit(".epub")))
        .when(form == 3, F.concat(F.lit("attachment; filename*=utf-8'en'100%25%ZZ"), n, F.lit(".flac")))
        .when(form == 4, "attachment")
    )
    return media_items(spark, d).withColumn("content_disposition", header)


def scheme_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses spelled with other schemes."""
    host, path = F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)
    n = F.col("page_id").cast("string")
    spelled = [
        F.concat(F.lit(" FTP://U@"), F.upper(host), F.lit(":021"), path, F.lit("/./é?utm_source=x&k="), n, F.lit("#f ")),
        F.concat(F.lit("wss://"), host, F.lit(":444?q='&fbclid="), n),
        F.concat(F.lit("FILE://LocalHost"), path, F.lit("/a/../b c.txt#"), n),
        F.concat(F.lit("file:"), path, F.lit("?spm=1")),
        F.concat(F.lit("MailTo:Some One@"), F.upper(host), F.lit("?subject=a b&UTM_x=1&cc="), n, F.lit("#x")),
        F.concat(F.lit("App+x://"), F.upper(host), F.lit(":80"), path, F.lit("/x/../y?a='1'&si=2#z")),
        F.concat(F.lit("app://"), F.upper(host), F.lit("?gclid=1")),
        F.concat(F.lit("app://bad host/"), n),
        F.concat(F.lit("tel:+"), n, F.lit(" ")),
    ]
    return table(spark, d, "pages").select("page_id", F.posexplode(F.array(*spelled)).alias("pos", "url"))


def platform_links(spark: SparkSession, d: str) -> DataFrame:
    """Per page, its own address and one address per platform spelling."""
    h, n = F.md5("url"), F.col("page_id").cast("string")
    addresses = [
        F.col("url"),
        F.concat(F.lit("https://youtu.be/"), F.substring(h, 1, 11), F.lit("?t=3")),
        F.concat(F.lit("http://m.youtube.com/watch?list=x&v="), F.substring(h, 1, 11)),
        F.concat(F.lit("https://www.youtube.com/shorts/"), F.substring(h, 1, 10)),
        F.concat(F.lit("https://www.bilibili.com/video/BV"), F.substring(h, 1, 10), F.lit("?p="), n),
        F.concat(F.lit("https://m.bilibili.com/video/av"), n, F.lit("/")),
        F.concat(F.lit("https://www.bilibili.com/bangumi/play/ep"), n),
        F.concat(F.lit("https://b23.tv/"), F.substring(h, 1, 7)),
        F.concat(F.lit("https://twitter.com/u"), n, F.lit("/status/"), n, F.lit("/video/1?s=2")),
        F.concat(F.lit("https://x.com/u"), n, F.lit("/status/"), n),
        F.concat(F.lit("https://pan.baidu.com/s/1"), F.substring(h, 1, 8), F.lit("?pwd=ab12")),
        F.concat(F.lit("https://pan.baidu.com/share/init?surl="), F.substring(h, 1, 8), F.lit("&pwd=a%20b")),
        F.concat(F.lit("https://115.com/s/"), F.substring(h, 1, 8), F.lit("?password=x#top")),
        F.concat(F.lit("https://pan.quark.cn/s/"), F.substring(h, 1, 8)),
    ]
    return table(spark, d, "pages").select("page_id", F.posexplode(F.array(*addresses)).alias("pos", "url"))


def image_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages as Markdown: each link an image, plus code and escapes to skip."""
    links = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), 1)
    origin = F.regexp_extract("url", "^https?://[^/?#]*", 0)
    images = F.transform(links, lambda w: F.concat(F.lit("!["), w, F.lit("]("), origin, F.lit("/"), w, F.lit(".png) text")))
    body = F.concat(
        F.lit("```\n![in fence](https://a.example/fence.png)\n```\n\n"),
        F.array_join(images, "\n"),
        F.lit("\n\n`![in code](https://a.example/code.png)` \\![escaped](https://a.example/esc.png) ![data](data:image/png;base64,AA)\n"),
        F.lit("![" + "[" * 20 + "deep" + "]" * 20 + "]("), origin, F.lit("/x" + "(" * 20), F.col("page_id").cast("string"), F.lit(")" * 20 + ".png)\n"),
    )
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), body.alias("body"))


def page_targets(spark: SparkSession, d: str) -> DataFrame:
    """The links of each page, and one to the page numbered after it, beside the page's address."""
    pages = table(spark, d, "pages")
    named = pages.select("page_id", F.col("url").alias("page_url"))
    own = page_links(pages).select("page_id", "url").join(named, "page_id")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), "url").join(named, "page_id")
    return own.unionByName(after).select("page_id", "page_url", "url")


def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records to be written out, in all four layouts."""
    medium = (
        F.when(F.col("lang") == "en", "web").when(F.col("lang") == "de", "link").when(F.col("lang") == "fr", "video").otherwise("quote")
    )
    number = F.col("doc_id").cast("string")
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, d, "documents").select(
        number.alias("id"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/a("), number, F.lit(")")).alias("source"),
        medium.alias("medium"),
        first_line.alias("title"),
        F.col("source").alias("author"),
        F.lit("").alias("published"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("captured"),
        F.array("lang", "source").alias("tags"),
        F.lit("").alias("note"),
        F.when(F.col("lang") == "de", "fallback").otherwise("full").alias("extract"),
        F.col("text").alias("body"),
        F.when(F.col("lang").isin("de", "fr"), F.col("text")).otherwise("-").alias("description"),
        F.when(F.col("lang") == "fr", "youtube").otherwise("").alias("platform"),
        F.when(F.col("lang") == "fr", F.col("n_chars").cast("double")).alias("duration"),
    )


def inline_media(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses and inline copies of the pages as media addresses."""
    page = F.col("html")
    forms = F.array(
        F.col("url"),
        F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode(page, "UTF-8"))),
        F.concat(F.lit("data:text/plain,"), F.replace(F.url_encode(page), F.lit("+"), F.lit("%20"))),
    )
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.explode(forms).alias("url"))




# --- posts, quotes, records --------------------------------------------------


def posts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as posts of a thread; long turns are by its author."""
    size = F.length("text")
    post_id = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    handle = F.when(size < 150, "other").when(F.col("turn") % 2 == 0, "AUTHOR").otherwise("author")
    url = F.concat(F.lit("https://x.com/author/status/"), post_id)
    empty = F.lit("")
    photo = F.struct(
        F.lit("photo").alias("kind"), F.concat(F.lit("https://p.example/"), post_id, F.lit("(1).jpg")).alias("url"), empty.alias("poster"),
        F.lit(None).cast("bigint").alias("duration_ms"), empty.alias("href"),
    )
    video = F.struct(
        F.lit("video").alias("kind"), empty.alias("url"), F.concat(F.lit("https://p.example/"), post_id, F.lit(".png")).alias("poster"),
        (size * 1000 + 999).cast("bigint").alias("duration_ms"), F.concat(url, F.lit("/video/1")).alias("href"),
    )
    media = F.filter(F.array(F.when(size % 2 == 0, photo), F.when(size % 5 == 0, video)), lambda m: m.isNotNull())
    quote = F.struct(
        F.lit("Some *One*").alias("name"), F.lit("one").alias("handle"), F.lit("2024-05-06T07:08:09.000Z").alias("datetime"),
        F.concat(F.lit("https://x.com/one/status/9"), post_id).alias("url"), F.lit("quoted\n\ntext").alias("text_md"),
        F.array(video).alias("media"), (size % 3 == 0).alias("truncated"),
    )
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("thread_id"),
        F.col("turn").cast("int").alias("pos"),
        post_id.alias("id"),
        handle.alias("handle"),
        F.initcap("role").alias("name"),
        F.lit("2024-01-02T03:04:05.000Z").alias("datetime"),
        url.alias("url"),
        F.col("text").alias("text_md"),
        (size % 7 == 0).alias("truncated"),
        (size % 4 == 0).alias("break_before"),
        media.alias("media"),
        F.when(size % 11 == 0, quote).alias("quote"),
        F.when(size % 13 == 0, F.struct(F.lit("https://c.example/").alias("url"), F.lit("A [card]").alias("label"))).alias("card"),
    )


def focal_posts(spark: SparkSession, d: str) -> DataFrame:
    """The first post of the author in each thread."""
    mine = posts(spark, d).where("lower(handle) = 'author'")
    return mine.groupBy("thread_id").agg(F.min_by("id", "pos").alias("focal_id"))


def link_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns as text and link parts, and the map of their short links."""
    turns = table(spark, d, "conversations")
    short = F.concat(F.lit("https://t.co/"), F.substring(F.md5("text"), 1, 8))
    role = F.col("role")
    shown = F.when(role == "system", F.concat(F.lit("https://sys.example.com/"), F.col("turn").cast("string"), F.lit("…"))).otherwise("shown text")

    def part(text: Column | None, href: Column | None = None, visible: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            (none if text is None else text).alias("text"), (none if href is None else href).alias("href"),
            (none if visible is None else visible).alias("visible"),
        )

    parts = F.array(
        part(F.concat("text", F.lit(" "))),
        part(None, short, shown),
        part(F.lit(" ")),
        part(None, F.concat(F.lit("/"), role), F.concat(F.lit("@"), role)),
        part(F.lit(" ")),
        part(None, F.concat(F.lit("/hashtag/"), role, F.lit("?src=x")), F.concat(F.lit("#"), role)),
    )
    made = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("post_id"), parts.alias("parts"))
    target = F.concat(F.lit("https://example.com/a/("), F.col("conv_id").cast("string"), F.lit(")"))
    links = turns.where(role == "assistant").select(short.alias("short"), target.alias("url")).groupBy("short").agg(F.min("url").alias("url"))
    return made, links


def structured_documents(spark: SparkSession, d: str, changed: bool = False) -> DataFrame:
    """Documents of every kind of block: all plain words of a text as heading, list, quote and paragraph.

    ``changed``: the same later, with a paragraph more at the start, another
    heading, and the two list items the other way round.
    """
    words = F.concat(F.regexp_extract_all("text", F.lit("([a-z]{3,})"), 1), F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta", "echo", "fox"))))
    at = lambda i: F.get("w", F.lit(i))
    heading = F.concat(F.lit("## "), at(0), F.lit(" "), at(1), F.lit(" later" if changed else ""))
    items = [F.concat(F.lit("- "), at(2), F.lit(" one")), F.concat(F.lit("- "), at(3), F.lit(" two"))]
    lines = [heading, "", *(reversed(items) if changed else items), "", F.concat(F.lit("> "), at(4), F.lit(" "), at(5)), "", F.array_join("w", " ")]
    if changed:
        lines = ["a new start", "", *lines]
    columns = [F.lit(x) if isinstance(x, str) else x for x in lines]
    return table(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.concat_ws("\n", *columns).alias("text"))


def chained_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Lists whose every snapshot shows the last known post and a new one beside it: events by type, as long a chain as there are."""
    events = table(spark, d, "events").select(F.col("event_type").alias("list_id"), "ts", "event_id")
    day = F.to_date("ts")
    order = ["ts", "event_id"]
    numbered = next_row(rank_in_key(events, ["list_id"], order, day, "snapshot_no"), ["list_id"], order, day, F.col("event_id"), "next").where("next IS NOT NULL")
    below = F.col("next") % 2 == 0
    pair = F.when(below, F.array("event_id", "next")).otherwise(F.array("next", "event_id"))
    shown = numbered.select("list_id", F.col("snapshot_no").cast("int").alias("snapshot_no"), F.posexplode(pair).alias("pos", "id"))
    return shown.select("list_id", "snapshot_no", "pos", F.lit("post").alias("kind"), F.col("id").cast("string").alias("id"), F.concat(F.lit("s"), F.col("snapshot_no").cast("string")).alias("handle"))


def contested_clips(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clips of 40 families of titles, some with a number of their own, and files that are there already."""
    events = table(spark, d, "events")
    family = F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string"))
    own = F.concat(F.lit(" ("), (2 + F.pmod(F.col("event_id") * 7, F.lit(90))).cast("string"), F.lit(")"))
    base = F.concat(family, F.when(F.col("event_type").isin("purchase", "click"), own).otherwise(""))
    clips = events.select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), base.alias("base"))
    there = events.where("event_id % 50 = 0").select(F.concat(F.upper(family), F.lit(" ("), (3 + F.pmod("event_id", F.lit(60))).cast("string"), F.lit(").md")).alias("file"))
    return clips, there.distinct()


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Three turns per snapshot, one further each time; half the lists scroll up."""
    turns = table(spark, d, "conversations")
    start = F.explode(F.sequence(F.col("turn") - 2, F.col("turn")))
    spread = turns.select("conv_id", "turn", "role", F.length("text").alias("size"), start.alias("start"))
    number = F.when(F.col("conv_id") % 2 == 0, F.col("start") + 10).otherwise(F.lit(1000) - F.col("start"))
    base = spread.select(F.col("conv_id").cast("string").alias("list_id"), number.cast("int").alias("snapshot_no"), "turn", "role", "size")
    post = base.select(
        "list_id", "snapshot_no", (F.col("turn") * 2 + 1).cast("int").alias("pos"), F.lit("post").alias("kind"),
        F.col("turn").cast("string").alias("id"), F.col("role").alias("handle"),
    )
    gap = base.where("size % 4 = 0").select(
        "list_id", "snapshot_no", (F.col("turn") * 2).cast("int").alias("pos"), F.lit("separator").alias("kind"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("handle"),
    )
    return post.unionByName(gap)


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Turns as quotes of a page; two or more share a minute and a link."""
    source = F.concat(F.lit("https://q.example.com/"), F.col("conv_id").cast("string"))
    seconds = F.lit(1704067200) + F.col("conv_id") * 3600 + F.floor(F.col("turn") / 3) * 60 + F.col("turn") % 3
    link = F.when(F.col("role") == "user", F.concat(source, F.lit("#:~:text=a%20(b)"))).otherwise(source)
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        source.alias("source"),
        F.concat(F.lit("Page  "), F.col("conv_id").cast("string")).alias("title"),
        F.timestamp_seconds(seconds).alias("ts"),
        link.alias("link"),
        F.col("text").alias("markdown"),
    )


def clip_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as stored records; some files carry another id."""
    number = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        number.alias("id"),
        F.when(F.col("n_chars") % 10 == 0, "other").otherwise(number).alias("file_id"),
        F.when(F.col("lang") == "de", F.concat(number, F.lit(".jpg"))).otherwise(F.concat(F.lit("edited "), number, F.lit(".md"))).alias("file"),
        F.when(F.col("lang") == "de", "image").otherwise("web").alias("medium"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        F.array("lang", "source").alias("tags"),
        F.lit("").alias("note"),
    )


def clip_edits(spark: SparkSession, d: str) -> DataFrame:
    """Labels as edits; what a label does not say is not edited."""
    number = F.col("doc_id").cast("string")
    return table(spark, d, "labels").select(
        number.alias("id"),
        F.when(F.col("quality") == 1, F.when(F.col("doc_id") < 300, F.concat(F.lit("Edited "), number)).otherwise(F.concat(F.lit("New: "), number))).alias("title"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.col("quality").cast("string"))).alias("tags"),
        F.when(F.col("quality") == 0, "").otherwise("checked").alias("note"),
    )


def table_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with tables made of their own links and paragraphs.

    A plain table of link words, one with a banner, a spanning one and a
    layout one, put where the article starts.
    """
    links = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), 1)
    word = lambda i: F.coalesce(F.get(links, F.lit(i)), F.lit("-"))
    body_rows = F.array_join(F.transform(links, lambda w, i: F.concat(F.lit("<tr><td>"), w, F.lit("|</td>"), F.when(i > 0, F.concat(F.lit("<td>"), i.cast("string"), F.lit("</td>"))).otherwise(""), F.lit("</tr>"))), "")
    plain = F.concat(F.lit("<table><thead><tr><th>Word</th><th>No</th></tr></thead><tbody>"), body_rows, F.lit("</tbody></table>"))
    banner = F.concat(
        F.lit("<table><tr><td colspan=2>"), word(0), F.lit("</td></tr><tr><td>a</td><td>"), word(1), F.lit("</td></tr><tr><td>b</td><td>"), word(2), F.lit("<br>x</td></tr></table>")
    )
    span = F.concat(F.lit("<table><tr><td rowspan=3>"), word(0), F.lit("</td><td>1</td></tr><tr><td>2</td><td colspan=2>"), word(1), F.lit("</td></tr></table>"))
    layout = F.concat(F.lit("<table><tr><td><table><tr><td>"), word(0), F.lit("</td></tr></table></td></tr><tr><td>z</td></tr></table>"))
    made = F.concat(F.lit("<article>"), plain, F.lit("<p>between</p>"), banner, span, layout)
    return table(spark, d, "pages").select("page_id", "url", F.replace("html", F.lit("<article>"), made).alias("html"))


def video_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as video pages of two platforms, their data as embedded JSON."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    text = F.regexp_replace(title, r'["\\]', "")
    h, n = F.md5("url"), F.col("page_id").cast("string")
    watched = F.struct(
        F.struct(
            F.when(F.length("url") % 3 == 0, "elsewhere00").otherwise(F.substring(h, 1, 11)).alias("videoId"), text.alias("title"),
            F.lit("An {Author}").alias("author"), F.length("html").cast("string").alias("lengthSeconds"), F.lit("De\nscription").alias("shortDescription"),
        ).alias("videoDetails"),
        F.struct(F.struct(F.lit("2024-05-06").alias("publishDate")).alias("playerMicroformatRenderer")).alias("microformat"),
    )
    state = F.struct(
        F.struct(
            F.concat(F.lit("BV"), F.substring(h, 1, 10)).alias("bvid"), F.col("page_id").alias("aid"), text.alias("title"), F.length("html").alias("duration"),
            F.lit(1700000000).alias("pubdate"), F.lit("//i.example/p.jpg").alias("pic"), F.lit("about").alias("desc"), F.struct(F.lit("Up").alias("name")).alias("owner"),
        ).alias("videoData")
    )
    tube = F.length("url") % 2 == 0
    script = F.when(tube, F.concat(F.lit("var ytInitialPlayerResponse = "), F.to_json(watched), F.lit(";var x={};"))).otherwise(
        F.concat(F.lit("window.__INITIAL_STATE__="), F.to_json(state), F.lit(";(function(){}());"))
    )
    address = F.when(tube, F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(h, 1, 11))).otherwise(
        F.when(F.length("url") % 3 == 0, F.concat(F.lit("https://www.bilibili.com/video/av"), n)).otherwise(F.concat(F.lit("https://www.bilibili.com/video/BV"), F.substring(h, 1, 10)))
    )
    meta = F.lit('<meta property="og:image" content="/c.jpg"><meta property="og:video:url" content="https://e.example/v">')
    page = F.replace("html", F.lit("</head>"), F.concat(meta, F.lit("<script>"), script, F.lit("</script></head>")))
    return table(spark, d, "pages").select("page_id", address.alias("url"), page.alias("html"))


def meta_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the meta tags a site would add, in several spellings."""
    word = F.regexp_extract("html", '<a href="/([^"]*)">', 1)
    tags = F.concat(
        F.lit('<META content="First &amp; '), word, F.lit('" Property="og:title"><meta property=og:title content=second>'),
        F.lit("<meta name='description' content='plain  text &lt;b&gt;'><meta property='og:image' content='/i/"), F.col("page_id").cast("string"),
        F.lit(".png?a=1&amp;b=2'><meta name=author><meta name=author content=Me /><meta property='article:published_time' content=2024-01-02>"),
    )
    return table(spark, d, "pages").select("page_id", "url", F.replace("html", F.lit("</head>"), F.concat(tags, F.lit("</head>"))).alias("html"))
