"""Media items: kind, extension, key, and whether the bytes are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls as U
from gleanery.functions.text import blank_to_null, let, trim_ws

# Limits and the content-type and suffix tables.
MEDIA_MAX_BYTES = 100 * 1024 * 1024

IMAGE_TYPE_EXT = {
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/pjpeg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "image/avif": "avif",
}
MEDIA_TYPE_EXT = {
    "application/pdf": "pdf",
    "application/x-pdf": "pdf",
    "application/epub+zip": "epub",
    "audio/mpeg": "mp3",
    "audio/mp3": "mp3",
    "audio/mp4": "m4a",
    "audio/x-m4a": "m4a",
    "audio/m4a": "m4a",
    "audio/aac": "aac",
    "audio/wav": "wav",
    "audio/x-wav": "wav",
    "audio/wave": "wav",
    "audio/ogg": "ogg",
    "audio/webm": "webm",
    "audio/flac": "flac",
    "video/mp4": "mp4",
    "video/webm": "webm",
    "video/quicktime": "mov",
    "video/ogg": "ogv",
}
EXT_KIND = {
    "pdf": ["pdf"],
    "epub": ["epub"],
    "image": ["jpg", "jpeg", "png", "gif", "webp", "svg", "avif", "bmp"],
    "audio": ["mp3", "m4a", "wav", "ogg", "oga", "flac", "aac", "opus"],
    "video": ["mp4", "m4v", "webm", "mov", "mkv", "ogv"],
}
# Suffixes a media file may be written with; svg only on an explicit type.
SAFE_EXTS = ["jpg", "png", "gif", "webp", "avif", "bmp", "mp3", "m4a", "aac", "wav", "ogg", "flac", "webm", "mp4", "mov", "ogv", "pdf", "epub"]
IMAGE_URL_EXTS = ["jpg", "jpeg", "png", "gif", "webp", "avif", "bmp"]
AMBIGUOUS_EPUB_TYPES = ["", "application/octet-stream", "binary/octet-stream", "application/zip", "application/x-zip-compressed"]
NOT_IMAGE = r"^(text/|application/(xhtml\+xml|json)\z)"


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def mime_of(content_type: Column) -> Column:
    """Type without parameters, lower case."""
    head = F.get(F.split(F.coalesce(content_type, F.lit("")), ";"), F.lit(0))
    return F.lower(trim_ws(head))


def kind_of_type(mime: Column) -> Column:
    return (
        F.when(mime == "application/epub+zip", "epub")
        .when(mime.isin("application/pdf", "application/x-pdf"), "pdf")
        .when(mime.startswith("image/"), "image")
        .when(mime.startswith("audio/"), "audio")
        .when(mime.startswith("video/"), "video")
    )


def kind_of_ext(ext: Column) -> Column:
    return _lookup({ext_: kind for kind, exts in EXT_KIND.items() for ext_ in exts}, ext)


def url_suffix(url: Column) -> Column:
    """Suffix of the address path, lower case; '' if none."""
    return F.lower(F.regexp_extract(U.path_of(url), r"\.([A-Za-z0-9]{1,5})\z", 1))


def _jpg(ext: Column) -> Column:
    return F.when(ext == "jpeg", "jpg").otherwise(ext)


def disposition_name(header: Column) -> Column:
    """File name that a ``Content-Disposition`` header gives; '' if none.

    The encoded form (``filename*``) goes before the plain one; only what
    follows the last slash of either kind is the name.
    """
    at = r"(?is)(?:^|[;\s])"
    string = at + r'filename\s*=\s*"((?:[^"\\]|\\.)*)"'
    encoded = trim_ws(F.regexp_extract(header, at + r"filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1))
    bare = F.regexp_extract(header, at + r"filename\s*=\s*([^;]+)", 1)
    plain = F.when(header.rlike(string), F.regexp_replace(F.regexp_extract(header, string, 1), r"(?s)\\(.)", "$1")).otherwise(bare)
    name = F.when(encoded != "", U.decode_component(F.regexp_replace(encoded, r'^"|"\z', ""))).otherwise(plain)
    return trim_ws(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)([^/\\]*)\z", 1))


def media_kinds(items: DataFrame) -> DataFrame:
    """Kind and extension of each item ``(id, content_type, file_name, url)``.

    Where the items have the header ``content_disposition``, the name in it
    goes before ``file_name``.

    A mapped content type decides alone; otherwise the file-name suffix, then
    the address suffix, from the list of safe ones; else ``bin``.  The type
    tables are constants of the expression, so nothing is joined or shuffled.
    """
    if "content_disposition" in items.columns:
        own = F.coalesce("file_name", F.lit("")) if "file_name" in items.columns else F.lit("")
        items = items.withColumn("file_name", F.coalesce(blank_to_null(disposition_name(F.col("content_disposition"))), own))
    staged = items.withColumns(
        {
            "_mime": mime_of(F.col("content_type")),
            "_name": U.split_ext(F.col("file_name"))[1],
            "_url": U.split_ext(U.file_name(F.col("url")))[1],
            "_path": url_suffix(F.col("url")),
        }
    )
    named = F.coalesce(blank_to_null(F.col("_name")), F.col("_url"))
    safe = let(_jpg(named), lambda e: F.when(e.isin(SAFE_EXTS), e))
    epub_name = F.when(F.col("file_name") != "", F.col("_name")).otherwise(F.col("_url"))
    epub = F.when(F.col("_mime").isin(AMBIGUOUS_EPUB_TYPES) & (epub_name == "epub"), "epub")
    return staged.select(
        "id",
        F.coalesce(kind_of_type(F.col("_mime")), epub, kind_of_ext(F.col("_path"))).alias("kind"),
        F.coalesce(_lookup({**MEDIA_TYPE_EXT, **IMAGE_TYPE_EXT}, F.col("_mime")), safe, F.lit("bin")).alias("ext"),
    )


def image_types(items: DataFrame) -> DataFrame:
    """Extension an image is stored under; NULL when it is no usable image."""
    staged = items.select("id", mime_of(F.col("content_type")).alias("m"), url_suffix(F.col("url")).alias("s"))
    from_url = F.when(~F.col("m").rlike(NOT_IMAGE) & F.col("s").isin(IMAGE_URL_EXTS), _jpg(F.col("s")))
    return staged.select("id", F.coalesce(_lookup(IMAGE_TYPE_EXT, F.col("m")), from_url).alias("ext"))


def direct_or_stream(items: DataFrame) -> DataFrame:
    """Keep the file, only its address, or a bookmark.

    Audio and video of unknown or too large size become a stream of their own
    address; its page is kept only if it differs.  Other kinds that are too
    large become a bookmark.
    """
    playable = F.col("kind").isin("audio", "video")
    typed = F.coalesce(kind_of_type(mime_of(F.col("content_type"))), F.col("kind"))
    inline = F.lower("url").startswith("data:")
    large = F.coalesce(F.col("bytes") > MEDIA_MAX_BYTES, F.lit(False))
    probed = ~inline & typed.isin("audio", "video") & (F.col("bytes").isNull() | large)
    outcome = F.when(playable & (probed | large), "stream").when(large, "bookmark").otherwise("media")
    staged = items.withColumns({"outcome": outcome, "_page": U.canonical(F.col("page_url")), "_url": U.canonical(F.col("url"))})
    stream = F.col("outcome") == "stream"
    return staged.select(
        "id", "outcome", F.when(stream & (F.col("_page") != F.col("_url")), F.col("_page")).alias("stream_page")
    )


def media_key(url: Column) -> Column:
    """Store key of a media address: canonical, or a digest of inline bytes."""
    header = F.regexp_extract(url, r"(?is)^data:([^,]*),(.*)\z", 1)
    payload = F.regexp_extract(url, r"(?is)^data:([^,]*),(.*)\z", 2)
    packed = F.try_to_binary(F.regexp_replace(U.decode_component(payload), r"\s+", ""), F.lit("base64"))
    pieces = F.regexp_extract_all(payload, F.lit(r"(?s)(%[0-9a-fA-F]{2}|[^%]+|%)"), 1)
    hexed = F.transform(
        pieces, lambda p: F.when(p.rlike(r"^%[0-9a-fA-F]{2}\z"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))
    )
    raw = F.when(
        url.rlike(r"(?is)^data:[^,]*,"),
        F.when(header.rlike(r"(?i);\s*base64\s*(;|\z)"), packed).otherwise(F.unhex(F.array_join(hexed, ""))),
    )
    digest = F.sha2(F.coalesce(raw, F.encode(url, "UTF-8")), 256)
    return F.when(F.lower(url).startswith("data:"), F.concat(F.lit("data:sha256:"), digest)).otherwise(U.canonical(url))


def distinct_media(items: DataFrame) -> DataFrame:
    """One row per media key; counts combine before the shuffle."""
    keyed = items.select("id", media_key(F.col("url")).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def image_stats(images: DataFrame) -> DataFrame:
    """Saved and failed attachments per record."""
    return images.groupBy("id").agg(
        F.sum(F.when(F.col("saved"), 1).otherwise(0)).alias("image_count"),
        F.sum(F.when(F.col("saved"), 0).otherwise(1)).alias("image_failures"),
    )
