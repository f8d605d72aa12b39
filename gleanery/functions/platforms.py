"""Recognise video and file-share addresses; one struct per address or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import urls as U
from gleanery.functions.text import let

# Hosts and id shapes of the platforms.
YOUTUBE_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com"]
BILIBILI_HOSTS = ["bilibili.com", "www.bilibili.com", "m.bilibili.com"]
X_HOSTS = ["x.com", "www.x.com", "mobile.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com"]
BAIDU_HOSTS = ["pan.baidu.com", "yun.baidu.com"]
HOSTS_115 = ["115.com", "www.115.com", "115cdn.com", "www.115cdn.com", "anxia.com", "www.anxia.com"]
QUARK_HOSTS = ["pan.quark.cn"]
# Site paths that are not user handles.
RESERVED_HANDLES = ["i", "search", "home", "explore", "notifications", "messages", "settings", "hashtag", "compose", "intent", "share"]

STREAM_TYPE = "struct<platform:string,video_id:string,canonical:string,embed:string>"


def _stream(platform: str, video_id: Column, canonical: Column, embed: Column | str = "") -> Column:
    embed = F.lit(embed) if isinstance(embed, str) else embed
    return F.struct(
        F.lit(platform).alias("platform"), video_id.alias("video_id"), canonical.alias("canonical"), embed.alias("embed")
    )


def _part(parts: Column, i: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))


def _code(u: Column, name: str) -> Column:
    """``?name=value`` when the share carries an extraction code."""
    value = F.coalesce(U.query_param(u, name), F.lit(""))
    return F.regexp_replace(U.encode_component(value), r"^(?=.)", f"?{name}=")


def _youtube(u: Column, host: Column, parts: Column) -> Column:
    first = _part(parts, 0)
    on_site = host.isin(YOUTUBE_HOSTS)
    video = (
        F.when(host == "youtu.be", first)
        .when(on_site & (first == "watch") & (F.size(parts) == 1), U.query_param(u, "v"))
        .when(on_site & first.isin("shorts", "live", "embed"), _part(parts, 1))
    )
    found = let(
        video,
        lambda v: F.when(
            v.rlike(r"^[A-Za-z0-9_-]{11}\z"),
            _stream(
                "youtube",
                v,
                F.concat(F.lit("https://www.youtube.com/watch?v="), v),
                F.concat(F.lit("https://www.youtube.com/embed/"), v),
            ),
        ),
    )
    return F.when((host == "youtu.be") | on_site, found)


def _bilibili(u: Column, host: Column, parts: Column, raw: Column) -> Column:
    second, third = _part(parts, 1), _part(parts, 2)
    page = F.regexp_extract(F.coalesce(U.query_param(u, "p"), F.lit("")), r"^\s*0*(?!1\s*\z)([1-9][0-9]{0,8})\s*\z", 1)
    player = "https://player.bilibili.com/player.html?"

    def video(v: Column) -> Column:
        embed = F.when(v.startswith("BV"), F.concat(F.lit(player + "bvid="), v)).otherwise(
            F.concat(F.lit(player + "aid="), F.substring(v, 3, 40))
        )
        return _stream(
            "bilibili",
            v,
            F.concat(F.lit("https://www.bilibili.com/video/"), v, F.regexp_replace(page, r"^(?=.)", "?p=")),
            F.concat(embed, F.regexp_replace(page, r"^(?=.)", "&page=")),
        )

    video_id = F.when(second.rlike(r"^BV[0-9A-Za-z]{10}\z"), second).when(
        second.rlike(r"(?i)^av[0-9]+\z"), F.concat(F.lit("av"), F.substring(second, 3, 40))
    )
    on_site = host.isin(BILIBILI_HOSTS)
    return (
        F.when((host == "b23.tv") & (F.size(parts) > 0), _stream("bilibili", F.lit(""), raw))
        .when(on_site & (_part(parts, 0) == "video") & video_id.isNotNull(), let(video_id, video))
        .when(
            on_site & (_part(parts, 0) == "bangumi") & (second == "play") & third.rlike(r"^(ep|ss)[0-9]+\z"),
            _stream("bilibili", third, F.concat(F.lit("https://www.bilibili.com/bangumi/play/"), third)),
        )
    )


def _x(host: Column, parts: Column) -> Column:
    shape = F.array_join(parts, "/")
    return F.when(
        host.isin(X_HOSTS) & shape.rlike(r"^[A-Za-z0-9_]{1,50}/status/[0-9]{1,25}/video/[0-9]{1,2}\z"),
        _stream("x", _part(parts, 2), F.concat(F.lit("https://x.com/"), shape)),
    )


def _shares(u: Column, host: Column, parts: Column) -> Column:
    pair = (_part(parts, 0) == "s") & (F.size(parts) == 2)
    second = _part(parts, 1)
    init = (host == "pan.baidu.com") & (_part(parts, 0) == "share") & (second == "init") & (F.size(parts) == 2)
    baidu = F.when(pair, F.regexp_extract(second, r"^1([\w-]+)\z", 1)).when(init, U.query_param(u, "surl"))

    def share(platform: str, prefix: str, code: str) -> Column:
        return _stream(platform, second, F.concat(F.lit(prefix), second, _code(u, code)))

    word = r"^[\w-]+\z"
    return (
        F.when(
            host.isin(BAIDU_HOSTS) & baidu.rlike(word),
            let(baidu, lambda s: _stream("baidupan", s, F.concat(F.lit("https://pan.baidu.com/s/1"), s, _code(u, "pwd")))),
        )
        .when(host.isin(HOSTS_115) & pair & second.rlike(word), share("115", "https://115cdn.com/s/", "password"))
        .when(host.isin(QUARK_HOSTS) & pair & second.rlike(word), share("quark", "https://pan.quark.cn/s/", "pwd"))
    )


def stream_of(url: Column) -> Column:
    """The platform video or share an address names; NULL for everything else."""

    def found(u: Column) -> Column:
        def by_host(host: Column) -> Column:
            return let(
                U.path_parts(u),
                lambda parts: F.coalesce(
                    _youtube(u, host, parts), _bilibili(u, host, parts, u), _x(host, parts), _shares(u, host, parts)
                ),
            )

        known = [*YOUTUBE_HOSTS, "youtu.be", *BILIBILI_HOSTS, "b23.tv", *X_HOSTS, *BAIDU_HOSTS, *HOSTS_115, *QUARK_HOSTS]
        return let(U.host_of(u), lambda host: F.when(host.isin(known), by_host(host)))

    return let(U.trim_ws(url), found)


def status_of(url: Column) -> Column:
    """``struct<handle, id>`` of a post address; NULL for other addresses."""

    def found(parts: Column) -> Column:
        handle, post = _part(parts, 0), _part(parts, 2)
        valid = (
            handle.rlike(r"^[A-Za-z0-9_]{1,50}\z")
            & ~F.lower(handle).isin(RESERVED_HANDLES)
            & (_part(parts, 1) == "status")
            & post.rlike(r"^[0-9]{1,25}\z")
        )
        return F.when(valid, F.struct(handle.alias("handle"), post.alias("id")))

    return F.when(U.host_of(url).isin(X_HOSTS), let(U.path_parts(url), found))
