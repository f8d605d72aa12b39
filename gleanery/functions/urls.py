"""Address expressions: split, normalise, resolve and reduce to a key.

Each helper takes and returns a Column.  The rules are those of the usual URL
parser: lower-case scheme and host, default port dropped, dot segments
removed, unsafe characters percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import let, trim_ws

# Tracking parameters (besides everything that starts with utm_)
# and the only parameters kept for the article host below.
TRACKING_PARAMS = ["fbclid", "gclid", "dclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref_src", "spm", "si"]
ARTICLE_HOST = "mp.weixin.qq.com"
ARTICLE_PARAMS = ["__biz", "mid", "idx", "sn"]

# groups: 1 scheme, 2 user info, 3 host, 4 port, 5 path, 6 ?query, 7 #fragment
HTTP = (
    r"(?is)^(https?):[/\\]*([^/\\?#@]*@)?(\[[0-9a-f:.]+\]|[^\x00-\x20#/<>?@\[\\\]^|%:]+)"
    r"(?::([0-9]*))?([/\\][^?#]*)?(\?[^#]*)?(#.*)?\z"
)
#: Schemes other than http(s) whose addresses have a host like theirs, and the port each leaves out.
WEB_PORTS = {"ftp": "21", "ws": "80", "wss": "443"}
WEB = HTTP.replace("(https?)", "(" + "|".join(WEB_PORTS) + ")")
# groups: 1 host, 2 path, 3 ?query, 4 #fragment
FILE = r"(?is)^file:(?:[/\\]{2}([^/\\?#]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
# any other scheme; groups: 1 scheme, 2 //authority, 3 user info, 4 host, 5 port, 6 path, 7 ?query, 8 #fragment
OTHER = (
    r"(?is)^([a-z][a-z0-9+.\-]*):(?:(//([^/?#@]*@)?(\[[0-9a-f:.]+\]|[^\x00\t\n\r #/<>?@\[\\\]^|:]*)(?::([0-9]*))?(?=[/?#]|\z))|(?!//))"
    r"([^?#]*)(\?[^#]*)?(#.*)?\z"
)
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_DOTS = r"(?i)(^|/)(\.|%2e){1,2}(/|\z)"
# What the URL parser percent-encodes in a path and in a query.
_PATH_UNSAFE = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "^": "%5E", "`": "%60", "{": "%7B", "}": "%7D"}
_QUERY_UNSAFE = {" ": "%20", '"': "%22", "'": "%27", "<": "%3C", ">": "%3E"}


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, HTTP, group)


def clean_input(c: Column) -> Column:
    """Trim, and drop the tabs and line breaks a URL parser ignores."""
    return F.regexp_replace(trim_ws(c), r"[\t\n\r]", "")


def is_http(c: Column) -> Column:
    return c.rlike(HTTP)


def host_of(c: Column) -> Column:
    return F.lower(_part(c, 3))


def scheme_of(c: Column) -> Column:
    return F.lower(_part(c, 1))


def site_of(c: Column) -> Column:
    """Host without a leading ``www.``; empty when there is none."""
    return F.regexp_replace(host_of(c), r"^www\.", "")


def percent_encode(c: Column, unsafe: dict[str, str]) -> Column:
    """Encode non-ASCII as UTF-8 bytes and the given ASCII characters."""

    def encode(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), 1)
        encoded = F.transform(pieces, lambda p: F.when(p.rlike(r"[^\x00-\x7F]"), F.url_encode(p)).otherwise(p))
        return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(encoded, "")).otherwise(text)

    out = let(c, encode)
    for char, code in unsafe.items():
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def encode_component(c: Column) -> Column:
    """``encodeURIComponent``: form encoding adjusted to its safe set."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def decode_component(c: Column) -> Column:
    """``decodeURIComponent``; the text itself when it is not valid."""
    return let(c, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t))


def remove_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    up, here = ["..", ".%2e", "%2e.", "%2e%2e"], [".", "%2e"]

    def walk(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(F.lower(s).isin(up), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(F.lower(s).isin(here), acc)
            .otherwise(F.array_append(acc, s)),
        )
        folder = F.lower(F.element_at(segments, -1)).isin(up + here)
        return F.concat(F.lit("/"), F.array_join(F.when(folder, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))

    def clean(p: Column) -> Column:
        return F.when(p.rlike(_DOTS), let(F.slice(F.split(p, "/"), 2, 1 << 30), walk)).otherwise(p)

    return let(path, clean)


def origin_of(c: Column) -> Column:
    """``scheme://[user@]host[:port]`` with the default port dropped."""
    plain = F.concat(scheme_of(c), F.lit("://"), F.regexp_replace(_part(c, 2), r"^:?@\z", ""), host_of(c))
    port = F.regexp_replace(_part(c, 4), r"^0+(?=[0-9])", "")
    full = F.concat(plain, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""))
    return F.regexp_replace(full, r"^(http://.*):80\z|^(https://.*):443\z", "$1$2")


def path_of(c: Column) -> Column:
    """Normalised path; ``/`` for a bare host."""
    raw = F.replace(_part(c, 5), F.lit("\\"), F.lit("/"))
    return remove_dots(percent_encode(F.regexp_replace(raw, r"^\z", "/"), _PATH_UNSAFE))


def query_of(c: Column) -> Column:
    """Query without its ``?``."""
    return percent_encode(F.regexp_replace(_part(c, 6), r"^\?", ""), _QUERY_UNSAFE)


def _question(query: Column) -> Column:
    return F.regexp_replace(query, r"^(?=.)", "?")


def normalize(c: Column) -> Column:
    """The address as a URL parser prints it; NULL when it is not http(s)."""

    def href(u: Column) -> Column:
        fragment = percent_encode(_part(u, 7), {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60"})
        return F.when(is_http(u), F.concat(origin_of(u), path_of(u), _question(query_of(u)), fragment))

    return let(c, href)


def kept_query(article: Column, query: Column) -> Column:
    """Query parameters that identify the content, order and encoding kept."""

    def wanted(key: Column) -> Column:
        tracked = F.lower(key).startswith("utm_") | F.lower(key).isin(TRACKING_PARAMS)
        return F.when(article, key.isin(ARTICLE_PARAMS)).otherwise(~tracked)

    def keep(segment: Column) -> Column:
        raw = F.get(F.split(segment, "="), F.lit(0))
        return (segment != "") & let(F.coalesce(F.try_url_decode(raw), raw), wanted)

    return F.array_join(F.filter(F.split(query, "&"), keep), "&")


def _with_port(host: Column, port: Column, default: Column | None) -> Column:
    """Host and port, unless there is none or it is the default."""
    bare = F.regexp_replace(port, r"^0+(?=[0-9])", "")
    own = (bare != "") if default is None else (bare != "") & (bare != default)
    return F.concat(host, F.when(own, F.concat(F.lit(":"), bare)).otherwise(""))


def _query_key(raw: Column, unsafe: dict[str, str]) -> Column:
    return _question(kept_query(F.lit(False), percent_encode(F.regexp_replace(raw, r"^\?", ""), unsafe)))


def _web_key(u: Column) -> Column:
    """Key of an address with a host and a default port, other than http(s)."""
    part = lambda i: F.regexp_extract(u, WEB, i)
    scheme = F.lower(part(1))
    default = F.try_element_at(F.create_map(*(F.lit(x) for pair in WEB_PORTS.items() for x in pair)), scheme)
    host = _with_port(F.concat(F.regexp_replace(part(2), r"^:?@\z", ""), F.lower(part(3))), part(4), default)
    path = F.regexp_replace(F.replace(part(5), F.lit("\\"), F.lit("/")), r"^\z", "/")
    return F.concat(scheme, F.lit("://"), host, remove_dots(percent_encode(path, _PATH_UNSAFE)), _query_key(part(6), _QUERY_UNSAFE))


def _file_key(u: Column) -> Column:
    part = lambda i: F.regexp_extract(u, FILE, i)
    host = F.regexp_replace(F.lower(part(1)), r"^localhost\z", "")
    path = F.regexp_replace(F.replace(part(2), F.lit("\\"), F.lit("/")), r"^(?!/)", "/")
    return F.concat(F.lit("file://"), host, remove_dots(percent_encode(path, _PATH_UNSAFE)), _query_key(part(3), _QUERY_UNSAFE))


def _other_key(u: Column) -> Column:
    """Key of an address of a scheme that the parser knows nothing of: its host keeps its case, a path without a slash is kept whole."""
    part = lambda i: F.regexp_extract(u, OTHER, i)
    host = _with_port(F.concat(F.regexp_replace(part(3), r"^:?@\z", ""), percent_encode(part(4), {})), part(5), None)
    authority = F.when(part(2) != "", F.concat(F.lit("//"), host)).otherwise("")
    rooted = remove_dots(percent_encode(part(6), _PATH_UNSAFE))
    path = F.when(part(6).startswith("/"), rooted).otherwise(percent_encode(part(6), {}))
    return F.concat(F.lower(part(1)), F.lit(":"), authority, path, _query_key(part(7), {k: v for k, v in _QUERY_UNSAFE.items() if k != "'"}))


def canonical(c: Column) -> Column:
    """Dedup key of an address of any scheme: no fragment, no tracking parameters; one that does not parse is only trimmed."""

    def key(u: Column) -> Column:
        article = u.rlike(r"(?i)^https?:[/\\]*([^/?#]*@)?mp\.weixin\.qq\.com(:[0-9]*)?/s/?(\?|#|\z)")
        http = F.concat(origin_of(u), path_of(u), _question(kept_query(article, query_of(u))))
        known = u.rlike(r"(?i)^(https?|ftp|wss?|file):")
        other = F.when(u.rlike(WEB), _web_key(u)).when(u.rlike(FILE), _file_key(u)).when(~known & u.rlike(OTHER), _other_key(u)).otherwise(trim_ws(c))
        return F.when(is_http(u), http).otherwise(other)

    return let(clean_input(c), key)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as an absolute address against ``base``; NULL if it cannot be."""

    def absolute(h: Column) -> Column:
        page = F.concat(path_of(base), _question(query_of(base)))
        joined = (
            F.when(h.rlike(r"(?i)^https?:"), h)
            .when(h.rlike(r"^[/\\]{2}"), F.concat(scheme_of(base), F.lit(":"), h))
            .when(h.rlike(r"^[/\\]"), F.concat(origin_of(base), h))
            .when(h.startswith("?"), F.concat(origin_of(base), path_of(base), h))
            .when(h.startswith("#") | (h == ""), F.concat(origin_of(base), page, h))
            .otherwise(F.concat(origin_of(base), F.regexp_replace(path_of(base), r"[^/]*\z", ""), h))
        )
        other_scheme = h.rlike(SCHEME) & ~h.rlike(r"(?i)^https?:")
        return F.when(other_scheme, h).otherwise(normalize(joined))

    return let(clean_input(href), absolute)


def query_param(c: Column, name: str) -> Column:
    """Decoded value of the first parameter with this name; NULL if absent."""
    segments = F.split(F.regexp_replace(_part(c, 6), r"^\?", ""), "&")
    hit = F.get(F.filter(segments, lambda s: F.get(F.split(s, "="), F.lit(0)) == name), F.lit(0))
    return let(F.regexp_replace(hit, r"^[^=]*=?", ""), lambda raw: F.coalesce(F.try_url_decode(raw), raw))


def path_parts(c: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path_of(c), "/"), lambda p: p != "")


def file_name(c: Column) -> Column:
    """Decoded last path segment of an http(s) address, else empty."""
    last = F.coalesce(F.try_element_at(path_parts(c), F.lit(-1)), F.lit(""))
    return F.when(is_http(c), decode_component(last)).otherwise("")


def split_ext(name: Column) -> tuple[Column, Column]:
    """(stem, extension): 1-5 alphanumerics with a letter count as extension."""
    pattern = r"(?s)^(.+)\.(?=[0-9]*[A-Za-z])([A-Za-z0-9]{1,5})\z"
    hit = name.rlike(pattern)
    stem = F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(name)
    return stem, F.when(hit, F.lower(F.regexp_extract(name, pattern, 2))).otherwise("")


def link_destination(c: Column) -> Column:
    """Escape what would end a Markdown link target: white space and parentheses."""
    out = c
    for char in _LINK_UNSAFE:
        out = F.replace(out, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.when(c.rlike(r"[\x{0009}-\x{000D} ()\x{00A0}\x{1680}\x{2000}-\x{3000}\x{FEFF}]"), out).otherwise(c)


# The white-space characters and parentheses of a link target.
_LINK_UNSAFE = [
    chr(n)
    for n in [*range(0x09, 0x0E), 0x20, 0x28, 0x29, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
]
