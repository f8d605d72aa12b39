"""String expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the source rules count as white space
# (the Unicode space set, not the ASCII-only \s of Java).
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# The same as one string; and a class that matches at once what most texts do not have: control characters, the
# hard space, and all from the first of the others to the last.
_WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_NOT_SPACE = WS.replace(r"\r ", r"\r")
_MAYBE_RARE = r"[\t\x0B\f\r\xA0\x{1680}-\x{FEFF}]"
_ENTITY = r"(?i)&(?:#x[0-9a-f]+|#[0-9]+|amp|lt|gt|quot);"
_ENTITY_PIECES = r"(?i)(&(?:#x[0-9a-f]+|#[0-9]+|amp|lt|gt|quot);|[^&]+|&)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used several times in one expression is copied into the plan each
    time; nested helpers would make that grow exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.trim(c, F.lit(_WS_CHARS))


def collapse(c: Column) -> Column:
    """White-space runs become one space, ends are trimmed.

    Ordinary text has line feeds and single spaces only, which need no pattern.
    """

    def single(spaced: Column) -> Column:
        return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, "  +", " ")).otherwise(spaced)

    ordinary = let(F.replace(c, F.lit("\n"), F.lit(" ")), single)
    return F.trim(F.when(c.rlike(_MAYBE_RARE), F.regexp_replace(c, rf" {WS}+|{_NOT_SPACE}{WS}*", " ")).otherwise(ordinary))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def code_point(number: Column) -> Column:
    """The character of a code point given as an integer column."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Decode amp, lt, gt, quot and numeric references in a single pass."""

    def reference(whole: Column, body: Column) -> Column:
        digits = F.regexp_extract(body, r"^#x?0*([0-9a-f]*);\z", 1)
        value = F.when(body.startswith("#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
        number = F.when((digits != "") & (F.length(digits) <= 7), value).cast("bigint")
        return (
            F.when(body == "amp;", "&")
            .when(body == "lt;", "<")
            .when(body == "gt;", ">")
            .when(body == "quot;", '"')
            .otherwise(let(number, lambda n: F.when(n.isNull() | (n > 0x10FFFF), whole).otherwise(code_point(n))))
        )

    def piece(p: Column) -> Column:
        named = let(F.lower(F.substring(p, 2, 1 << 30)), lambda body: reference(p, body))
        return F.when(p.rlike(_ENTITY), named).otherwise(p)

    def decode(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(_ENTITY_PIECES), 1)
        return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)

    return let(c, decode)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, NULL when there is none."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(0))


# Characters JSON leaves bare but YAML does not accept bare:
# DEL and C1, line and paragraph separators, byte-order mark, two non-characters.
_YAML_EXTRA = r"\x7F-\x{009F}\x{2028}\x{2029}\x{FEFF}\x{FFFE}\x{FFFF}"


def yaml_string(c: Column) -> Column:
    """Double-quoted scalar of the document header: a JSON string literal."""

    def escape(p: Column) -> Column:
        code = F.lower(F.hex(F.encode(p, "UTF-16BE")))
        return F.when(p.rlike(f"^[{_YAML_EXTRA}]"), F.concat(F.lit("\\u"), code)).otherwise(p)

    def finish(q: Column) -> Column:
        pieces = F.regexp_extract_all(q, F.lit(f"([{_YAML_EXTRA}]|[^{_YAML_EXTRA}]+)"), 1)
        return F.when(q.rlike(f"[{_YAML_EXTRA}]"), F.array_join(F.transform(pieces, escape), "")).otherwise(q)

    return let(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", ""), finish)


def yaml_tags(tags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tags, yaml_string), ", "), F.lit("]"))


def format_seconds(seconds: Column) -> Column:
    """``m:ss`` below one hour, else ``h:mm:ss``."""
    total = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    hours = F.floor(total / 3600).cast("bigint")
    minutes = F.floor((total % 3600) / 60).cast("bigint")
    rest = total % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%d:%02d", minutes, rest)
    )


def format_bytes(size: Column) -> Column:
    """Whole KB below 1 MB; MB and GB with one decimal unless it is zero."""

    def one_decimal(n: Column) -> Column:
        tenth = F.floor(n * 10 + 0.5).cast("bigint")
        whole = F.floor(tenth / 10).cast("bigint")
        return F.when(tenth % 10 == 0, whole.cast("string")).otherwise(
            F.concat(whole.cast("string"), F.lit("."), (tenth % 10).cast("string"))
        )

    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(size < mb, F.concat(F.floor(size / kb + 0.5).cast("bigint").cast("string"), F.lit(" KB")))
        .when(size < gb, F.concat(one_decimal(size / mb), F.lit(" MB")))
        .otherwise(F.concat(one_decimal(size / gb), F.lit(" GB")))
    )


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize_published(c: Column) -> Column:
    """ISO instant when the text parses as a time, else the trimmed text."""
    text = trim_ws(c)
    parsed = F.try_to_timestamp(text)
    return F.when(parsed.isNull(), text).otherwise(iso_timestamp(parsed))
