"""Expressions over HTML text; no DOM, so patterns work on the markup itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import collapse, decode_entities, first_match, let

# An attribute by the grammar of HTML, in two groups: a name of anything but controls, blanks and ``"'/=>``,
# and a value as it stands, in quotes of either kind or bare.
ATTRIBUTE = r"""([^\x00-\x20"'/=>]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<=>`]++)"""
META = r"(?i)<meta\b[^>]*>"
LINK_TAG = r"(?i)<link\b[^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute with this name; NULL when absent."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), F.lower)
    at = F.nullif(F.array_position(names, name), F.lit(0).cast("long"))

    def bare(raw: Column) -> Column:
        return F.when(F.left(raw, F.lit(1)).isin('"', "'"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)

    return let(F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2), (at - 1).cast("int")), bare)


def meta_entries(html: Column) -> Column:
    """``array<struct<key, content>>`` of the usable meta tags, page order."""
    tags = F.regexp_extract_all(html, F.lit(META), 0)

    def entry(tag: Column) -> Column:
        key = F.coalesce(attribute(tag, "property"), attribute(tag, "name"), F.lit(""))
        return F.struct(F.lower(key).alias("key"), attribute(tag, "content").alias("content"))

    return F.filter(F.transform(tags, entry), lambda e: (e["key"] != "") & e["content"].isNotNull())


def meta_value(entries: Column, key: str) -> Column:
    """Content of the first entry with this key, decoded and collapsed; '' if none."""
    hit = F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["content"]
    return F.coalesce(collapse(decode_entities(hit)), F.lit(""))


def html_title(html: Column) -> Column:
    return F.coalesce(collapse(decode_entities(first_match(html, TITLE))), F.lit(""))


def strip_hidden(html: Column) -> Column:
    """Drop comments, scripts and styles, whose text is not page text."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(out, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")


def content_markup(html: Column) -> Column:
    """The article subtree, else main, else the body without its furniture."""
    clean = strip_hidden(html)
    body = F.coalesce(first_match(clean, r"(?is)<body\b[^>]*>(.*)</body>"), clean)
    furniture = F.regexp_replace(body, r"(?is)<(nav|footer|aside)\b[^>]*>.*?</\1\s*>", "")
    return F.coalesce(
        first_match(clean, r"(?is)<article\b[^>]*>(.*)</article>"),
        first_match(clean, r"(?is)<main\b[^>]*>(.*)</main>"),
        furniture,
    )


def visible_text(markup: Column) -> Column:
    """Text content: tags removed, entities decoded, white space collapsed."""
    return collapse(decode_entities(F.regexp_replace(markup, r"<[^>]*>", "")))
