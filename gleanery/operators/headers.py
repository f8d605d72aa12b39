"""Edits written into stored documents: header lines and the shown title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls as U
from gleanery.functions.language import api_tag
from gleanery.functions.markdown import link_text
from gleanery.functions.text import collapse, let, trim_ws, yaml_string, yaml_tags

# The header keys of a translation, in order.
TRANSLATION_KEYS = ["lang", "translated_to", "translation"]
_PARTS = r"(?s)\A---\n(.*?)\n---(\n.*|\z)"
_HANDLE = r"^@[A-Za-z0-9_]{1,15} - "


def _with_header(document: Column, change) -> Column:
    """The document with its header lines changed; NULL without a header."""

    def rebuild(lines: Column) -> Column:
        return F.concat(F.lit("---\n"), F.array_join(change(lines), "\n"), F.lit("\n---"), F.regexp_extract(document, _PARTS, 2))

    lines = F.split(F.regexp_extract(document, _PARTS, 1), "\n")
    return F.when(document.rlike(_PARTS), let(lines, rebuild))


def _is_key(line: Column, key: str) -> Column:
    return line.startswith(f"{key}:")


def _set(lines: Column, key: str, value: Column) -> Column:
    """Replace the first line of a key; NULL when the key is missing."""
    found = F.filter(F.transform(lines, lambda x, i: F.when(_is_key(x, key), i)), lambda i: i.isNotNull())
    line = F.concat(F.lit(f"{key}: "), value)
    return let(F.get(found, F.lit(0)), lambda at: F.when(at.isNotNull(), F.transform(lines, lambda x, i: F.when(i == at, line).otherwise(x))))


def _has(lines: Column, key: str) -> Column:
    return F.exists(lines, lambda x: _is_key(x, key))


def _set_if(lines: Column, condition: Column, key: str, value: Column) -> Column:
    return let(lines, lambda x: F.when(condition, _set(x, key, value)).otherwise(x))


def _shown_title(document: Column, old: Column, new: Column, source: Column) -> Column:
    """Replace the first line after the header if it is still as generated."""
    shape = r"(?s)\A(---\n.*?\n---\n(?:[ \t]*\n)*+)([^\n]*)(.*)\z"
    head, line, rest = (F.regexp_extract(document, shape, g) for g in (1, 2, 3))
    target = F.concat(F.lit("]("), U.link_destination(source), F.lit(")"))
    bare = lambda t: collapse(F.regexp_replace(t, _HANDLE, ""))
    hash_ = lambda t: F.concat(F.lit("# "), t)
    link = lambda t: F.concat(F.lit("["), link_text(t), target)
    shown = (
        F.when(line == hash_(collapse(old)), hash_(collapse(new)))
        .when(line == hash_(bare(old)), hash_(bare(new)))
        .when(line == link(old), link(new))
        .otherwise(line)
    )
    return F.when(document.rlike(shape), F.concat(head, shown, rest)).otherwise(document)


def edit_documents(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``id, document`` with the edited header values written in.

    ``docs``: ``id, source, title, document`` (``title`` as stored); ``edits``:
    ``id`` and ``title, tags, note``, NULL where not edited.  Everything else
    stays byte for byte.  A document without a header or the key is NULL.
    """
    wanted = edits.select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "tags", "note")])
    joined = docs.join(wanted, "id", "left")

    def change(lines: Column) -> Column:
        given = {"title": yaml_string(F.col("_title")), "tags": yaml_tags(F.col("_tags")), "note": yaml_string(F.col("_note"))}
        for key, value in given.items():
            lines = _set_if(lines, F.col(f"_{key}").isNotNull(), key, value)
        return lines

    edited = F.coalesce("_title", "_note").isNotNull() | F.col("_tags").isNotNull()
    staged = joined.withColumn("_doc", F.when(edited, _with_header(F.col("document"), change)).otherwise(F.col("document")))
    shown = _shown_title(F.col("_doc"), F.col("title"), F.col("_title"), F.col("source"))
    return staged.select("id", F.when(F.col("_title").isNotNull(), shown).otherwise(F.col("_doc")).alias("document"))


def set_translation_fields(docs: DataFrame) -> DataFrame:
    """Write ``lang, translated_to, translation`` into the header.

    All three present: their values change in place.  Otherwise what is there
    goes and the three follow the ``extract`` line.  ``translation`` NULL
    removes them.
    """
    tag = lambda c: yaml_string(F.when(trim_ws(c) == "", "").otherwise(api_tag(trim_ws(c))))
    values = {"lang": tag(F.col("lang")), "translated_to": tag(F.col("translated_to")), "translation": yaml_string(F.col("translation"))}
    fresh = F.array(*[F.concat(F.lit(f"{k}: "), values[k]) for k in TRANSLATION_KEYS])

    def ours(x: Column) -> Column:
        return x.rlike(rf"^(?:{'|'.join(TRANSLATION_KEYS)}):")

    def insert(kept: Column) -> Column:
        after = F.get(F.filter(F.transform(kept, lambda x, i: F.when(_is_key(x, "extract"), i)), lambda i: i.isNotNull()), F.lit(0))
        at = F.coalesce(after + 1, F.size(kept))
        return let(at, lambda n: F.concat(F.slice(kept, F.lit(1), n), fresh, F.slice(kept, n + 1, F.size(kept))))

    def change(lines: Column) -> Column:
        in_place, complete = lines, F.lit(True)
        for key in TRANSLATION_KEYS:
            present = _has(lines, key)
            in_place, complete = _set_if(in_place, present, key, values[key]), complete & present
        kept = F.filter(lines, lambda x: ~ours(x))
        return F.when(F.col("translation").isNull(), kept).when(complete, in_place).otherwise(let(kept, insert))

    return docs.select("id", F.coalesce(_with_header(F.col("document"), change), F.col("document")).alias("document"))
