"""Quotes of a page: where they go, their anchors, the collected document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import markdown as M
from gleanery.functions import urls as U
from gleanery.functions.text import blank_to_null, trim_ws
from gleanery.operators.documents import WORDS, clip_documents
from gleanery.plans.ordered import rank_in_key

#: Shape of an anchor line; the words of the link do not matter.
ANCHOR_LINE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?: \(\d+\))? · \[[^\]\n]+\]\("
#: Entries per row of a collected document.
ENTRIES_PER_PART = 1000


def fragment_part(c: Column) -> Column:
    return F.replace(U.encode_component(c), F.lit("-"), F.lit("%2D"))


def fragment_url(page: Column, start: Column, end: Column, prefix: Column, suffix: Column) -> Column:
    """``page#hash:~:text=[prefix-,]start[,end][,-suffix]``; an old directive goes."""
    base = F.regexp_replace(F.regexp_replace(page, r"(?s)^([^#]*#?.*?):~:.*\z", "$1"), r"^([^#]*)\z", "$1#")
    part = lambda c: blank_to_null(F.coalesce(c, F.lit("")))
    before = F.coalesce(F.concat(fragment_part(part(prefix)), F.lit("-,")), F.lit(""))
    until = F.coalesce(F.concat(F.lit(","), fragment_part(part(end))), F.lit(""))
    after = F.coalesce(F.concat(F.lit(",-"), fragment_part(part(suffix))), F.lit(""))
    return F.concat(base, F.lit(":~:text="), before, fragment_part(start), until, after)


def quote_targets(quotes: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """Append to the page's quote file, or start a new one.

    ``quotes``: ``id, source``; ``index``: ``source, file, file_id``;
    ``files``: ``file, id``.  Appends only if the recorded file is there, under
    any case, and still carries the recorded id.
    """
    records = index.select("source", "file_id", F.lower("file").alias("_file"))
    present = files.select(F.lower("file").alias("_file"), F.col("id").alias("file_id"), F.lit(True).alias("_hit")).distinct()
    known = records.join(present, ["_file", "file_id"], "left").select("source", "file_id", "_hit", F.lit(True).alias("_known"))
    joined = quotes.join(known, "source", "left")
    append = F.coalesce("_hit", F.lit(False))
    return joined.select(
        "id",
        "source",
        F.when(append, "append").otherwise("new").alias("target"),
        F.when(append, F.col("file_id")).alias("file_id"),
        (F.coalesce("_known", F.lit(False)) & ~append).alias("recreated"),
    )


def quote_anchors(quotes: DataFrame, block: Column | None = None) -> DataFrame:
    """Add ``anchor``; identical minute-and-link lines are numbered from 2.

    ``quotes``: ``id, source, ts, link``.  A minute of a hot page is cut
    further by the second, so the numbering of one line is spread as well.
    """
    minute = F.date_format("ts", "yyyy-MM-dd HH:mm")
    keyed = quotes.withColumns({"_minute": minute, "_link": U.link_destination(F.col("link"))})
    cut = block if block is not None else F.date_trunc("second", F.col("ts"))
    ranked = rank_in_key(keyed, ["source", "_minute", "_link"], ["ts", "id"], cut, "_n")
    number = F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise("")
    anchor = F.concat(F.col("_minute"), number, F.lit(f" · [{WORDS['jump']}]("), F.col("_link"), F.lit(")"))
    return ranked.withColumn("anchor", anchor).drop("_minute", "_link", "_n")


def entry_text(markdown: Column, anchor: Column) -> Column:
    """The passage as a blockquote, a blank line, the anchor line."""
    quoted = F.regexp_replace(M.prefix_lines(trim_ws(markdown)), r"(?m)^>[^\S\n]+$", ">")
    return F.concat(quoted, F.lit("\n\n"), anchor)


def collect_quotes(quotes: DataFrame, per_part: int = ENTRIES_PER_PART) -> DataFrame:
    """All quotes of a page as one ordered document, with their number.

    ``quotes``: ``id, source, title, ts, link, markdown``.  A document is cut
    into parts of ``per_part`` entries, so a page that holds a third of all
    quotes is many rows; the parts in order, joined, are the document.
    """
    anchored = quote_anchors(quotes)
    ranked = rank_in_key(anchored, ["source"], ["ts", "id"], F.date_trunc("day", F.col("ts")), "entry_no")
    entries = ranked.select(
        "source", F.floor((F.col("entry_no") - 1) / per_part).alias("part"), "entry_no", "title", "ts", "id",
        entry_text(F.col("markdown"), F.col("anchor")).alias("text"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "text"))), lambda e: e["text"])
    parts = entries.groupBy("source", "part").agg(
        F.count("*").alias("n"), F.array_join(ordered, "\n\n").alias("body"), F.min_by(F.struct("id", "title", "ts"), "entry_no").alias("head")
    )
    # counted on narrow rows: a window over the parts would bring all text of a hot page to one task
    totals = quotes.where("source IS NOT NULL AND ts IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("entries"))
    sized = parts.join(totals, "source")
    first = clip_documents(
        sized.where("part = 0").select(
            F.col("source").alias("id"), F.col("source"), F.lit("quote").alias("medium"), F.col("head.title").alias("title"),
            F.col("head.ts").alias("captured"), F.array().cast("array<string>").alias("tags"), F.lit("full").alias("extract"), "body",
        )
    ).select(F.col("id").alias("source"), F.lit(0).cast("bigint").alias("part"), "document")
    joined = sized.join(first, ["source", "part"], "left")
    later = F.concat(F.lit("\n"), F.col("body"), F.lit("\n"))
    return joined.select("source", "part", "entries", F.coalesce("document", later).alias("document"))


def count_entries(document: Column) -> Column:
    return F.size(F.filter(F.split(document, "\n"), lambda line: line.rlike(ANCHOR_LINE)))


def _note_area(lines: Column, anchor: Column) -> tuple[Column, Column]:
    """(line of the anchor, line of the next entry), from 1; 0 when none."""
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("i"), line.alias("line")))
    hits = F.filter(numbered, lambda x: x["line"] == anchor)
    at = F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["i"])
    opens = F.filter(
        numbered,
        lambda x: (x["i"] > at)
        & (x["line"].startswith("> ") | (x["line"] == ">"))
        & (trim_ws(F.get(lines, x["i"] - 2)) == ""),
    )
    return at, F.coalesce(F.get(opens, F.lit(0))["i"], F.lit(0))


def quote_notes(entries: DataFrame) -> DataFrame:
    """Note of each entry ``(document, anchor)``: the text up to the next entry.

    NULL unless the anchor is there exactly once.
    """
    staged = entries.withColumn("_lines", F.split("document", "\n"))
    at, following = _note_area(F.col("_lines"), F.col("anchor"))
    placed = staged.withColumns({"_at": at, "_next": following})
    end = F.when(F.col("_next") > 0, F.col("_next") - 1).otherwise(F.size("_lines"))
    note = trim_ws(F.array_join(F.slice("_lines", F.col("_at") + 1, F.greatest(end - F.col("_at"), F.lit(0))), "\n"))
    return placed.withColumn("note", note).drop("_lines", "_at", "_next")


def replace_quote_notes(entries: DataFrame) -> DataFrame:
    """``document`` with the note of its anchor set to ``note``; NULL if not found once."""
    staged = entries.withColumn("_lines", F.split("document", "\n"))
    at, following = _note_area(F.col("_lines"), F.col("anchor"))
    placed = staged.withColumns({"_at": at, "_next": following})
    head = F.array_join(F.slice("_lines", F.lit(1), F.col("_at")), "\n")
    block = F.regexp_replace(trim_ws(F.col("note")), r"(?s)^(?=.)", "\n\n")
    rest = F.when(
        F.col("_next") > 0, F.concat(F.lit("\n\n"), F.array_join(F.slice("_lines", F.greatest("_next", F.lit(1)), F.size("_lines")), "\n"))
    ).otherwise("\n")
    return placed.withColumn("document", F.concat(head, block, rest)).drop("_lines", "_at", "_next")
