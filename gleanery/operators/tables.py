"""HTML tables of crawled pages: cells on a grid, kind, Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.html import attribute, strip_hidden
from gleanery.functions.text import WS, decode_entities, let, trim_ws
from gleanery.session import ship_package

# The widest span of a cell, and what a Markdown cell cannot hold.
MAX_COLSPAN = 1000
BLOCK_IN_CELL = r"(?i)<(?:pre|blockquote|table|hr|h[1-6])\b"
_TOKEN = r"""(?is)<(/?)(table|thead|tbody|tfoot|tr|td|th|caption)\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]+|<"""



def _tokens(html: Column) -> Column:
    """``array<struct<tag, closing, attrs, text>>`` of the page."""
    parts = [F.regexp_extract_all(html, F.lit(_TOKEN), g) for g in (0, 1, 2, 3)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("text", "slash", "tag", "attrs"), strict=True)])
    return F.transform(
        zipped,
        lambda t, i: F.struct(i.alias("i"), F.lower(t["tag"]).alias("tag"), (t["slash"] == "/").alias("closing"), t["attrs"].alias("attrs"), t["text"].alias("text")),
    )


def _span(attrs: Column, name: str) -> Column:
    """Integer at the start of the attribute, as far as an int goes; NULL if there is none."""
    raw = attribute(F.concat(F.lit("<x "), attrs, F.lit(">")), name)

    def number(digits: Column) -> Column:
        huge = F.length(F.regexp_replace(digits, r"^[+-]?0*", "")) > 9
        return F.when(huge, F.when(digits.startswith("-"), -(2**31)).otherwise(2**31 - 1)).otherwise(digits.try_cast("int"))

    return let(F.nullif(F.regexp_extract(raw, r"^\s*([+-]?[0-9]+)", 1), F.lit("")), number)


def page_tables(pages: DataFrame) -> DataFrame:
    """Outermost tables of each page: ``page_id, table_no, markup``.

    The depth of a table tag is a running sum over the page's own tags, so it
    stays inside the row.
    """

    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        depth = F.when(t["closing"], F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"] + 1)
        opened = F.when(~t["closing"] & (acc["depth"] == 0), t["i"]).otherwise(acc["open"])
        done = t["closing"] & (acc["depth"] == 1)
        spans = F.when(done, F.array_append(acc["spans"], F.struct(acc["open"].alias("a"), t["i"].alias("b")))).otherwise(acc["spans"])
        return F.struct(depth.alias("depth"), opened.alias("open"), spans.alias("spans"))

    tokens = pages.where(F.col("html").rlike("(?i)<table")).select("page_id", _tokens(strip_hidden(F.col("html"))).alias("t"))
    folded = tokens.withColumn("spans", F.aggregate(F.filter("t", lambda t: t["tag"] == "table"), start, step)["spans"])
    # outer: an inner explode would repeat the whole fold as a pushed-down filter
    cut = folded.select("page_id", "t", F.posexplode_outer("spans").alias("table_no", "s")).where("table_no IS NOT NULL")
    body = F.slice("t", F.col("s.a") + 2, F.col("s.b") - F.col("s.a") - 1)
    return cut.select("page_id", "table_no", F.array_join(F.transform(body, lambda t: t["text"]), "").alias("markup"))


def _raw_cells(tables: DataFrame) -> DataFrame:
    """Cells of each table in source order: ``page_id, table_no, cell_no, row, section, group_no, is_header, attrs, text``.

    Tags of nested tables are text of the cell they are in.  What is open at a
    tag (depth, row, section, cell) is a running value over the table's tags.
    """
    t = tables.select("page_id", "table_no", F.explode(_tokens(F.col("markup"))).alias("t")).select("page_id", "table_no", "t.*")
    order = Window.partitionBy("page_id", "table_no").orderBy("i")
    here, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    tag, closing = F.col("tag"), F.col("closing")
    depth = F.coalesce(F.sum(F.when(tag != "table", 0).when(closing, -1).otherwise(1)).over(before), F.lit(0))
    t = t.withColumn("own", (depth <= 0) & ~tag.isin("table", ""))
    own = F.col("own")
    section, cell = own & tag.isin("thead", "tbody", "tfoot"), own & tag.isin("td", "th")
    count = lambda c: F.sum(c.cast("int")).over(here).cast("int")
    state = F.when(cell, ~closing).when(section | (own & (tag == "tr")), F.lit(False))
    t = t.withColumns(
        {
            "row": count(own & (tag == "tr") & ~closing) - 1,
            "section": F.coalesce(F.last(F.when(section, F.when(closing, "").otherwise(tag)), True).over(before), F.lit("")),
            "section_no": count(section),
            "cell_no": count(cell & ~closing),
            "opens": cell & ~closing,
            "adds": ~own & F.coalesce(F.last(state, True).over(before), F.lit(False)),
        }
    )
    opened = F.struct("row", "section", F.when(F.col("section") == "", 0).otherwise(F.col("section_no")).alias("group_no"), (tag == "th").alias("is_header"), "attrs")
    parts = F.sort_array(F.collect_list(F.when(F.col("adds"), F.struct("i", "text"))))
    cells = t.where("opens OR adds").groupBy("page_id", "table_no", "cell_no").agg(
        F.max(F.when(F.col("opens"), opened)).alias("c"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")
    )
    return cells.select("page_id", "table_no", "cell_no", "c.*", "text")


def _placed(cells: DataFrame) -> DataFrame:
    """``cells`` with ``col`` and ``incoming``, taken row by row with the spans that are still open.

    Cells of a table are read in order from a sorted partition; what is held is
    the frontier of open row spans, not the cells.
    """
    ship_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, row, at, nth, incoming = None, None, 0, 0, False
        spans: list[tuple[int, int, int]] = []  # columns [a, b) taken down to a row, by column
        new: list[tuple[int, int, int]] = []
        for batch in batches:
            cols, come = [], []
            for page, no, r, wide, high in zip(*(batch.column(c).to_pylist() for c in ("page_id", "table_no", "row", "colspan", "rowspan")), strict=True):
                if (page, no) != table_:
                    table_, row, spans, new = (page, no), None, [], []
                if r != row:
                    spans = sorted(x for x in spans + new if x[2] >= r)
                    row, at, nth, new, incoming = r, 0, 0, [], bool(spans)
                while nth < len(spans) and spans[nth][0] <= at:
                    at = max(at, spans[nth][1])
                    nth += 1
                cols.append(at)
                come.append(incoming)
                if high > 1:
                    new.append((at, at + wide, r + high - 1))
                at += wide
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols, pa.int32()), pa.array(come, pa.bool_())], [*batch.schema.names, "col", "incoming"])

    made = T.StructType([*cells.schema.fields, T.StructField("col", T.IntegerType()), T.StructField("incoming", T.BooleanType())])
    return cells.repartition("page_id", "table_no").sortWithinPartitions("page_id", "table_no", "cell_no").mapInArrow(run, made)


def table_cells(pages: DataFrame) -> DataFrame:
    """Every cell of every table on its grid.

    ``page_id, table_no, row, col, colspan, rowspan, raw_colspan, raw_rowspan,
    section, is_header, has_block, nested, incoming, text``.  Row spans end
    with their row group, column spans at 1000.  The work is linear in tags
    and cells.
    """
    cells = _raw_cells(page_tables(pages))
    last = Window.partitionBy("page_id", "table_no")
    end = F.when(F.col("group_no") == 0, F.max("row").over(last)).otherwise(F.max("row").over(Window.partitionBy("page_id", "table_no", "group_no")))
    room = end - F.col("row") + 1
    sized = cells.withColumns({"raw_colspan": F.coalesce(_span(F.col("attrs"), "colspan"), F.lit(1)), "raw_rowspan": F.coalesce(_span(F.col("attrs"), "rowspan"), F.lit(1)), "room": room})
    high = F.when(F.col("raw_rowspan") == 0, F.col("room")).when(F.col("raw_rowspan") > 1, F.least("raw_rowspan", "room")).otherwise(1)
    clipped = sized.select(
        "page_id", "table_no", "cell_no", "row", "section", "is_header", "raw_colspan", "raw_rowspan", "text",
        F.least(F.greatest("raw_colspan", F.lit(1)), F.lit(MAX_COLSPAN)).alias("colspan"), high.cast("int").alias("rowspan"),
    )
    return _placed(clipped).select(
        "page_id", "table_no", "row", "col", "colspan", "rowspan", "raw_colspan", "raw_rowspan", "section", "is_header",
        F.col("text").rlike(BLOCK_IN_CELL).alias("has_block"), F.col("text").rlike(r"(?i)<table\b").alias("nested"), "incoming",
        cell_text(F.col("text")).alias("text"),
    )


def cell_text(markup: Column) -> Column:
    """Text of a cell on one line: breaks become ``<br>``, tags go."""
    broken = F.regexp_replace(F.regexp_replace(markup, rf"{WS}+", " "), r"(?i) *(<br\s*/?>|</p>\s*<p[^>]*>|</li>\s*<li[^>]*>) *", "\n")
    plain = F.regexp_replace(broken, r"<[^>]*>", "")
    return F.regexp_replace(trim_ws(decode_entities(plain)), r"[ \t]*\n[ \t\n]*", "<br>")


def _body(cells: DataFrame) -> DataFrame:
    """Cells with ``columns`` of their table and ``part``: leading, body, trailing.

    A banner row has one cell over all columns and nothing reaching in from
    above; banners at either end are no body.  The rows of one table came out
    of one page row.
    """
    table = Window.partitionBy("page_id", "table_no")
    line = Window.partitionBy("page_id", "table_no", "row")
    sized = cells.withColumns(
        {"columns": F.max(F.col("col") + F.col("colspan")).over(table), "_n": F.count("*").over(line)}
    ).withColumn("_banner", (F.col("columns") > 1) & (F.col("_n") == 1) & ~F.col("incoming") & (F.col("colspan") >= F.col("columns")))
    edges = sized.withColumns(
        {
            "_first": F.min(F.when(~F.col("_banner"), F.col("row"))).over(table),
            "_last": F.max(F.when(~F.col("_banner"), F.col("row"))).over(table),
        }
    )
    part = (
        F.when(F.col("_first").isNull() | (F.col("row") < F.col("_first")), "leading")
        .when(F.col("row") > F.col("_last"), "trailing")
        .otherwise("body")
    )
    return edges.withColumn("part", part).drop("_n", "_banner", "_first", "_last")


def _typed(cells: DataFrame) -> DataFrame:
    """Body placement plus ``kind``, ``header`` and counts of the table, per cell.

    All from windows over one table, so the cells are read once.
    """
    table = Window.partitionBy("page_id", "table_no")
    placed = _body(cells)
    body = F.col("part") == "body"
    spanning = (F.col("raw_colspan") > 1) | (F.col("raw_rowspan") > 1) | (F.col("raw_rowspan") == 0)

    def rows(part: str) -> Column:
        return F.size(F.collect_set(F.when(F.col("part") == part, F.col("row"))).over(table))

    first = F.min(F.when(body, F.col("row"))).over(table)
    marked = placed.withColumns(
        {
            "_head": body & (F.col("row") == first),
            "_nested": F.max("nested").over(table),
            "_rich": F.max(body & (spanning | F.col("has_block"))).over(table),
            "_cells": F.count(F.when(body, 1)).over(table),
            "rows": rows("body"),
            "leading": rows("leading"),
            "trailing": rows("trailing"),
        }
    )
    in_head = F.max(F.col("_head") & (F.col("section") == "thead")).over(table)
    plain = F.max(F.col("_head") & ~F.col("is_header")).over(table)
    layout = F.col("_nested") | (F.col("rows") <= 1) | (F.col("_cells") <= 1)
    kind = F.when(layout, "layout").when(F.col("_rich"), "html").otherwise("grid")
    typed = marked.withColumns({"kind": kind, "header": (in_head | ~plain) & (F.col("rows") > 0)})
    return typed.drop("_head", "_nested", "_rich", "_cells")


def table_kinds(cells: DataFrame) -> DataFrame:
    """``layout``, ``html`` or ``grid`` per table, its banners, its header."""
    facts = ["kind", "columns", "rows", "leading", "trailing", "header"]
    one = _typed(cells).groupBy("page_id", "table_no").agg(F.first(F.struct(*facts)).alias("t"))
    return one.select("page_id", "table_no", "t.*")


def table_markdown(cells: DataFrame) -> DataFrame:
    """Grid tables as Markdown: short rows padded, a blank header if none."""
    body = _typed(cells).where("part = 'body' AND kind = 'grid'")
    shown = F.regexp_replace(F.col("text"), r"\|", r"\\|")
    cell = F.when(shown == "", " ").otherwise(shown)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("t")))), lambda x: x["t"])
    rows = body.groupBy("page_id", "table_no", "header", "row").agg(texts.alias("texts"))
    grids = rows.groupBy("page_id", "table_no", "header").agg(
        F.max(F.size("texts")).alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("row", "texts"))), lambda r: r["texts"]).alias("rows")
    )

    def line(texts_: Column) -> Column:
        padding = F.array_repeat(F.lit(" "), F.col("width") - F.size(texts_))
        return F.concat(F.lit("| "), F.array_join(F.concat(texts_, padding), " | "), F.lit(" |"))

    nothing = F.array().cast("array<string>")
    head = F.when(F.col("header"), line(F.get("rows", F.lit(0)))).otherwise(line(nothing))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    rest = F.slice("rows", F.when(F.col("header"), 2).otherwise(1), F.size("rows"))
    return grids.select("page_id", "table_no", F.array_join(F.concat(F.array(head, rule), F.transform(rest, line)), "\n").alias("markdown"))
