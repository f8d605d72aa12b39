"""Translatable units of Markdown documents, and translations put back.

A document is one row and its lines are an array of that row, so cutting,
matching and inserting need no shuffle.  Text the rules do not recognise is
never a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import inline as I
from gleanery.functions.text import let

# How a line opens a block.
_ITEM = r"(?:[ \t]*+(?:[-*+]|[0-9]++[.)])[ \t]++)"
KINDS = {
    "blank": r"^[ \t]*\z",
    "fence": r"^ {0,3}(?:`{3}|~{3})",
    "heading": r"^#{1,6} ",
    "rule": r"^ {0,3}(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)\z",
    "table": r"^[ \t]*\|",
    "html": r"^[ \t]*<(?![A-Za-z][A-Za-z0-9+.-]*:|[^<>\s]+@[^<>\s]+>)",
    "quote": r"^ {0,3}>",
    "list": rf"^{_ITEM}",
}
_FENCE_LINE = rf"^(?:{_ITEM}| {{0,3}}> ?)*+[ \t]*(`{{3,}}+|~{{3,}}+)(.*)\z"
_THREAD_TITLE = r"^# @[A-Za-z0-9_]{1,15} - "
_QUOTE_AUTHOR = r"^\*\*.+\*\*( · .*)?\z"

_SPAN = "struct<a:int,b:int>"


def _kind(line: Column) -> Column:
    out = None
    for name, pattern in KINDS.items():
        out = F.when(line.rlike(pattern), name) if out is None else out.when(line.rlike(pattern), name)
    return out.otherwise("text")


def _opens_block(line: Column) -> Column:
    return ~_kind(line).isin("text", "blank")


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^[ \t]*", 0))


def _facts(text: Column) -> Column:
    """``array<struct<i, line, kind, indent, col>>``; ``col`` is where an item's text starts."""
    return F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(
            i.alias("i"), x.alias("line"), _kind(x).alias("kind"), _indent(x).alias("indent"),
            F.length(F.regexp_extract(x, rf"^{_ITEM}++", 0)).alias("col"),
        ),
    )


def _fences(lines: Column) -> Column:
    """Spans of code fences, those in lists and quotes included.

    Only the fence lines are folded.  A fence ends at its closing line, or
    where its quote ends, or before a line left of its list item's text.
    """

    def mark(x: Column, margin: Column) -> Column:
        in_list = (x["indent"] > 0) & F.coalesce(margin == "list", F.lit(False))
        return F.struct(
            x["i"].alias("i"),
            F.regexp_extract(x["line"], _FENCE_LINE, 1).alias("run"),
            F.regexp_extract(x["line"], _FENCE_LINE, 2).rlike(r"^[ \t]*\z").alias("closer"),
            (x["kind"] == "quote").alias("quoted"),
            F.when(x["kind"] == "list", x["col"]).when(in_list, x["indent"]).otherwise(0).alias("col"),
        )

    def spans(marks: Column) -> Column:
        def end_of(m: Column) -> Column:
            close = F.filter(marks, lambda c: (c["i"] > m["i"]) & c["closer"] & c["run"].startswith(m["run"]))
            last = F.size(lines) - 1
            closing = F.coalesce(F.get(close, F.lit(0))["i"], last)
            # a quote ends with its last quoted line, an item before a line left of its text; only up to the closing line it matters
            inside = F.slice(lines, m["i"] + 2, closing - m["i"])
            left = F.filter(inside, lambda x: (m["quoted"] & (x["kind"] != "quote")) | ((x["kind"] != "blank") & (x["indent"] < m["col"])))
            bound = F.coalesce(F.get(left, F.lit(0))["i"], last + 1)
            return F.least(closing, F.when(closing == bound, bound).otherwise(bound - 1)).cast("int")

        def step(acc: Column, m: Column) -> Column:
            span = lambda e: F.struct(m["i"].alias("a"), e.alias("b"))
            return F.when(m["i"] <= acc["until"], acc).otherwise(
                let(end_of(m), lambda e: F.struct(e.alias("until"), F.array_append(acc["spans"], span(e)).alias("spans")))
            )

        start = F.struct(F.lit(-1).alias("until"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
        return F.aggregate(marks, start, step)["spans"]

    # a fold over the lines at the margin and the fence lines tells each fence line what was at the margin before it
    fence_line = lambda x: x["line"].rlike(_FENCE_LINE)
    at_margin = lambda x: (x["indent"] == 0) & (x["kind"] != "blank")

    def note(acc: Column, x: Column) -> Column:
        made = F.struct(x.alias("x"), acc["margin"].alias("margin"))
        return F.struct(
            F.when(at_margin(x), x["kind"]).otherwise(acc["margin"]).alias("margin"),
            F.when(fence_line(x), F.array_append(acc["marks"], made)).otherwise(acc["marks"]).alias("marks"),
        )

    kind = "struct<i:int,line:string,kind:string,indent:int,col:int>"
    start = F.struct(F.lit(None).cast("string").alias("margin"), F.array().cast(f"array<struct<x:{kind},margin:string>>").alias("marks"))
    noted = F.aggregate(F.filter(lines, lambda x: at_margin(x) | fence_line(x)), start, note)["marks"]
    marks = F.when(F.exists(lines, fence_line), F.transform(noted, lambda n: mark(n["x"], n["margin"])))
    return F.coalesce(let(marks, spans), F.array().cast(f"array<{_SPAN}>"))


def _body_start(lines: Column) -> Column:
    closing = F.get(F.filter(lines, lambda x: (x["i"] > 0) & (x["line"] == "---")), F.lit(0))["i"]
    return F.when((F.get(lines, F.lit(0))["line"] == "---") & closing.isNotNull(), closing + 1).otherwise(0)


def _chunks(lines: Column, fences: Column, body: Column) -> Column:
    """``array<struct<a, b>>``: runs of lines between blanks and fences."""
    written = F.transform(F.filter(lines, lambda x: (x["i"] >= body) & (x["kind"] != "blank")), lambda x: x["i"])
    fenced = F.flatten(F.transform(fences, lambda f: F.sequence(f["a"], f["b"])))

    def edges(solid: Column) -> Column:
        starts = F.filter(solid, lambda i, k: F.coalesce(F.get(solid, k - 1) != i - 1, F.lit(True)))
        ends = F.filter(solid, lambda i, k: F.coalesce(F.get(solid, k + 1) != i + 1, F.lit(True)))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b")))

    return let(F.array_except(written, fenced), edges)


def _blocks(lines: Column, chunk: Column) -> Column:
    """``array<struct<a, b>>``: the blocks of a chunk.

    After the first list item only items open blocks; an HTML line swallows
    the rest of its chunk.
    """
    inside = F.slice(lines, chunk["a"] + 1, chunk["b"] - chunk["a"] + 1)

    def cut(c: Column) -> Column:
        first = lambda kind: F.coalesce(F.get(F.filter(c, lambda x: x["kind"] == kind), F.lit(0))["i"], F.lit(1 << 30))
        item, html = first("list"), first("html")
        last = F.when(html < item, html).otherwise(chunk["b"])

        def opens(x: Column) -> Column:
            above = F.get(lines, x["i"] - 1)["kind"]
            free = (
                x["kind"].isin("heading", "rule", "table", "html")
                | ((x["kind"] == "quote") & (above != "quote"))
                | ((x["kind"] == "text") & above.isin("heading", "rule", "table"))
            )
            return (x["i"] == chunk["a"]) | (x["kind"] == "list") | ((x["i"] < item) & free)

        starts = F.transform(F.filter(c, lambda x: (x["i"] <= last) & opens(x)), lambda x: x["i"])
        return F.transform(
            starts,
            lambda s, n: F.struct(s.alias("a"), (F.coalesce(F.get(starts, n + 1), chunk["b"] + 1) - 1).alias("b")),
        )

    return let(inside, cut)


_UNIT = (
    "struct<kind:string,start:int,end:int,source_lines:array<string>,raws:array<string>,"
    "indent:int,level:int,per_line:boolean,display_title:boolean>"
)


def _none() -> Column:
    return F.array().cast(f"array<{_UNIT}>")


def _unit(kind: str, a: Column, b: Column, source: Column, raws: Column, indent: Column | int = 0, level: Column | int = 0, title: Column | bool = False) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    hard = F.exists(raws, I.hard_break) & F.forall(raws, I.is_balanced) if kind in ("paragraph", "list-item") else F.lit(False)
    return F.struct(
        F.lit(kind).alias("kind"), a.cast("int").alias("start"), b.cast("int").alias("end"), source.alias("source_lines"),
        F.when(hard, raws).otherwise(F.array(F.array_join(raws, "\n"))).alias("raws"),
        lit(indent).cast("int").alias("indent"), lit(level).cast("int").alias("level"), hard.alias("per_line"), lit(title).alias("display_title"),
    )


def _block_units(lines: Column, block: Column, chunk: Column, body: Column, medium: Column) -> Column:
    """Units of one block, before the checks on their words."""
    a, b = block["a"], block["b"]
    rows = F.slice(lines, a + 1, b - a + 1)
    head = F.get(lines, a)
    text = F.transform(rows, lambda x: x["line"])
    after_chunk = F.get(lines, chunk["b"] + 1)["kind"]
    at_end = b == chunk["b"]
    # a list or quote unit needs a blank line, an item or the end after it
    closed = ~at_end | after_chunk.isNull() | (after_chunk == "blank")

    first_line = F.get(F.filter(lines, lambda x: (x["i"] >= body) & (x["kind"] != "blank")), F.lit(0))["i"]
    level = F.length(F.regexp_extract(head["line"], r"^#+", 0))
    thread_title = (medium == "x") & head["line"].rlike(_THREAD_TITLE)
    heading = F.when(
        ~thread_title,
        F.array(_unit("heading", a, a, F.array(head["line"]), F.array(F.regexp_replace(head["line"], r"^#{1,6} ", "")), 0, level, (level == 1) & (a == first_line))),
    ).otherwise(_none())

    def item_units() -> Column:
        col = head["col"]
        content = F.substring(head["line"], col + 1, F.lit(1 << 30))
        rest = F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda x: F.struct(x["indent"].alias("indent"), F.substring(x["line"], col + 1, F.lit(1 << 30)).alias("t")))
        joined = F.forall(rest, lambda r: (r["indent"] >= col) & (r["indent"] < col + 4) & ~_opens_block(r["t"]))
        raws = F.concat(F.array(content), F.transform(rest, lambda r: r["t"]))
        good = closed & joined & ~_opens_block(content)
        return F.when(good, F.array(_unit("list-item", a, b, text, raws, col))).otherwise(_none())

    def quote_units() -> Column:
        quoted = F.filter(rows, lambda x: x["kind"] == "quote")
        bare = F.transform(quoted, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), F.regexp_replace(x["line"], r"^ {0,3}> ?", "").alias("t")))
        lazy = F.size(quoted) < F.size(rows)

        def paragraphs(q: Column) -> Column:
            solid = lambda x: ~x["t"].rlike(r"^[ \t]*\z")
            at = lambda i: F.get(q, (i - a).cast("int"))
            starts = F.filter(q, lambda x: solid(x) & ~F.coalesce(solid(at(x["i"] - 1)), F.lit(False)))
            ends = F.filter(q, lambda x: solid(x) & ~F.coalesce(solid(at(x["i"] + 1)), F.lit(False)))
            spans = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.struct(z["s"]["i"].alias("a"), z["e"]["i"].alias("b")))
            first_item = F.coalesce(F.get(F.filter(q, lambda x: x["t"].rlike(KINDS["list"])), F.lit(0))["i"], F.lit(1 << 30))

            def unit(s: Column) -> Column:
                part = F.slice(q, (s["a"] - a + 1).cast("int"), (s["b"] - s["a"] + 1).cast("int"))
                clean = F.transform(part, lambda x: I.strip_hard_break(F.regexp_replace(x["t"], r"^[ \t]+|[ \t]+\z", "")))
                plain = F.forall(part, lambda x: ~_kind(x["t"]).isin("list", "heading", "fence", "table", "html") & ~x["t"].rlike(r"^[ \t]"))
                author = (medium == "x") & F.array_join(clean, "\n").rlike(_QUOTE_AUTHOR)
                last = F.coalesce(~solid(at(s["b"] + 1)), ~lazy & closed)
                good = plain & ~author & (s["b"] < first_item) & last
                made = _unit("quote-paragraph", s["a"], s["b"], F.transform(part, lambda x: x["line"]), F.array(F.array_join(clean, " ")))
                return F.when(good, made)

            nested = F.exists(q, lambda x: x["t"].rlike(KINDS["quote"]))
            return F.when(nested, _none()).otherwise(F.filter(F.transform(spans, unit), lambda u: u.isNotNull()))

        return let(bare, paragraphs)

    def text_units() -> Column:
        lead = F.coalesce(F.get(F.filter(rows, lambda x: x["indent"] == 0), F.lit(0))["i"], b + 1)
        kept = F.filter(rows, lambda x: x["i"] >= lead)
        raws = F.transform(kept, lambda x: x["line"])
        good = (F.size(kept) > 0) & F.forall(kept, lambda x: x["indent"] == 0)
        paragraph = F.when(good, F.array(_unit("paragraph", lead, b, raws, raws))).otherwise(_none())

        # an indented first line after a blank may continue a list item
        earlier = F.filter(lines, lambda x: (x["i"] < a) & (x["i"] >= body) & (x["kind"] != "blank"))
        reset = F.coalesce(F.try_element_at(F.filter(earlier, lambda x: (x["indent"] == 0) & (x["kind"] != "list")), F.lit(-1))["i"], F.lit(-1))
        items = F.filter(earlier, lambda x: (x["kind"] == "list") & (x["i"] > reset) & (x["col"] <= head["indent"]))
        col = F.try_element_at(items, F.lit(-1))["col"]
        after_blank = F.get(lines, a - 1)["kind"] == "blank"

        def continued(c: Column) -> Column:
            bare = F.transform(rows, lambda x: F.struct(x["indent"].alias("indent"), F.substring(x["line"], c + 1, F.lit(1 << 30)).alias("t")))
            whole = F.forall(bare, lambda r: (r["indent"] >= c) & ~_opens_block(r["t"]))
            made = _unit("list-paragraph", a, b, text, F.transform(bare, lambda r: r["t"]), c)
            return F.when(whole & closed & (head["indent"] < c + 4), F.array(made)).otherwise(_none())

        in_list = (a == chunk["a"]) & (head["indent"] > 0) & F.coalesce(after_blank, F.lit(False)) & col.isNotNull()
        return F.when(head["indent"] == 0, paragraph).when(in_list, let(col, continued)).otherwise(paragraph)

    return (
        F.when(head["kind"] == "heading", heading)
        .when(head["kind"] == "list", item_units())
        .when(head["kind"] == "quote", quote_units())
        .when(head["kind"] == "text", text_units())
        .otherwise(_none())
    )


def _chunk_units(lines: Column, chunk: Column, body: Column, medium: Column) -> Column:
    """Units of a chunk up to the first paragraph that does not hold together."""

    def broken(blk: Column) -> Column:
        rows = F.slice(lines, blk["a"] + 1, blk["b"] - blk["a"] + 1)
        flush = F.filter(rows, lambda x: x["indent"] == 0)
        lead = F.coalesce(F.get(flush, F.lit(0))["i"], F.lit(1 << 30))
        ragged = F.exists(rows, lambda x: (x["i"] > lead) & (x["indent"] > 0))
        whole = I.is_balanced(F.array_join(F.transform(flush, lambda x: x["line"]), "\n"))
        return (F.get(lines, blk["a"])["kind"] == "text") & (ragged | ~whole)

    def units(blocks: Column) -> Column:
        bad = F.coalesce(F.get(F.filter(blocks, broken), F.lit(0))["a"], F.lit(1 << 30))
        return F.flatten(
            F.transform(F.filter(blocks, lambda x: x["a"] < bad), lambda x: _block_units(lines, x, chunk, body, medium))
        )

    return let(_blocks(lines, chunk), units)


def _finish(unit: Column) -> Column:
    """Check the words of a unit and add what is sent to the engine."""
    normal = F.transform(unit["raws"], I.strip_hard_break)
    segs = F.transform(
        normal,
        lambda r: let(
            I.plain_segment(r),
            lambda p: F.struct(r.alias("raw"), p["text"].alias("text"), p["codes"].alias("codes"), (~I.is_link_only(r) & I.has_words(p["text"])).alias("sent")),
        ),
    )

    def build(s: Column) -> Column:
        sent = F.filter(s, lambda x: x["sent"])
        # a paragraph only got here if its lines hold together
        whole = (unit["kind"] == "paragraph") | I.is_balanced(F.array_join(unit["raws"], "\n"))
        good = (F.size(sent) > 0) & (unit["per_line"] | (F.size(sent) == F.size(s))) & whole
        return F.when(
            good,
            F.struct(
                *[unit[n].alias(n) for n in ("kind", "start", "end", "source_lines", "indent", "level", "per_line", "display_title")],
                F.transform(sent, lambda x: x["text"]).alias("segments"),
                F.transform(sent, lambda x: x["codes"]).alias("codes"),
                F.transform(s, lambda x: F.when(~x["sent"], x["raw"])).alias("passthrough"),
            ),
        )

    return let(segs, build)


def units_of(text: Column, medium: Column) -> Column:
    """All units of a document, in order, as an array of structs."""

    def from_lines(lines: Column) -> Column:
        return let(
            F.struct(_fences(lines).alias("fences"), _body_start(lines).alias("body")),
            lambda h: F.filter(
                F.transform(
                    F.flatten(F.transform(_chunks(lines, h["fences"], h["body"]), lambda c: _chunk_units(lines, c, h["body"], medium))), _finish
                ),
                lambda u: u.isNotNull(),
            ),
        )

    return let(_facts(text), from_lines)


def document_units(docs: DataFrame, medium: Column | None = None) -> DataFrame:
    """One row per unit: ``doc_id, unit_no, kind, start, end, …, segments, codes``."""
    found = docs.select("doc_id", F.posexplode(units_of(F.col("text"), medium if medium is not None else F.lit("web"))).alias("unit_no", "u"))
    return found.select("doc_id", "unit_no", "u.*")


# --- putting translations back -------------------------------------------------


def _render(unit: Column, translations: Column, target: Column) -> Column:
    """Lines to insert after a unit; empty if nothing differs, NULL if invalid."""
    made = F.transform(
        F.arrays_zip(translations.alias("t"), unit["segments"].alias("s"), unit["codes"].alias("c")),
        lambda z: I.render_segment(F.coalesce(z["t"], F.lit("")), z["s"], z["c"], target),
    )

    def lay_out(r: Column) -> Column:
        lines = F.transform(r, lambda x: x["line"])
        copied = F.transform(
            F.sequence(F.lit(0), F.size(unit["passthrough"]) - 1),
            lambda i: F.coalesce(
                F.get(unit["passthrough"], i),
                F.get(lines, F.size(F.filter(F.slice(unit["passthrough"], F.lit(1), i), lambda p: p.isNull()))),
            ),
        )
        full = F.when(unit["per_line"], copied).otherwise(lines)
        pad = F.repeat(F.lit(" "), unit["indent"])
        broken = F.transform(full, lambda x, i: F.when(i < F.size(full) - 1, F.concat(x, F.lit("\\"))).otherwise(x))
        first = F.get(broken, F.lit(0))
        laid = (
            F.when(unit["kind"] == "heading", F.array(F.lit(""), F.concat(F.repeat(F.lit("#"), unit["level"]), F.lit(" "), first)))
            .when(unit["kind"] == "list-item", F.transform(broken, lambda x: F.concat(pad, x)))
            .when(unit["kind"] == "list-paragraph", F.array(F.lit(""), F.concat(pad, first)))
            .when(unit["kind"] == "quote-paragraph", F.array(F.lit(">"), F.concat(F.lit("> "), first)))
            .otherwise(F.concat(F.array(F.lit("")), broken))
        )
        invalid = (F.size(r) != F.size(unit["segments"])) | F.exists(r, lambda x: x.isNull())
        same = F.forall(r, lambda x: F.coalesce(x["same"], F.lit(False)))
        return F.when(invalid, F.lit(None).cast("array<string>")).when(same, F.array().cast("array<string>")).otherwise(laid)

    return let(made, lay_out)


_EDIT = "struct<at:int,cut:boolean,lines:array<string>>"


def _place(units: Column, lines: Column, items: Column) -> Column:
    """Match items to the blocks of the current document, forward only."""

    def follows(unit: Column, wanted: Column) -> Column:
        return F.slice(lines, unit["end"] + 2, F.size(wanted)) == wanted

    def same_source(u: Column, source: Column) -> Column:
        broken = lambda x: F.array_append(F.slice(x, F.lit(1), F.size(x) - 1), F.concat(F.element_at(x, -1), F.lit("\\")))
        item = (u["kind"] == "list-item") & ((u["source_lines"] == broken(source)) | (broken(u["source_lines"]) == source))
        return (u["source_lines"] == source) | item

    numbered = F.transform(units, lambda u, k: F.struct(k.alias("k"), u.alias("u")))
    start = F.struct(
        F.lit(0).alias("cursor"), F.lit(0).alias("applied"), F.lit(0).alias("missing"), F.array().cast(f"array<{_EDIT}>").alias("edits")
    )

    def edit(u: Column, wanted: Column) -> Column:
        last = F.get(lines, u["end"])
        with_break = F.when(I.hard_break(last), last).otherwise(F.concat(last, F.lit("\\")))
        item = u["kind"] == "list-item"
        return F.struct(
            F.when(item, u["end"]).otherwise(u["end"] + 1).alias("at"), item.alias("cut"),
            F.when(item, F.concat(F.array(with_break), wanted)).otherwise(wanted).alias("lines"),
        )

    def moved(acc: Column, cursor: Column, applied: Column | int, missing: Column | int, edits: Column) -> Column:
        return F.struct(
            cursor.cast("int").alias("cursor"), (acc["applied"] + applied).cast("int").alias("applied"),
            (acc["missing"] + missing).cast("int").alias("missing"), edits.alias("edits"),
        )

    def step(acc: Column, item: Column) -> Column:
        unit, wanted = item["unit"], item["lines"]
        titles = F.filter(units, lambda u: u["display_title"])
        shown = F.get(titles, F.lit(0))
        retitle = shown.isNotNull() & (F.size(wanted) > 0) & F.coalesce(same_source(shown, unit["source_lines"]) & ~follows(shown, wanted), F.lit(False))
        for_title = moved(acc, acc["cursor"], 1, 0, F.when(retitle, F.array_append(acc["edits"], edit(shown, wanted))).otherwise(acc["edits"]))
        alike = F.filter(
            numbered,
            lambda c: (c["k"] >= acc["cursor"]) & (c["u"]["kind"] == unit["kind"]) & ~c["u"]["display_title"] & same_source(c["u"], unit["source_lines"]),
        )

        def choose(c: Column) -> Column:
            free = F.get(F.filter(c, lambda x: ~follows(x["u"], wanted)), F.lit(0))
            done = F.get(c, F.lit(0))
            return (
                F.when(free.isNotNull(), moved(acc, free["k"] + 1, 1, 0, F.array_append(acc["edits"], edit(free["u"], wanted))))
                .when(done.isNotNull(), moved(acc, done["k"] + 1, 1, 0, acc["edits"]))
                .otherwise(moved(acc, acc["cursor"], 0, 1, acc["edits"]))
            )

        return (
            F.when(wanted.isNull(), moved(acc, acc["cursor"], 0, 1, acc["edits"]))
            .when(unit["display_title"], for_title)
            .otherwise(let(alike, choose))
        )

    return F.aggregate(items, start, step)


def _write(lines: Column, edits: Column) -> Column:
    """Lines with the edits made: text inserted at a line goes before it."""

    def at(i: Column, cut: bool) -> Column:
        return F.flatten(F.transform(F.filter(edits, lambda e: (e["at"] == i) & (e["cut"] == F.lit(cut))), lambda e: e["lines"]))

    marked = F.transform(edits, lambda e: e["at"])
    rows = F.transform(
        F.array_append(lines, F.lit(None).cast("string")),
        lambda x, i: F.when(
            F.array_contains(marked, i),
            F.concat(at(i, False), F.when(F.size(at(i, True)) > 0, at(i, True)).when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x))),
        )
        .when(x.isNull(), F.array().cast("array<string>"))
        .otherwise(F.array(x)),
    )
    return F.array_join(F.flatten(rows), "\n")


def interleave_translations(docs: DataFrame, units: DataFrame, target: Column, medium: Column | None = None) -> DataFrame:
    """Documents with the translated lines after each unit.

    ``docs``: ``doc_id, text`` as they are now; ``units``: rows of
    :func:`document_units`, maybe of an earlier text, with ``translations``.
    Only the units of one document meet, which came out of one row.
    """
    names = [c for c in units.columns if c not in ("doc_id", "unit_no", "translations")]
    item = units.select("doc_id", "unit_no", F.struct(*names).alias("unit"), "translations")
    rendered = item.withColumn("lines", _render(F.col("unit"), F.col("translations"), target))
    items = F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "unit", "lines"))), lambda x: F.struct(x["unit"].alias("unit"), x["lines"].alias("lines")))
    lists = rendered.groupBy("doc_id").agg(items.alias("items"))
    joined = docs.join(lists, "doc_id", "left").withColumn("_lines", F.split("text", "\n"))
    now = units_of(F.col("text"), medium if medium is not None else F.lit("web"))
    matched = joined.withColumn("m", F.when(F.col("items").isNotNull(), let(now, lambda u: _place(u, F.col("_lines"), F.col("items")))))
    return matched.select(
        "doc_id",
        F.when(F.size("m.edits") > 0, _write(F.col("_lines"), F.col("m.edits"))).otherwise(F.col("text")).alias("document"),
        F.coalesce("m.applied", F.lit(0)).alias("applied"),
        F.coalesce("m.missing", F.lit(0)).alias("missing"),
    )
