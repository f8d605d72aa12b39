from pyspark.sql import functions as F

from gleanery.operators.units import document_units, interleave_translations

DOC = """---
title: "x"
---
# Main *title*

First line of text
goes on here.

- item one
  continues
- item `code` two

  second paragraph of two

> Quoted words
> go on.
>
> More words

```
# not a heading
```

| a | b |
| - | - |

<div>
html text
</div>

[only a link](http://a.b/c)

12345

Hard\\
break

unbalanced ** here
## Sub
"""


def units(spark, text, medium="web"):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return document_units(df, F.lit(medium)).orderBy("unit_no").collect()


def test_kinds_and_lines(spark):
    got = [(u.kind, u.start, u.end, list(u.segments)) for u in units(spark, DOC)]
    assert got == [
        ("heading", 3, 3, ["Main title"]),
        ("paragraph", 5, 6, ["First line of text goes on here."]),
        ("list-item", 8, 9, ["item one continues"]),
        ("list-item", 10, 10, ["item ⟦c1⟧ two"]),
        ("list-paragraph", 12, 12, ["second paragraph of two"]),
        ("quote-paragraph", 14, 15, ["Quoted words go on."]),
        ("quote-paragraph", 17, 17, ["More words"]),
        ("paragraph", 34, 35, ["Hard", "break"]),
    ]


def test_codes_and_title_flag(spark):
    found = units(spark, DOC)
    assert found[0].display_title and not found[1].display_title
    assert [list(c) for c in found[3].codes] == [["`code`"]]


def test_thread_rules(spark):
    text = "# @me - hello\n\n> **Name (@n)** · 2024-01-01\n>\n> said this\n"
    assert [u.kind for u in units(spark, text, "x")] == ["quote-paragraph"]


def test_lazy_lines_reject(spark):
    text = "- item\nlazy line\n\n> quote\nlazy line\n\ntext\n  indented\n"
    assert units(spark, text) == []


def test_interleave(spark):
    df = spark.createDataFrame([(1, DOC)], "doc_id bigint, text string")
    found = document_units(df).withColumn("translations", F.transform("segments", F.upper))
    row = interleave_translations(df, found, F.lit("en")).first()
    assert (row.applied, row.missing) == (8, 0)
    assert "# Main *title*\n\n# MAIN TITLE\n\nFirst line" in row.document
    assert "- item one\n  continues\\\n  ITEM ONE CONTINUES\n- item `code` two\\\n  ITEM `code` TWO\n\n  second" in row.document
    assert "  second paragraph of two\n\n  SECOND PARAGRAPH OF TWO\n" in row.document
    assert "> Quoted words\n> go on.\n>\n> QUOTED WORDS GO ON.\n>\n> More words\n>\n> MORE WORDS\n" in row.document
    assert "Hard\\\nbreak\n\nHARD\\\nBREAK\n" in row.document
    # a second run finds every block already followed by its translation
    done = spark.createDataFrame([(1, row.document)], "doc_id bigint, text string")
    again = interleave_translations(done, found, F.lit("en")).first()
    # (an item and its translation now read as one longer item, which is not the old one)
    assert again.document == row.document and (again.applied, again.missing) == (6, 2)


def test_changed_document(spark):
    old = spark.createDataFrame([(1, "one\n\ntwo\n\none")], "doc_id bigint, text string")
    new = spark.createDataFrame([(1, "zero\n\none\n\none\n\nthree")], "doc_id bigint, text string")
    found = document_units(old).withColumn("translations", F.transform("segments", lambda s: F.concat(s, F.lit("!"))))
    row = interleave_translations(new, found, F.lit("en")).first()
    assert row.document == "zero\n\none\n\none!\n\none\n\none!\n\nthree"
    assert (row.applied, row.missing) == (2, 1)


def test_fences(spark):
    text = "- item\n\n  ```\n  code here\n  ```\n\n  after it\n\n> ~~~\n> code\n\nplain words\n\n````\n```\ncode\n````\nend words\n"
    got = [(u.kind, list(u.segments)) for u in units(spark, text)]
    assert got == [("list-item", ["item"]), ("list-paragraph", ["after it"]), ("paragraph", ["plain words"]), ("paragraph", ["end words"])]


def test_item_before_a_fence_is_no_unit(spark):
    assert units(spark, "- item\n```\ncode\n```\n") == []
