"""File names: clean base name, comparison key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import WS, collapse, let, trim_ws
from gleanery.functions.urls import split_ext

MAX_POINTS = 60
UNTITLED = "Untitled"


def base_name(title: Column) -> Column:
    """Title as a file name: illegal characters, spaces, leading dots, length."""
    clean = F.regexp_replace(title, r'[/\\:*?"<>|\p{Cc}]', "-")
    bare = trim_ws(F.regexp_replace(collapse(clean), rf"^\.+{WS}*", ""))
    return let(
        bare,
        lambda n: F.when(n == "", UNTITLED)
        .when(F.length(n) > MAX_POINTS, F.concat(F.substring(n, 1, MAX_POINTS - 1), F.lit("…")))
        .otherwise(n),
    )


def media_base_name(page_title: Column, file_name: Column) -> Column:
    """``title - stem``; only one of them if the other is empty or equal."""
    title, name = trim_ws(page_title), trim_ws(file_name)
    stem, _ = split_ext(name)
    return base_name(
        F.when(stem == "", title)
        .when((title == "") | (title == name) | (title == stem), stem)
        .otherwise(F.concat(title, F.lit(" - "), stem))
    )


def name_key(name: Column) -> Column:
    """Names with equal keys are one file: case and composition are ignored."""
    return F.collate(F.lower(name), "UNICODE")


def same_name(a: Column, b: Column) -> Column:
    return name_key(a) == name_key(b)
