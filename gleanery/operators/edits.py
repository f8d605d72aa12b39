"""Edits of stored records, three-way merge, library reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.names import base_name, same_name
from gleanery.operators.media import EXT_KIND

FIELDS = ["title", "tags", "note"]


def is_media(medium: Column, file: Column) -> Column:
    """A media record: a media kind whose file is not a document."""
    return medium.isin(list(EXT_KIND)) & ~F.lower(file).endswith(".md")


def apply_edits(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Records with the edits that are present and differ applied.

    ``clips``: ``id, file_id, file, medium, title, tags, note`` as stored;
    ``edits``: ``id`` and a column per field, NULL where not edited.  Media
    records keep their title.  A file that carries another id rejects the
    edit.  ``rename`` is the new base name a changed title asks for.
    """
    wanted = edits.select("id", F.lit(True).alias("_edit"), *[F.col(f).alias(f"_{f}") for f in FIELDS])
    joined = clips.join(wanted, "id", "left")
    rejected = F.coalesce("_edit", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("file_id"))
    media = is_media(F.col("medium"), F.col("file"))

    def differs(field: str) -> Column:
        present = F.col(f"_{field}").isNotNull() & ~rejected
        if field == "title":
            present = present & ~media
        return present & ~F.col(f"_{field}").eqNullSafe(F.col(field))

    flagged = joined.withColumns({f"_d_{f}": differs(f) for f in FIELDS}).withColumn("_rejected", rejected)
    changed = F.filter(F.array(*[F.when(F.col(f"_d_{f}"), F.lit(f)) for f in FIELDS]), lambda f: f.isNotNull())
    base = base_name(F.col("_title"))
    renamed = F.col("_d_title") & ~same_name(F.concat(base, F.lit(".md")), F.col("file"))
    return flagged.select(
        "id",
        *[F.when(F.col(f"_d_{f}"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in FIELDS],
        changed.alias("changed"),
        F.when(F.col("_rejected"), "rejected").when(F.size(changed) > 0, "changed").otherwise("unchanged").alias("status"),
        F.when(renamed, base).alias("rename"),
    )


def merge_edits(base: DataFrame, local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records with the fields changed locally against the base kept."""

    def prefixed(df: DataFrame, p: str) -> DataFrame:
        return df.select("id", F.lit(True).alias(p), *[F.col(f).alias(f"{p}_{f}") for f in FIELDS])

    joined = incoming.join(prefixed(base, "b"), "id", "left").join(prefixed(local, "l"), "id", "left")
    both = F.coalesce(F.col("b") & F.col("l"), F.lit(False))

    def pick(f: str) -> Column:
        mine = both & F.col(f"l_{f}").isNotNull() & ~F.col(f"l_{f}").eqNullSafe(F.col(f"b_{f}"))
        return F.when(mine, F.col(f"l_{f}")).otherwise(F.col(f)).alias(f)

    return joined.select("id", *[pick(f) for f in FIELDS])


def reconcile_library(index: DataFrame, files: DataFrame) -> DataFrame:
    """Each record against the file at its path, and files without a record.

    ``index``: ``path, id, title, tags``; ``files``: the same as read back.
    """
    left = index.select("path", *[F.col(c).alias(f"i_{c}") for c in ("id", "title", "tags")], F.lit(1).alias("i"))
    right = files.select("path", *[F.col(c).alias(f"f_{c}") for c in ("id", "title", "tags")], F.lit(1).alias("f"))
    both = left.join(right, "path", "full")
    same = F.col("i_title").eqNullSafe(F.col("f_title")) & F.col("i_tags").eqNullSafe(F.col("f_tags"))
    status = (
        F.when(F.col("f").isNull(), "missing")
        .when(F.col("i").isNull(), "orphan")
        .when(~F.col("i_id").eqNullSafe(F.col("f_id")), "replaced")
        .when(~same, "stale")
        .otherwise("ok")
    )
    return both.select("path", F.coalesce("i_id", "f_id").alias("id"), status.alias("status"))
