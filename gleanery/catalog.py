"""Every registered query: ``name -> function(spark, folder) -> DataFrame``."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import derive
from gleanery.functions.engines import ReversingEngine
from gleanery.functions.language import pick_target
from gleanery.functions.names import base_name
from gleanery.functions.urls import canonical
from gleanery.operators import chunks, documents, edits, headers, images, lookups, media, quotes, routing, sites, stores, tags, threads, translation, units, videos
from gleanery.operators import pages as P
from gleanery.operators import tables as html_tables
from gleanery.operators.merge import thread_merge
from gleanery.operators.names import unique_names
from gleanery.plans.flagship import site_report
from gleanery.session import checkpoint_dir, scratch_path
from gleanery.sources import writers
from gleanery.sources.readers import read_assets, read_captures, read_clip_library, read_library_files, read_sidecars, stream_captures, table
from gleanery.streaming import jobs, stateful
from gleanery.streaming.run import drain, drain_to_end, event_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


@query("flagship_site_report")
def _flagship(spark, d):
    return site_report(table(spark, d, "pages"))


@query("s1_read_captures")
def _s1(spark, d):
    return read_captures(spark, d).select("page_id", "url", "html", "kind", "title", "markdown")


@query("p1_canonical_sources")
def _p1(spark, d):
    return P.canonical_sources(table(spark, d, "pages"))


@query("p1_any_scheme")
def _p1s(spark, d):
    return derive.scheme_addresses(spark, d).select("page_id", "pos", canonical(F.col("url")).alias("source"))


@query("p2_page_meta")
def _p2(spark, d):
    return P.page_meta(table(spark, d, "pages"))


@query("p2_page_meta_tags")
def _p2m(spark, d):
    return P.page_meta(derive.meta_pages(spark, d))


@query("p3_page_links")
def _p3(spark, d):
    return P.page_links(table(spark, d, "pages"))


@query("p4_text_gate")
def _p4(spark, d):
    return P.text_gate(table(spark, d, "pages"))


# --- saved records, queues and lookups over the event table -----------------
# An event is a save operation: its key is a user and the number in its props.


def saves_of(spark, d):
    """Events as save operations: ``id, source, ts`` and what kind they are."""
    number = F.regexp_extract("props", r'"k": *(\d+)', 1)
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), number).alias("source"),
        "ts",
        "user_id",
        "event_type",
        "value",
    )


def index_of(spark, d):
    """Records saved before the batch: the newest sign-up per key."""
    saved = saves_of(spark, d).where("event_type = 'signup'")
    entries = saved.select("source", F.col("ts").alias("saved_at"), "id", F.col("event_type").alias("title"))
    return stores.latest_per_source(entries)


def captures_of(spark, d):
    """The batch: every other event; purchases are snapshots, errors quotes."""
    return saves_of(spark, d).where("event_type <> 'signup'").select(
        "id",
        "source",
        "ts",
        (F.col("event_type") == "purchase").alias("snapshot"),
        (F.col("event_type") == "error").alias("quote"),
        F.when(F.col("value") < 2, "fallback").otherwise("full").alias("extract"),
    )


def day(column="ts"):
    return F.date_trunc("day", F.col(column))


@query("j1_saved_lookup")
def _j1(spark, d):
    index = index_of(spark, d).select("source", F.col("id").alias("saved_id"))
    return lookups.saved_lookup(captures_of(spark, d), index)


@query("j1_index_keys")
def _j1k(spark, d):
    pages = table(spark, d, "pages")
    kind = F.element_at(F.array(F.lit("quote"), F.lit("media"), F.lit("page")), (F.col("page_id") % 3 + 1).cast("int"))
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("#part"))).otherwise(F.concat(F.lit("data:text/plain,"), F.col("page_id").cast("string"), F.lit("%20x")))
    return pages.select("page_id", kind.alias("kind"), lookups.index_key(kind, F.col("url"), media.media_key(url)).alias("key"))


@query("j2_new_captures")
def _j2a(spark, d):
    return lookups.new_captures(captures_of(spark, d), index_of(spark, d)).select("id", "source")


@query("j2_known_captures")
def _j2b(spark, d):
    return lookups.known_captures(captures_of(spark, d), index_of(spark, d)).select("id", "source")


@query("j12_take_within_ttl")
def _j12(spark, d):
    # the table has one event per user and hour or so: a two-hour lifetime
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "event_type")
    requests = events.where("event_type = 'click'").drop("event_type")
    opens = events.where("event_type = 'view'").drop("event_type")
    return lookups.take_within_ttl(requests, opens, ttl=7200)


@query("w1_latest_per_source")
def _w1(spark, d):
    saves = saves_of(spark, d).select("source", F.col("ts").alias("saved_at"), "id", F.col("event_type").alias("title"), "value")
    patches = saves_of(spark, d).where("event_type = 'error'").select(
        "source", "id", F.col("ts").alias("patched_at"), F.lit("patched").alias("title")
    )
    return stores.latest_per_source(saves, patches)


@query("w5_retain_last")
def _w5(spark, d):
    ops = saves_of(spark, d).select("user_id", "source", "ts", "id")
    return stores.retain_last(ops, "user_id", "source", ["ts", "id"], stores.LIMITS["pending"])


@query("t2_recent_clips")
def _t2(spark, d):
    return stores.recent_clips(index_of(spark, d))


@query("t3_pending_head")
def _t3(spark, d):
    return stores.pending_head(saves_of(spark, d).where("event_type = 'error'").select("id", "source", "ts"))


@query("u1_locate_clips")
def _u1(spark, d):
    saves = saves_of(spark, d)

    def store(kind, label):
        newest = saves.where(F.col("event_type") == kind).groupBy(F.col("source").alias("id")).agg(F.max("ts").alias("saved_at"))
        return newest.select("id", F.lit(label).alias("found_in"), "saved_at")

    ids = saves.where("value > 20").select(F.col("source").alias("id"))
    found = stores.locate_clips(ids, store("view", "recent"), store("error", "quotes"), store("click", "ops"), store("signup", "index"))
    return found.select("id", "found_in", "saved_at")


def queue_and_outcomes(spark, d):
    saves = saves_of(spark, d)
    state = (
        F.when(F.col("event_type") == "purchase", "saved")
        .when(F.col("event_type") == "view", "fallback")
        .when(F.col("event_type") == "click", "duplicate")
        .otherwise("failed")
    )
    return saves.select("user_id", "event_type"), saves.where("value >= 5").select("user_id", "event_type", state.alias("state"))


@query("u2_pending_minus_done")
def _u2(spark, d):
    return stores.pending_minus_done(*queue_and_outcomes(spark, d))


@query("a8_outcome_counts")
def _a8(spark, d):
    return stores.outcome_counts(queue_and_outcomes(spark, d)[1])


@query("u3_id_overlap")
def _u3(spark, d):
    # the language in the address against the languages the page declares
    pages = table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("wanted"),
        F.regexp_extract_all("html", F.lit('lang="([a-z]+)"'), 1).alias("found"),
    )
    return stores.id_overlap(pages, F.col("wanted"), F.col("found")).select("page_id", "wanted")


@query("a1_tag_counts")
def _a1(spark, d):
    clips = table(spark, d, "part").select(F.split("p_name", " ").alias("tags"))
    return tags.tag_counts(clips, limit=None)


@query("a1_tag_counts_prefix")
def _a1p(spark, d):
    clips = table(spark, d, "part").select(F.split("p_name", " ").alias("tags"))
    return tags.tag_counts(clips, prefix="s", limit=8)


@query("t1_top_tags")
def _t1(spark, d):
    clips = table(spark, d, "part").select(F.split("p_name", " ").alias("tags"))
    return tags.top_tags(tags.tag_counts(clips, limit=None))


@query("a6_distinct_tags")
def _a6(spark, d):
    parts = table(spark, d, "part")
    padded = F.array(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), F.col("p_brand"), F.lit(" "), F.lower("p_type"), F.col("p_type"))
    return tags.distinct_tags(parts.select(F.col("p_partkey").alias("id"), F.concat(padded, F.split("p_name", " ")).alias("tags")))


# --- routing, media, sites ---------------------------------------------------


@query("p5_classify_captures")
def _p5(spark, d):
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    kind = (
        F.when(F.col("event_type") == "click", "link").when(F.col("event_type") == "signup", "media")
        .when(F.col("event_type") == "error", "quote").when(F.col("event_type") == "purchase", "stream").otherwise("page")
    )
    rich = F.col("value") > 3
    captures = table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        kind.alias("kind"),
        F.when(F.col("value") > 1, F.lit("text")).alias("markdown"),
        (F.col("value") > 5).alias("fetched"),
        F.when(k < 50, F.struct(F.when(k < 20, F.struct(F.lit(True).alias("limit"))).alias("partial"))).alias("x"),
        F.when(rich, F.struct(F.lit("image").alias("kind"))).alias("media"),
        F.when(rich, F.struct(F.lit("x").alias("platform"))).alias("stream"),
        F.when(rich, F.struct(F.lit("q").alias("markdown"))).alias("quote"),
    )
    return routing.classify_captures(captures).select("id", "kind", "medium", "extract")


@query("p6_route_pages")
def _p6a(spark, d):
    links = derive.platform_links(spark, d)
    typed = F.when(F.col("pos") == 0, "application/pdf").when(F.col("pos") == 3, "text/html; charset=utf-8").otherwise("")
    return routing.route_pages(links.select((F.col("page_id") * 100 + F.col("pos")).alias("id"), "url", typed.alias("content_type")))


@query("p6_route_items")
def _p6b(spark, d):
    links = derive.platform_links(spark, d)
    kind = F.when(F.col("page_id") < F.col("pos") * 20, "image").when(F.col("pos") < 5, "audio").otherwise("video")
    src = F.when(F.length("url") < 45, F.col("url")).when(F.length("url") < 50, F.lit("blob:x")).otherwise(F.lit(""))
    items = links.select(
        (F.col("page_id") * 100 + F.col("pos")).alias("id"), kind.alias("kind"), src.alias("src"), F.col("url").alias("page_url"),
        F.concat(F.lit("https://youtu.be/"), F.substring(F.md5("url"), 1, 11)).alias("frame_url"),
    )
    return routing.route_items(items)


@query("p7_stream_links")
def _p7(spark, d):
    return routing.stream_links(derive.platform_links(spark, d)).drop("url")


@query("p9_direct_or_stream")
def _p9(spark, d):
    return media.direct_or_stream(derive.media_items(spark, d))


@query("j3_media_kinds")
def _j3(spark, d):
    return media.media_kinds(derive.media_items(spark, d))


@query("j3_header_names")
def _j3h(spark, d):
    items = derive.headed_items(spark, d)
    names = items.select("id", media.disposition_name(F.coalesce("content_disposition", F.lit(""))).alias("name"))
    return media.media_kinds(items).join(names, "id")


@query("j4_image_types")
def _j4(spark, d):
    return media.image_types(derive.media_items(spark, d))


@query("j5_same_site_links")
def _j5(spark, d):
    return sites.same_site_links(derive.page_targets(spark, d), sites.default_suffixes(spark))


@query("a7_distinct_media")
def _a7(spark, d):
    return media.distinct_media(derive.inline_media(spark, d))


# --- images, documents, chunks ----------------------------------------------


@query("w2_plan_images")
def _w2(spark, d):
    return images.plan_images(derive.image_documents(spark, d))


def downloads_of(docs):
    """The plan as if every address of an even length had been fetched."""
    plan = images.plan_images(docs)
    return plan.withColumn("ext", F.when(F.length("url") % 2 == 0, "png"))


@query("j7_rewrite_images")
def _j7(spark, d):
    docs = derive.image_documents(spark, d)
    return images.rewrite_images(docs, downloads_of(docs))


@query("a4_image_stats")
def _a4(spark, d):
    lines = table(spark, d, "lineitem")
    return media.image_stats(lines.select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") != "R").alias("saved")))


@query("w7_admit_by_budget")
def _w7(spark, d):
    # several lines of an order may carry one number: position is number and part
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("record"),
        (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey")).alias("pos"),
        F.col("l_quantity").alias("size"),
    )
    return images.admit_by_budget(items, per_item=45, total=100)


@query("w7_admit_long_records")
def _w7l(spark, d):
    # what the parts of a supplier's number range have in their orders: records of thousands of items, sizes of tenths
    items = table(spark, d, "lineitem").select(
        F.pmod("l_suppkey", F.lit(3)).alias("record"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), ((F.col("l_partkey") * 37 + F.col("l_orderkey")) % 1000 / 10).alias("size")
    )
    return images.admit_by_budget(items.groupBy("record", "pos").agg(F.max("size").alias("size")), per_item=97.5, total=25000.7)


@query("p10_clip_documents")
def _p10(spark, d):
    return documents.clip_documents(derive.stored_documents(spark, d))


@query("p11_plain_text")
def _p11(spark, d):
    return documents.plain_texts(table(spark, d, "documents"))


@query("x1_chunk_documents")
def _x1(spark, d):
    return chunks.chunk_documents(table(spark, d, "documents"))


@query("x2_join_chunks")
def _x2(spark, d):
    docs = table(spark, d, "documents")
    cut = docs.select("doc_id", "lang", F.posexplode(chunks.pieces_of(F.col("text"))).alias("chunk_no", "text"))
    return chunks.join_chunks(cut, F.when(F.col("lang") == "de", "ja").otherwise(F.col("lang")))


# --- threads, quotes, edits --------------------------------------------------


@query("w3_thread_ranges")
def _w3(spark, d):
    return threads.thread_ranges(derive.posts(spark, d), derive.focal_posts(spark, d))


@query("a3_thread_documents")
def _a3(spark, d):
    return threads.thread_documents(derive.posts(spark, d), derive.focal_posts(spark, d))


@query("j6_resolve_short_links")
def _j6(spark, d):
    return threads.resolve_short_links(*derive.link_parts(spark, d))


@query("p12_post_videos")
def _p12(spark, d):
    asked = derive.posts(spark, d).withColumns({"page_url": F.concat("url", F.lit("/video/7")), "in_quote": F.col("quote").isNotNull()})
    return threads.post_videos(asked)


@query("w6_thread_merge")
def _w6(spark, d):
    return thread_merge(derive.snapshots(spark, d))


@query("w6_thread_merge_chain")
def _w6c(spark, d):
    return thread_merge(derive.chained_snapshots(spark, d))


@query("w4_quote_anchors")
def _w4(spark, d):
    return quotes.quote_anchors(derive.quotes(spark, d)).select("id", "anchor")


@query("w4_fragment_urls")
def _w4f(spark, d):
    turns = table(spark, d, "conversations")
    words = turns.select("conv_id", "turn", F.concat(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1), F.array(F.lit("one"), F.lit("two"), F.lit("three"))).alias("w"))
    at = lambda i: F.get("w", F.lit(i))
    form = F.col("turn") % 3
    page = F.concat(F.lit("https://q.example.com/"), F.col("conv_id").cast("string"), F.when(form == 0, "#top").when(form == 1, "#a:~:text=old").otherwise(""))
    end = F.when(form != 1, F.array_join("w", " "))
    return words.select(
        "conv_id", "turn", quotes.fragment_url(page, F.concat(at(0), F.lit(", "), at(1), F.lit("-")), end, F.when(form == 2, at(2)), F.when(form == 0, at(2))).alias("url")
    )


@query("a2_quote_entries")
def _a2e(spark, d):
    found = quotes.collect_quotes(derive.quotes(spark, d))
    return found.select("source", "part", quotes.count_entries(F.col("document")).alias("found"))


@query("a2_collect_quotes")
def _a2(spark, d):
    return quotes.collect_quotes(derive.quotes(spark, d))


@query("a2_quote_notes")
def _a2n(spark, d):
    # a note under each anchor line: write it, then read it back
    q = quotes.quote_anchors(derive.quotes(spark, d))
    doc = F.concat(quotes.entry_text(F.col("markdown"), F.col("anchor")), F.lit("\n\n> next\n\nnext anchor\n"))
    written = quotes.replace_quote_notes(q.select("id", doc.alias("document"), "anchor", F.col("title").alias("note")))
    return quotes.quote_notes(written.select("id", "document", "anchor"))


@query("j11_quote_targets")
def _j11(spark, d):
    q = derive.quotes(spark, d).select("id", "source")
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    source = F.concat(F.lit("https://q.example.com/"), F.col("conv_id").cast("string"))
    index = pages.where("n > 1").select(source.alias("source"), F.concat(F.lit("Quotes "), F.col("conv_id").cast("string"), F.lit(".md")).alias("file"), F.col("conv_id").alias("file_id"))
    files = pages.where("n > 2").select(
        F.concat(F.lit("QUOTES "), F.col("conv_id").cast("string"), F.lit(".md")).alias("file"),
        F.when(F.col("n") == 3, -1).otherwise(F.col("conv_id")).alias("id"),
    )
    return quotes.quote_targets(q, index, files)


@query("j8_apply_edits")
def _j8(spark, d):
    return edits.apply_edits(derive.clip_records(spark, d), derive.clip_edits(spark, d))


@query("j9_merge_edits")
def _j9(spark, d):
    base = derive.clip_records(spark, d).select("id", "title", "tags", "note")
    incoming = base.withColumns({"note": F.lit("incoming"), "title": F.concat(F.lit("In "), F.col("id"))})
    change = derive.clip_edits(spark, d).select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "tags", "note")])
    local = base.join(change, "id").select("id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("title", "tags", "note")])
    return edits.merge_edits(base, local, incoming)


@query("j10_reconcile_library")
def _j10(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    index = docs.where("lang <> 'es'").select(path.alias("path"), F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.array("lang", "source").alias("tags"))
    files = docs.where("n_chars > 500").select(
        path.alias("path"),
        F.when(F.col("n_chars") < 700, -1).otherwise(F.col("doc_id")).alias("id"),
        F.when(F.col("n_chars") < 1500, "renamed").otherwise(F.col("lang")).alias("title"),
        F.when(F.col("n_chars") > 5000, F.array("source", "lang")).otherwise(F.array("lang", "source")).alias("tags"),
    )
    return edits.reconcile_library(index, files)


# --- names, sinks, streams -----------------------------------------------------


@query("w8_clean_names")
def _w8a(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", base_name(F.col("text")).alias("base"))


@query("w8_unique_names")
def _w8b(spark, d):
    parts = table(spark, d, "part")
    clips = parts.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), base_name(F.col("p_name")).alias("base"))
    taken = parts.where("p_size = 1").select(F.concat(F.upper("p_name"), F.lit(".md")).alias("file")).distinct()
    return unique_names(clips, taken)


@query("w8_contested_names")
def _w8c(spark, d):
    return unique_names(*derive.contested_clips(spark, d))


@query("s4_write_clips")
def _s4(spark, d):
    records = derive.stored_documents(spark, d)
    path = scratch_path(spark, "clips")
    body = documents.clip_documents(records).select(F.concat("id", F.lit(".md")).alias("file"), "document")
    attached = records.select("id", F.lit(1).alias("index"), F.lit("txt").alias("ext"), F.encode("body", "UTF-8").alias("content"))
    writers.write_library(path, body, attached, records.select("id", "source", "medium", "tags"))
    back = read_library_files(spark, path).select(F.regexp_replace("path", r"\.md$", "").alias("id"), F.col("value").alias("document"))
    files = read_assets(spark, path).select("id", F.concat("index", F.lit("."), "ext").alias("attached"), F.sha2("content", 256).alias("sha256"))
    # what tasks list and read looks small to the planner, which would send all of it to the driver
    return spark.read.parquet(f"{path}/.index").join(back.hint("merge"), "id").join(files.hint("merge"), "id", "left")


def sidecars_of(spark, d):
    items = derive.media_items(spark, d)
    text = {"file": "file_name", "source": "page_url", "media_url": "url", "medium": "kind", "mime": "content_type"}
    columns = [F.col(v).alias(k) for k, v in text.items()]
    return items.select(
        F.col("id").cast("string").alias("id"), *columns, F.lit("Title").alias("title"), F.lit("cdn.example.com").alias("site"),
        F.lit("2024-01-01T00:00:00.000Z").alias("captured"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.array("kind").alias("tags"), F.lit("").alias("note"),
    )


@query("s5_sidecar_json")
def _s5(spark, d):
    return writers.sidecar_json(sidecars_of(spark, d))


@query("s3_read_sidecars")
def _s3(spark, d):
    path = scratch_path(spark, "sidecars")
    writers.write_sidecars(sidecars_of(spark, d), path)
    return read_sidecars(spark, path)


@query("s2_read_clip_library")
def _s2(spark, d):
    path = scratch_path(spark, "library")
    stored = documents.clip_documents(derive.stored_documents(spark, d))
    writers.write_library(path, stored.select(F.concat("id", F.lit(".md")).alias("file"), "document"))
    return read_clip_library(spark, path)


@query("s6_stream_captures")
def _s6(spark, d):
    return drain(stream_captures(spark, d).select("page_id", "url", "html", "kind"), "captures")


#: Hours by which events arrive late at most.
LATE_HOURS = 24


#: Rows of an arrival in one file, about.
FILE_ROWS = 250_000


@functools.cache
def _arrivals(app: str, d: str) -> tuple[str, int, datetime.datetime]:
    """The events in order of arrival, up to LATE_HOURS after their time, how many files an arrival is, and the last time; written once per session.

    There are eight arrivals, written one after the other: files of a stream are read in the order they were written.
    All have the same number of files, so that a trigger holds whole arrivals.
    """
    spark = SparkSession.getActiveSession()
    path, parts = scratch_path(spark, "arrivals"), scratch_path(spark, "arrival-parts")
    late = F.pmod(F.xxhash64("event_id"), F.lit(LATE_HOURS * 3600))
    events = table(spark, d, "events").withColumn("_arrives", F.unix_seconds(F.col("ts").cast("timestamp")) + late)
    files = max(1, -(-events.count() // (8 * FILE_ROWS)))
    part = F.floor(F.spark_partition_id() / files).cast("int")
    events.repartitionByRange(8 * files, "_arrives").withColumn("_part", part).drop("_arrives").write.partitionBy("_part").parquet(parts)
    arrived = spark.read.option("basePath", parts).parquet(parts)
    sizes = [r["count"] for r in arrived.groupBy("_part").count().collect()]
    if len(sizes) < 8 or min(sizes) < 100 * files:
        files = 1  # rows dealt out in turn might leave a file empty
    for n in range(8):
        one = arrived.where(F.col("_part") == n).drop("_part")
        (one.repartition(files) if files > 1 else one.coalesce(1)).write.mode("append").parquet(path)
    return path, files, table(spark, d, "events").agg(F.max("ts")).first()[0]


def disordered_events(spark, d, arrivals_per_trigger=2):
    """Events as they arrive, two arrivals to a trigger, by how much they are out of order at most, and a time after all."""
    path, files, last = _arrivals(spark.sparkContext.applicationId, d)
    return event_stream(spark, path, arrivals_per_trigger * files, "*.parquet"), f"{LATE_HOURS} hours 1 second", last + datetime.timedelta(days=60)


def to_end(spark, d, columns, build, name, arrivals_per_trigger=2):
    """``build(stream, delay)`` over disordered events with ``key, id, ts`` and ``columns``, to its end."""
    events, delay, after = disordered_events(spark, d, arrivals_per_trigger)
    stream = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", *columns)
    ends = {"bigint": -1, "string": "", "boolean": False}
    end = (-1, -1, after, *(ends[kind] for _, kind in stream.dtypes[3:]))
    return drain_to_end(stream, lambda source: build(source, delay), name, end)


#: Event time that waits together in the keyed streams below, where events of a user are hours apart.
BUCKET = 6 * 3600 * 1000


@query("st1_stream_once")
def _st1(spark, d):
    events, delay, _ = disordered_events(spark, d)
    replayed = events.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.col("event_id").alias("op_id"), "ts", "event_type")
    return drain(jobs.stream_once(replayed, delay), "once")


@query("st2_stream_saved_index")
def _st2(spark, d):
    events, _, _ = disordered_events(spark, d)
    saves = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.regexp_extract("props", r'"k": *(\d+)', 1)).alias("source"),
        F.col("ts").alias("saved_at"), F.col("event_id").alias("id"), F.col("event_type").alias("title"),
    )
    return jobs.stream_saved_index(saves, every=2)


@query("st3_stream_threads")
def _st3(spark, d):
    return to_end(spark, d, [], lambda s, delay: jobs.stream_threads(s.select("key", "ts"), "6 hours", delay, max_posts=3, max_time=36000), "threads")


@query("st4_stream_pending_queue")
def _st4(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "grant").when(F.col("event_type") == "error", "revoke").otherwise("push")
    return to_end(spark, d, [kind.alias("kind")], functools.partial(stateful.stream_pending_queue, bucket_ms=BUCKET), "pending")


@query("st5_stream_throttle")
def _st5(spark, d):
    phase = F.when(F.col("event_type") == "purchase", "finished").otherwise("running")
    # events are hours apart: an interval of six hours
    return to_end(spark, d, [phase.alias("phase")], lambda s, delay: stateful.stream_throttle(s, delay, 6 * 3600 * 1000, BUCKET), "throttle")


@query("st6_stream_batches")
def _st6(spark, d):
    return to_end(spark, d, [], lambda s, delay: jobs.stream_batches(s.select("key", "ts"), delay, seconds=6 * 3600), "batches")


@query("st7_stream_take")
def _st7(spark, d):
    opens = F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "click", False)
    taken = to_end(spark, d, [opens.alias("opens")], lambda s, delay: stateful.stream_take(s.where("opens IS NOT NULL"), delay, 7200, BUCKET), "take")
    return taken.select("key", "request_id", "open_id")


@query("st8_stream_generation_guard")
def _st8(spark, d):
    generation = F.dayofmonth("ts") - F.when(F.col("event_type") == "error", 3).otherwise(0)
    return to_end(spark, d, [generation.cast("bigint").alias("generation")], functools.partial(stateful.stream_generation_guard, bucket_ms=BUCKET), "guard")


# --- units, translation --------------------------------------------------------


@query("x3_document_units")
def _x3(spark, d):
    found = units.document_units(table(spark, d, "documents"))
    return found.select("doc_id", "unit_no", "kind", "start", "end", F.size("source_lines").alias("lines"), "segments")


def translated_units(spark, d):
    found = units.document_units(table(spark, d, "documents"))
    return found.withColumn("translations", F.transform("segments", F.reverse))


@query("x4_interleave_translations")
def _x4(spark, d):
    # documents as they were: the translations go after their own units
    return units.interleave_translations(table(spark, d, "documents").select("doc_id", "text"), translated_units(spark, d), F.lit("en"))


@query("x3_structured_units")
def _x3s(spark, d):
    found = units.document_units(derive.structured_documents(spark, d))
    return found.select("doc_id", "unit_no", "kind", "start", "end", "indent", "level", "segments")


@query("x4_changed_documents")
def _x4c(spark, d):
    # units of the earlier text meet the text of today
    earlier = units.document_units(derive.structured_documents(spark, d)).withColumn("translations", F.transform("segments", F.reverse))
    return units.interleave_translations(derive.structured_documents(spark, d, changed=True), earlier, F.lit("en"))


def segment_lines(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "segment"))


def translation_memory(spark, d):
    known = segment_lines(spark, d).where("lang = 'en' AND trim(segment) <> ''")
    return known.groupBy("segment").agg(F.reverse(F.first("segment")).alias("translation"))


@query("j13_translate_segments")
def _j13(spark, d):
    lines = segment_lines(spark, d).select("doc_id", "line_no", "segment")
    return translation.translate_segments(lines, translation_memory(spark, d))


@query("a5_translation_status")
def _a5(spark, d):
    lines = translation.translate_segments(segment_lines(spark, d), translation_memory(spark, d))
    counted = lines.groupBy("doc_id").agg(
        F.first("lang").alias("source"), F.count("translated").alias("applied"), F.count("*").alias("total"),
        F.when(F.count("*") > 3, "engine-failed").otherwise("needs-download").alias("error"),
    )
    return translation.translation_status(counted.withColumn("target", F.lit("es-MX")))


@query("e1_with_engine")
def _e1(spark, d):
    lines = segment_lines(spark, d).select("doc_id", "line_no", F.col("lang").alias("source"), F.lit("en").alias("target"), "segment")
    return translation.with_engine(lines, ReversingEngine)


@query("x8_language_gate")
def _x8(spark, d):
    docs = table(spark, d, "documents")
    sure = F.when(F.col("n_chars") < 500, 0.4).otherwise(0.9)
    tag = F.when(F.col("lang") == "de", "zh-HK").when(F.col("lang") == "fr", "zh-Hans-CN").otherwise(F.concat("lang", F.lit("-XX")))
    target = pick_target(F.when(F.col("doc_id") < 500, " ES ").otherwise(""), F.lit("auto"), F.col("n_chars") > 300, F.lit(True), F.lit("zh"))
    gated = docs.select("doc_id", tag.alias("lang"), sure.alias("confidence"), target.alias("target"))
    return translation.language_gate(gated, F.col("target"))


@query("x8_detect_language")
def _x8d(spark, d):
    checkpoint_dir(spark)
    found = translation.held_out_languages(table(spark, d, "documents"))
    return found.select("doc_id", "fold", "lang", F.round("confidence", 3).alias("confidence"))


# --- tables and video pages ----------------------------------------------------


@query("x5_table_cells")
def _x5(spark, d):
    return html_tables.table_cells(derive.table_pages(spark, d))


@query("x6_table_kinds")
def _x6(spark, d):
    return html_tables.table_kinds(html_tables.table_cells(derive.table_pages(spark, d)))


@query("x7_table_markdown")
def _x7(spark, d):
    return html_tables.table_markdown(html_tables.table_cells(derive.table_pages(spark, d)))


@query("p8_stream_page_meta")
def _p8(spark, d):
    return videos.stream_page_meta(derive.video_pages(spark, d))


@query("j8_edit_documents")
def _j8d(spark, d):
    records = derive.stored_documents(spark, d)
    docs = documents.clip_documents(records).join(records.select("id", "source", "title"), "id")
    change = records.select(
        "id", F.concat(F.lit("New ["), F.col("id"), F.lit("]  title")).alias("title"), F.array(F.lit("t"), F.lit('q"')).alias("tags"), F.lit("n").alias("note")
    )
    return headers.edit_documents(docs, change)


@query("a5_translation_fields")
def _a5f(spark, d):
    records = derive.stored_documents(spark, d)
    marks = records.select(
        "id", F.element_at("tags", 1).alias("lang"), F.lit("zh-TW").alias("translated_to"),
        F.when(F.length("body") < 1000, "partial").when(F.length("body") < 3000, "complete").alias("translation"),
    )
    return headers.set_translation_fields(documents.clip_documents(records).join(marks, "id"))
