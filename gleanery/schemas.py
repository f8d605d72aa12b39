"""Declared schemas, field name to type; nothing is inferred at read time."""

from __future__ import annotations

PAGES = "page_id bigint, url string, html string"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

_PARTIAL = "struct<limit: boolean, timeout: boolean, truncated: int>"
CAPTURE = {
    "url": "string",
    "title": "string",
    "site": "string",
    "author": "string",
    "published": "string",
    "description": "string",
    "cover_url": "string",
    "html": "string",
    "markdown": "string",
    "text_length": "int",
    "kind": "string",
    "fetched": "boolean",
    "x": f"struct<form: string, posts: int, partial: {_PARTIAL}, heading: string>",
    "media": "struct<kind: string, url: string, file_name: string>",
    "stream": "struct<platform: string, video_id: string, embed: string, duration: double, medium: string,"
    " page: struct<url: string, title: string>, bytes: bigint>",
    "quote": "struct<markdown: string, fragment_url: string, selected_at: timestamp, op_id: string>",
}
#: Capture fields whose absence is NULL; every other absent text is ''.
NULLABLE = {"markdown", "fetched", "x", "media", "stream", "quote"}

MEDIA_META = {
    "id": "string",
    "file": "string",
    "source": "string",
    "media_url": "string",
    "medium": "string",
    "title": "string",
    "site": "string",
    "captured": "string",
    "bytes": "bigint",
    "mime": "string",
    "tags": "array<string>",
    "note": "string",
}
