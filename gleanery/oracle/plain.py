"""Plain text of Markdown in SQL: the lines lose their marks one by one, then a list of tokens is shown one by one."""

from __future__ import annotations

from gleanery.oracle.pages import WS

_PUNCT = r"[!-/:-@\[-`{-~]"
_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
_TOKEN = rf"(?s){_IMAGE}|\[(?:{_IMAGE}|[^\]\\!]|!|\\.)*\]\([^)]*\)|\\(?:{_PUNCT}|\n)|\*\*|__|[^!\[\\*_]+|."


def _line(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '^{WS}*(?:>{WS}?)+', ''), '^{WS}*(?:#{{1,6}}|[-+]|[0-9]+[.]){WS}', '')"
    return f"CASE WHEN ltrim(regexp_extract({x}, '^{WS}*(?:`{{3}}|~{{3}})')) <> '' THEN '' ELSE {bare} END"


def _shown(text: str, depth: int) -> str:
    """What is shown of a text: the tokens of a link's words are shown in turn, ``depth`` times."""
    k = f"k{depth}"
    words = f"regexp_extract({k}, '(?s)^.(.*)\\]\\([^)]*\\)$', 1)"
    inner = _shown(words, depth - 1) if depth else words
    token = f"""CASE WHEN {k} = '**' OR {k} = '__' THEN '' WHEN length({k}) = 1 THEN {k} WHEN starts_with({k}, '![') THEN ' ' WHEN starts_with({k}, '[') THEN {inner}
 WHEN starts_with({k}, chr(92)) THEN {k}[2] ELSE {k} END"""
    return f"array_to_string(list_transform(regexp_extract_all({text}, '{_TOKEN}'), lambda {k}: {token}), '')"


def plain(text: str) -> str:
    lines = f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: {_line('x')}), chr(10))"
    return f"trim(regexp_replace({_shown(lines, 1)}, '{WS}+', ' ', 'g'))"
