"""Fragments of SQL that several statements share."""

from __future__ import annotations

#: White space of any kind, as a class of a regular expression.
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
MARK = "chr(1)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def newlines(c: str) -> str:
    return f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"


def find_all(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({c}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


def ordered_set(c: str) -> str:
    """Elements in order of their first place."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def as_text(c: str) -> str:
    return f"array_to_string({c}, {MARK})"


def listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
