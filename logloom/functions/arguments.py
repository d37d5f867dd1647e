"""What callers may ask for: numbers within their spans, short texts, known words."""

from __future__ import annotations

import re

# Page and list sizes, argument lengths.
MIN_RECORDS, MAX_RECORDS, DEFAULT_RECORDS, LIVE_RECORDS = 50, 1000, 500, 50
MAX_LIST, DEFAULT_LIST = 100, 20
MAX_QUERY, MAX_SELECTOR = 500, 240
MAX_CURSOR = 2**53 - 1

_DIGEST = re.compile("[0-9a-f]{64}")
_PATH_SIGNS = frozenset("/\\")


def _need(holds: bool, wanted: str) -> None:
    if not holds:
        raise ValueError(f"not accepted: {wanted}")


def _number(value: int | None, low: int, high: int, otherwise: int | None) -> int | None:
    """``value`` within [low, high], or ``otherwise`` where none was given; truth values are no numbers."""
    if value is None:
        return otherwise
    _need(type(value) is int and low <= value <= high, f"a whole number from {low} to {high}")
    return value


def _short(value: str | None, most: int) -> str:
    text = "" if value is None else value
    _need(len(text) <= most, f"a text of {most} characters or fewer")
    return text.strip()


def page_size(value: int | None) -> int:
    return _number(value, MIN_RECORDS, MAX_RECORDS, DEFAULT_RECORDS)


def list_limit(value: int | None) -> int:
    return _number(value, 1, MAX_LIST, DEFAULT_LIST)


def cursor(value: int | None) -> int | None:
    return _number(value, 1, MAX_CURSOR, None)


def query_text(value: str | None) -> str:
    return _short(value, MAX_QUERY).casefold()


def selector(value: str | None) -> str | None:
    """Trimmed name of a session; none, blank and ``latest`` stand for the newest one."""
    name = _short(None if value is None else value.strip(), MAX_SELECTOR)
    _need(_PATH_SIGNS.isdisjoint(name), "a session's name, without folders")
    return None if name in ("", "latest") else name


def detail_level(value: str) -> str:
    _need(value in ("summary", "full"), "summary or full")
    return value


def revision(value: str | None) -> str | None:
    _need(value is None or _DIGEST.fullmatch(value) is not None, "a digest of 64 lower-case hexadecimal signs")
    return value
