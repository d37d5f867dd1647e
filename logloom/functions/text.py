"""Bounded text, identifiers, paths and identity columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text and identifier limits.
SUMMARY_LIMIT = 220
DETAIL_LIMIT = 12_000
ID_LIMIT, ID_KEPT, ID_DIGEST = 240, 220, 16

# Session sources that may be shown.
SOURCE_KINDS = ("cli", "vscode", "exec", "mcp", "custom", "internal", "subagent", "unknown")

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"

# White space as the text rules see it: Unicode spaces and the ASCII separators.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def collapse(text: Column) -> Column:
    """One blank for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "))


def shorten(text: Column, limit: int = SUMMARY_LIMIT) -> Column:
    """Collapsed text of at most ``limit`` characters, cut with an ellipsis."""
    return clip(collapse(text), limit)


def clip(flat: Column, limit: int) -> Column:
    """Collapsed text cut to ``limit`` characters."""
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def some_text(text: Column, limit: int = SUMMARY_LIMIT) -> Column:
    """Shortened text, null when nothing is left."""
    flat = collapse(text)
    return F.when(flat != "", clip(flat, limit))


def bounded(text: Column, limit: int = DETAIL_LIMIT) -> Column:
    """Text of at most ``limit`` characters plus a note of how many were left out."""
    left_out = F.length(text) - limit
    note = F.format_string("\n\n… truncated %,d characters", left_out)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), note)
    )


def _is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, f"{_SPACE}+", "") == "", F.lit(True))


def identifier(value: Column, fallback: Column | None = None) -> Column:
    """Identifier as given; a long one keeps its head and gets a digest, a blank one falls back."""
    long_id = F.concat(
        F.substring(value, 1, ID_KEPT), F.lit("…"), F.substring(F.sha2(value, 256), 1, ID_DIGEST)
    )
    usable = F.when(F.length(value) <= ID_LIMIT, value).otherwise(long_id)
    return F.when(~_is_blank(value), usable).otherwise(
        F.lit(None).cast("string") if fallback is None else fallback
    )


def salted_id(value: Column, salt: Column) -> Column:
    """Head of an identifier with a digest of it and a salt, for repeated identifiers."""
    digest = F.substring(F.sha2(F.concat_ws(":", value, salt.cast("string")), 256), 1, ID_DIGEST)
    return F.concat(F.substring(value, 1, ID_KEPT), F.lit("…"), digest)


def snake_case(kind: Column) -> Column:
    """PascalCase or kebab-case discriminator in snake case; over 200 characters is no kind."""
    parts = F.regexp_replace(kind, r"(?<=\p{Ll})(?=\p{Lu})", "_")
    name = F.lower(F.regexp_replace(parts, "-", "_"))
    return F.when(F.length(kind) <= 200, name).otherwise("")


def plain_path(path: Column) -> Column:
    """A file address without the escapes that Spark's file metadata has."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")


def rollout_id(stem: Column) -> Column:
    """Lower-case UUID at the end of a file stem."""
    found = F.regexp_extract(stem, f"({UUID})$", 1)
    return F.when(found != "", F.lower(found))


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(f"^{UUID}$"), F.lit(False))


def shown_path(path: Column, home: str) -> Column:
    """Path without the user's home or the folders of other absolute paths."""
    root = home.rstrip("/")
    posix = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")
    name = F.element_at(F.split(posix, "/"), -1)
    win_name = F.element_at(F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]"), -1)
    windows = path.rlike(r"^([A-Za-z]:[\\/]|\\\\)")
    drive_only = path.rlike(r"^[A-Za-z]:[\\/]+$")
    return (
        F.when(posix == root, F.lit("~"))
        .when(posix.startswith(root + "/"), shorten(F.concat(F.lit("~"), posix.substr(F.lit(len(root) + 1), F.length(posix))), 500))
        .when(posix == "/", F.lit("<absolute>"))
        .when(posix.startswith("/"), shorten(F.concat(F.lit("<absolute>/"), name), 500))
        .when(drive_only, F.lit("<absolute>"))
        .when(windows, shorten(F.concat(F.lit("<absolute>/"), win_name), 500))
        .otherwise(shorten(path, 500))
    )
