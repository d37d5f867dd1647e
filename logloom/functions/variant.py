"""Typed reads from VARIANT columns: a field counts only when it has the stated JSON type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content part types shown as a marker, and container unwrapping depth.
IMAGE_PARTS = ("input_image", "image", "local_image")
AUDIO_PARTS = ("input_audio", "audio", "local_audio")
UNWRAP_LEVELS = 8

# Limits of an accepted JSON text.
MAX_DIGITS, MAX_DEPTH = 256, 256

_STRINGS = r'(?s)"(?:[^"\\]++|\\.)*+"'
_NUMBERS = r"(-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?)"


def field(value: Column, path: str) -> Column:
    """Sub-value at ``$.path``; SQL null when the key is absent, a variant null when it is null."""
    return F.try_variant_get(value, "$." + path, "variant")


def _is(value: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == name, F.lit(False))


def parts_of(value: Column, path: str, *names: str) -> Column:
    """Struct of the named sub-values, read in one go; null where there is no object."""
    fields = ", ".join(f"{n}: variant" for n in names)
    return F.try_variant_get(value, "$" + (f".{path}" if path else ""), f"struct<{fields}>")


def as_text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_whole(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def as_number(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
                  F.try_variant_get(value, "$", "double"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def given(value: Column, path: str) -> Column:
    """The key is there and not null."""
    found = field(value, path)
    return found.isNotNull() & ~F.is_variant_null(found)


def text(value: Column, path: str) -> Column:
    found = field(value, path)
    return F.when(_is(found, "STRING"), F.try_variant_get(value, "$." + path, "string"))


def flag(value: Column, path: str) -> Column:
    found = field(value, path)
    return F.when(_is(found, "BOOLEAN"), F.try_variant_get(value, "$." + path, "boolean"))


def whole(value: Column, path: str) -> Column:
    found = field(value, path)
    return F.when(_is(found, "BIGINT"), F.try_variant_get(value, "$." + path, "bigint"))


def number(value: Column, path: str) -> Column:
    kind = F.schema_of_variant(field(value, path))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
                  F.try_variant_get(value, "$." + path, "double"))


def array(value: Column, path: str) -> Column:
    return F.try_variant_get(value, "$." + path, "array<variant>")


def json_text(value: Column) -> Column:
    """A string as it is, anything else as JSON text; null and absent give null."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(
        kind != "VOID", F.to_json(value)
    )


def closed(raw: Column) -> Column:
    """The text parsed as the first element of an array that its own digest closes.

    The built-in parser ignores what follows a value; the closing digest shows
    whether the text was one whole value.
    """
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), _digest(raw), F.lit('"]')))


def _digest(raw: Column) -> Column:
    return F.xxhash64(raw).cast("string")


def strict_parse(raw: Column) -> Column:
    """Parsed JSON, null unless the whole text is one JSON value within the limits."""
    return opened(raw, closed(raw))


def opened(raw: Column, wrapped: Column) -> Column:
    """The value inside :func:`closed`, where it is whole and within the limits.

    Numbers and nesting are checked with string literals blanked out, and only
    where the text has enough digits or brackets to break a limit.
    """
    whole_text = (F.try_variant_get(wrapped, "$[1]", "string") == _digest(raw)) & F.try_variant_get(
        wrapped, "$[2]", "variant"
    ).isNull()
    bare = F.regexp_replace(raw, _STRINGS, '""')
    numbers = F.regexp_extract_all(bare, F.lit(_NUMBERS), 1)
    bad_number = F.exists(numbers, lambda n: F.when(
        n.rlike(r"[.eE]"), F.abs(n.cast("double")) == float("inf")
    ).otherwise(F.length(F.regexp_replace(n, "-", "")) > MAX_DIGITS))
    deepest = F.aggregate(
        F.split(F.regexp_replace(bare, r"[^\[\]{}]++", ""), ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda at, c: _deeper(
            at, at["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)),
        lambda at: at["top"],
    )
    opening = F.length(raw) - F.length(F.translate(raw, "[{", ""))
    bad = F.when(raw.rlike(r"\d{200}|[eE]\+?\d{3}"), bad_number).otherwise(F.lit(False)) | F.when(
        (F.length(raw) > 2 * MAX_DEPTH) & (opening > MAX_DEPTH), deepest > MAX_DEPTH
    ).otherwise(F.lit(False))
    return F.when(whole_text & ~bad, F.try_variant_get(wrapped, "$[0]", "variant"))


def _deeper(at: Column, now: Column) -> Column:
    return F.struct(now.alias("now"), F.greatest(at["top"], now).alias("top"))


def _part_text(part: Column) -> Column:
    kind = F.schema_of_variant(part)
    return F.when(kind == "STRING", F.try_variant_get(part, "$", "string")).when(
        kind.startswith("OBJECT"), text(part, "text")
    )


def content_text(value: Column, path: str) -> Column:
    """Visible text of a content list: text parts and markers, blank lines between them."""
    def shown(part):
        kind = text(part, "type")
        return F.coalesce(
            _part_text(part),
            F.when(kind.isin(*IMAGE_PARTS), "[image]").when(kind.isin(*AUDIO_PARTS), "[audio]"),
        )

    parts = F.filter(F.transform(array(value, path), shown), lambda x: x != "")
    return F.coalesce(text(value, path), F.array_join(parts, "\n\n"), F.lit(""))


def summary_parts(value: Column, path: str) -> Column:
    """Text of a reasoning summary: only text parts, empty ones kept."""
    parts = F.filter(F.transform(array(value, path), _part_text), lambda x: x.isNotNull())
    return F.coalesce(text(value, path), F.array_join(parts, "\n\n"), F.lit(""))


def count_parts(value: Column, path: str, kinds: tuple[str, ...]) -> Column:
    parts = F.filter(array(value, path), lambda part: text(part, "type").isin(*kinds))
    return F.coalesce(F.size(parts), F.lit(0))


def reports_error(parsed: Column) -> Column:
    """Failure markers of a parsed tool output: isError, success=false or Err, inside Ok wrappers."""
    levels = []
    for wrapper in ("Ok." * n for n in range(UNWRAP_LEVELS)):
        levels += [
            F.coalesce(flag(parsed, wrapper + "isError"), F.lit(False)),
            ~F.coalesce(flag(parsed, wrapper + "success"), F.lit(True)),
            field(parsed, wrapper + "Err").isNotNull(),
        ]
    return F.coalesce(reduce(lambda a, b: a | b, levels), F.lit(False))
