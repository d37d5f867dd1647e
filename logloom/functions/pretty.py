"""Indented JSON for the full-detail view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of an integer and levels of nesting that are still read as JSON.
MAX_DIGITS, MAX_LEVELS = 256, 256


def indented(value: Column) -> Column:
    """JSON text laid out with two spaces a level; any other text as it is.

    Spark has no function that lays JSON out, so a batch of texts goes through Python. Only
    details of tool records at full detail take this way.
    """
    digits, levels = MAX_DIGITS, MAX_LEVELS

    @F.pandas_udf("string")
    def lay_out(texts):
        import json

        def once(pairs):
            found = dict(pairs)
            if len(found) != len(pairs):
                raise ValueError("a key occurs twice")
            return found

        def whole(text):
            if len(text.lstrip("-")) > digits:
                raise ValueError("too many digits")
            return int(text)

        def refused(text):
            raise ValueError(text)

        def deep(found, level=0):
            if level > levels:
                raise ValueError("nested too deep")
            for part in found.values() if isinstance(found, dict) else found if isinstance(found, list) else ():
                deep(part, level + 1)

        def one(text):
            if text is None:
                return None
            try:
                found = json.loads(text, object_pairs_hook=once, parse_int=whole, parse_constant=refused)
                deep(found)
                return json.dumps(found, ensure_ascii=False, allow_nan=False, indent=2)
            except (ValueError, RecursionError):
                return text

        return texts.map(one, na_action="ignore")

    return lay_out(value)
