"""The normal form of user names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = 0xFEE0  # full-width forms stand this far above the plain ASCII characters
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789_"


def shown_name(name: Column) -> Column:
    """The letters a-z, digits and underscores a name shows, in lower case; null if it shows none.

    Full-width characters count as plain ones; anything else (a leading @, blanks, invisible characters) is dropped.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    wide = "".join(chr(ord(c) + _WIDE) for c in _PLAIN + upper)
    flat = F.translate(name, wide + upper, _PLAIN + upper.lower() + upper.lower())
    return F.nullif(F.regexp_replace(flat, "[^a-z0-9_]", ""), F.lit(""))
