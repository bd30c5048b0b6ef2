"""Limited-size large-object mode (SNK-4): cut text columns to a byte limit.

The cut is made on a UTF-8 character boundary, so the result is always
valid text of at most ``max_bytes`` bytes: if the first dropped byte is a
continuation byte (0b10xxxxxx), the cut moves back to the start of that
character (at most three bytes back). Pure column expressions: they run
inside whole-stage codegen on every executor, over the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: limited-size LOB settings of the source task -----------
LOB_MAX_KB = 32
# ---------------------------------------------------------------------------


def _byte_at(b: Column, pos: int) -> Column:
    """Unsigned value of the byte at 1-based ``pos`` of a binary column."""
    return F.conv(F.hex(F.substring(b, pos, 1)), 16, 10).cast("int")


def _continuation(b: Column, pos: int) -> Column:
    v = _byte_at(b, pos)
    return (v >= 128) & (v < 192)


def utf8_prefix(c, max_bytes: int) -> Column:
    """The longest prefix of ``c`` whose UTF-8 encoding fits ``max_bytes``."""
    c = F.col(c) if isinstance(c, str) else c
    b = F.encode(c, "UTF-8")
    n = max_bytes
    cut = (F.when(~_continuation(b, n + 1), F.lit(n))
           .when(~_continuation(b, n), F.lit(n - 1))
           .when(~_continuation(b, n - 1), F.lit(n - 2))
           .otherwise(F.lit(n - 3)))
    return F.when(F.octet_length(c) <= n, c).otherwise(F.decode(F.substring(b, 1, cut), "UTF-8"))


def limit_lob(df: DataFrame, cols: list[str], max_kb: int = LOB_MAX_KB) -> DataFrame:
    """Cut each text column to ``max_kb`` kilobytes (1 KB = 1024 bytes)."""
    return df.withColumns({c: utf8_prefix(c, max_kb * 1024) for c in cols})
