"""Column expressions shared by the reports and operators (EXP-1..18).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c, precision: int = 12, scale: int = 2) -> Column:
    """Cast to an exact decimal so sums do not depend on addition order."""
    return col(c).cast(T.DecimalType(precision, scale))


def full_name(first="first_name", last="last_name") -> Column:
    """CONCAT(first, ' ', last): NULL when either part is NULL (EXP-2)."""
    return F.concat(col(first), F.lit(" "), col(last))


def not_in(c, values) -> Column:
    """SQL ``NOT IN (list)``: NULL input gives NULL, so a filter drops it (EXP-10)."""
    return ~col(c).isin(list(values))


def not_deleted(c="deleted_at") -> Column:
    """Soft-delete predicate used by every order query (DML-5)."""
    return col(c).isNull()


def exact_avg(c) -> Column:
    """AVG over a decimal column: Spark keeps it exact, scale + 4 like MySQL."""
    return F.avg(col(c))


def ratio(total, count, precision: int = 16, scale: int = 6) -> Column:
    """Mean from a pre-aggregated sum and count, rounded half-up to ``scale``.

    Used where a report aggregates early (eager aggregation) and still has to
    give the same value as AVG over the raw rows.
    """
    # decimal(20,2) / decimal(18,0) keeps 20 fractional digits, so the final
    # half-up rounding to ``scale`` is not preceded by a coarser rounding.
    q = col(total).cast(T.DecimalType(20, 2)) / col(count).cast(T.DecimalType(18, 0))
    return F.when(col(count) > 0, q.cast(T.DecimalType(precision, scale)))


def day(c) -> Column:
    """DATE(ts) in the session time zone (EXP-6)."""
    return F.to_date(col(c))


def days_between(later, earlier) -> Column:
    """DATEDIFF on the date parts, NULL-propagating (EXP-7)."""
    return F.datediff(col(later), col(earlier))


def first_match(cases: list[tuple[Column, object]], default) -> Column:
    """Searched CASE: the first true condition wins (EXP-5)."""
    expr = None
    for cond, value in cases:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def like_any(c, patterns: list[str]) -> Column:
    """True when the value matches any SQL LIKE pattern (``%`` and ``_``)."""
    out = F.lit(False)
    for p in patterns:
        out = out | col(c).like(p)
    return out


def starts_with_any(c, prefixes: list[str]) -> Column:
    """Literal prefix test; unlike LIKE, ``_`` is not a wildcard (T10)."""
    out = F.lit(False)
    for p in prefixes:
        out = out | col(c).startswith(p)
    return out


def signed_delta_status(source_count, target_count, source_ok, target_ok) -> Column:
    """Parity label: MATCH, the signed difference target - source, or ERR (EXP-18)."""
    return (F.when(~col(source_ok) | ~col(target_ok), F.lit("ERR"))
            .when(col(source_count) == col(target_count), F.lit("MATCH"))
            .otherwise((col(target_count) - col(source_count)).cast("string")))


def endpoint_host(c) -> Column:
    """Host part of a ``host:port`` endpoint (split and take part, EXP-20)."""
    return F.split(col(c), ":").getItem(0)


def join_csv(c) -> Column:
    """An array column joined into one comma-separated string (EXP-20)."""
    return F.concat_ws(",", col(c))


def plain(text: str) -> str:
    """The text without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def unaccented(column: Column) -> Column:
    """Latin letters without their accents: a character map built from Unicode's own decompositions."""
    accented = [chr(c) for c in range(0xC0, 0x250) if len(plain(chr(c))) == 1 and plain(chr(c)) != chr(c)]
    return F.regexp_replace(F.translate(column, "".join(accented), "".join(map(plain, accented))), r"\p{M}+", "")
