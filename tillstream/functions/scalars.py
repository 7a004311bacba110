"""Column helpers: all built on ``pyspark.sql.functions``, no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the exchange rate the money columns were written with (VND per USD).
VND_PER_USD = 24000


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def iso_text(c: Column) -> Column:
    """ISO-8601 text without the cosmetic ``Z`` / ``+00:00`` suffix."""
    return F.regexp_replace(c, r"(Z|\+00:00)$", "")


def iso_timestamp(c: Column) -> Column:
    """Strict parse (a malformed value raises); the fraction is optional, a zone suffix is ignored."""
    return c.cast("timestamp_ntz")


def iso_timestamp_or_null(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def timestamp_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def epoch_millis(c: Column) -> Column:
    """Wall-clock timestamp to epoch milliseconds, whatever the session's zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", _epoch(), c) / 1000)


def number_or_zero(c: Column) -> Column:
    """Numeric coercion: unreadable or missing becomes 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def whole_or_null(c: Column) -> Column:
    return c.try_cast("double").try_cast("bigint")


def weekday_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def epoch_seconds(c: Column) -> Column:
    return F.timestamp_diff("SECOND", _epoch(), c)


def truncated(c: Column) -> Column:
    """Drop the fraction towards zero."""
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """Division that yields 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def nearest(c: Column, unit: int) -> Column:
    """Round to a multiple of ``unit``, halves to the even multiple."""
    return (F.bround(c / F.lit(unit)) * unit).cast("bigint")


def half_even(c: Column, digits: int) -> Column:
    """A double rounded to ``digits`` decimals by its exact binary value, ties to the even digit.

    2.675 is a little less than its text says, so it gives 2.67; 0.125 is a tie and gives 0.12. The
    product with the power of ten is split into its rounded value and its exact rest, which decides
    where the rounded value looks like a tie. Beyond 2^52 / 10^digits it rounds the decimal text.
    """
    c, scale = c.cast("double"), F.lit(float(10**digits))
    product = c * scale
    wide = c * F.lit(134217729.0)  # 2^27 + 1 cuts a double into two halves whose products are exact
    high = wide - (wide - c)
    rest = (high * scale - product) + (c - high) * scale
    whole = F.floor(product)
    above = product - whole.cast("double")
    up = (above > 0.5) | ((above == 0.5) & ((rest > 0) | ((rest == 0) & (F.pmod(whole, F.lit(2)) == 1))))
    exact = (whole + F.when(up, 1).otherwise(0)).cast("double") / scale
    return F.when(F.abs(product) < float(2**52), exact).otherwise(F.bround(c, digits))


def usd_from_vnd(c: Column, rate: int = VND_PER_USD) -> Column:
    return half_even(c / F.lit(rate), 2)


def vnd_from_usd(c: Column, rate: int = VND_PER_USD) -> Column:
    return truncated(c * F.lit(rate))


def padded(prefix: str, c: Column, width: int) -> Column:
    """``prefix`` followed by the number, zero-padded to at least ``width`` digits."""
    digits = c.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def same_text(c: Column, wanted: str) -> Column:
    return F.lower(c) == wanted.lower()


def has_text(c: Column, wanted: str) -> Column:
    """Case-insensitive literal substring (``%`` and ``_`` mean themselves)."""
    return F.contains(F.lower(c), F.lit(wanted.lower()))


def first_names(c: Column) -> Column:
    """All words of a full name but the last."""
    words = F.split(c, " ")
    return F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")


def last_name(c: Column) -> Column:
    return F.element_at(F.split(c, " "), -1)


def sha256_of(*parts: Column, separator: str = "") -> Column:
    return F.sha2(F.concat_ws(separator, *[p.cast("string") for p in parts]), 256)


def count_map(key: str, count: str) -> Column:
    """value -> count map over rows already reduced to one per value (few values)."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, count))))
