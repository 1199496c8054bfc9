"""Display strings and tolerant time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts below, their order and limits are fixed values: they must equal what the catalog shows.
_MINUTE, _HOUR, _DAY = 60_000, 3_600_000, 86_400_000


def range_label(lo: Column, hi: Column) -> Column:
    return (F.when(lo.isNull() & hi.isNull(), F.lit("Cone not stated"))
            .when(lo.isNotNull() & hi.isNotNull() & (lo != hi), F.concat(F.lit("Cone "), lo, F.lit("–"), hi))
            .otherwise(F.concat(F.lit("Cone "), F.coalesce(lo, hi))))


def price_label(price: Column) -> Column:
    """``From $6.95``; null stays null."""
    return F.concat(F.lit("From $"), price.cast("decimal(18,2)").cast("string"))


def line_label(code: Column, name: Column) -> Column:
    """A short catalog code is useful beside the name; a descriptive slug is not."""
    short = F.trim(code)
    return F.when(short.rlike(r"^[A-Z0-9]{1,6}$"), F.concat(short, F.lit(" · "), name)).otherwise(name)


def credit_label(maker: Column) -> Column:
    return F.concat(F.lit("Photograph © "), maker)


def bare_name(code: Column, name: Column) -> Column:
    """A name without the code it repeats at its front, with or without a dash and padding zeros."""
    letters, digits = F.regexp_extract(code, "^([A-Za-z]+)-?0*[0-9]+$", 1), F.regexp_extract(code, "^[A-Za-z]+-?0*([0-9]+)$", 1)
    front = F.concat(F.lit("(?i)^"), letters, F.lit("[- ]?0*"), digits, F.lit("(?![0-9])"))
    padded = F.when(letters != "", F.regexp_replace(name, front, F.lit("")))
    exact = F.when(F.lower(name).startswith(F.lower(code)), F.substring(name, F.length(code) + 1, F.length(name)))
    rest = F.regexp_replace(F.when(letters != "", F.nullif(padded, name)).otherwise(exact), r"^[\s\-–:]+", "")
    return F.when(rest != "", rest).otherwise(name)


def relative_time(ts_ms: Column, as_of_ms: Column) -> Column:
    """A glanceable age relative to a given moment (never the wall clock)."""
    age = as_of_ms - ts_ms
    when = F.timestamp_millis(ts_ms)
    same_year = F.year(when) == F.year(F.timestamp_millis(as_of_ms))
    day = F.date_format(when, "MMM d")
    return (F.when(age < _MINUTE, "Just now")
            .when(age < _HOUR, F.concat(F.floor(age / _MINUTE).cast("string"), F.lit("m ago")))
            .when(age < _DAY, F.concat(F.floor(age / _HOUR).cast("string"), F.lit("h ago")))
            .when(age < 2 * _DAY, "Yesterday")
            .when(age < 7 * _DAY, F.concat(F.floor(age / _DAY).cast("string"), F.lit("d ago")))
            .when(same_year, day)
            .otherwise(F.date_format(when, "MMM d, yyyy")))


def full_time(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "MMMM d, yyyy · h:mm a")


def lenient_timestamp(text: Column) -> Column:
    """An ISO date or date-time, with ``Z`` or an offset or neither; anything else is null."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(text))


def http_date(ts: Column) -> Column:
    """The validator form of a time: ``Mon, 01 Jan 2024 00:00:00 GMT``."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
