"""Scalar text functions (F3, F5, F8, F11-F14), all built-in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits used by the reference.
URL_PATTERN = r"\Ahttps?://.+\z"
TRACE_ID_PATTERN = r'"traceId":"(\w+)"'
ERROR_MAX_CHARS = 500


def url_ok(url: Column) -> Column:
    """the whole value matches ``https?://.+``."""
    return url.rlike(URL_PATTERN)


def csv_types(csv: Column) -> Column:
    """F3 helper: the trimmed entries of a comma-separated list."""
    return F.transform(F.split(csv, ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))


def subscribes_to(csv: Column, event_type: Column) -> Column:
    """CSV membership after trimming each entry."""
    return F.array_contains(csv_types(csv), event_type)


def iso_instant(ts: Column) -> Column:
    """ISO-8601 UTC text of a millisecond instant, fraction only if non-zero.

    Event times travel as epoch milliseconds, so sub-millisecond digits are
    dropped first; the session time zone is UTC.
    """
    millis = F.pmod(F.floor(F.unix_micros(ts) / 1000), F.lit(1000))
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.when(millis != 0, F.concat(F.lit("."), F.lpad(millis.cast("string"), 3, "0"))) \
            .otherwise(F.lit(""))
    return F.concat(base, frac, F.lit("Z"))


def cut(text: Column, n: int = ERROR_MAX_CHARS) -> Column:
    """F8: keep at most ``n`` characters."""
    return F.substring(text, 1, n)


def trace_id(line: Column) -> Column:
    """the trace id of a JSON log line, null when absent."""
    v = F.regexp_extract(line, TRACE_ID_PATTERN, 1)
    return F.when(v != "", v)


def to_base64(text: Column) -> Column:
    """UTF-8 text -> base64 text on one line.

    Spark's ``base64`` wraps its output MIME-style every 76 characters; the
    reference's encoder does not, so the line breaks are removed.
    """
    return F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))


def from_base64(text: Column) -> Column:
    """base64 text -> UTF-8 text; invalid base64 gives null instead of failing."""
    return F.decode(F.try_to_binary(text, F.lit("base64")), "UTF-8")
