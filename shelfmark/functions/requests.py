"""Client identity and fixed rate windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import js_trim

MINUTE_MS = 60_000


def client_id(forwarded_for: Column, source_ip: Column) -> Column:
    """First forwarded address, else the source address, else ``unknown``."""
    first = js_trim(F.split(forwarded_for, ",")[0])
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(source_ip, F.lit("")), F.lit("unknown"))


def client_key(raw_id: Column, window_start_minutes: Column, salt: Column) -> Column:
    return F.sha2(F.concat(raw_id, window_start_minutes.cast("string"), salt), 256)


def ms_to_minutes(ms: Column) -> Column:
    """Whole minutes, rounded up."""
    return F.ceil(ms / F.lit(MINUTE_MS)).cast("bigint")


def minutes_to_ms(minutes: Column) -> Column:
    return minutes.cast("bigint") * F.lit(MINUTE_MS)


def _ceil_to(value: Column, unit: Column) -> Column:
    """Next multiple of ``unit`` at or after ``value``, in exact integer arithmetic."""
    return value + F.pmod(-value, unit)


def window_reset_ms(ts: Column, window_minutes: Column | int, offset_minutes: int = 0) -> Column:
    """End of the fixed window of ``ts`` in epoch milliseconds.

    Windows are closed on the right: an event exactly on a boundary belongs to the window that
    ends there.
    """
    minutes = window_minutes if isinstance(window_minutes, Column) else F.lit(window_minutes)
    # Milliseconds are cut, not rounded, as a wall clock in milliseconds would give them.
    millis = F.unix_millis(ts.cast("timestamp"))
    offset = offset_minutes * MINUTE_MS
    whole_minute = _ceil_to(millis, F.lit(MINUTE_MS).cast("bigint")) + F.lit(offset)
    return _ceil_to(whole_minute, minutes_to_ms(minutes)) - F.lit(offset)
