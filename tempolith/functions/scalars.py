"""Hashes, slots, schedules and small text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def payload_hash(payload) -> Column:
    return F.sha2(payload, 256)


def hash_ok(payload, persisted) -> Column:
    """No persisted hash, or the payload's."""
    return (persisted == "") | (persisted == payload_hash(payload))


def floor_div(a: Column, b: int) -> Column:
    """Integer quotient rounded down."""
    return F.floor((a - F.pmod(a, F.lit(b))).cast("decimal(38,0)") / b).cast("bigint")


def slot(nanos: Column, interval_seconds: int) -> Column:
    """Epoch-aligned slot number; intervals below one second count as one; truncation toward zero."""
    step = max(1, interval_seconds) * NANOS
    return ((nanos - nanos % step).cast("decimal(38,0)") / step).cast("bigint")


def anchored_slot(nanos: Column, interval_seconds: int, zone: str, hour: int, minute: int) -> Column:
    """Slots whose borders lie at a wall-clock time of a zone, daylight saving included."""
    step = max(1, interval_seconds) * NANOS
    second = F.timestamp_seconds(floor_div(nanos, NANOS))
    local_day = F.date_trunc("day", F.from_utc_timestamp(second, zone))
    wall = local_day + F.expr(f"interval {hour} hours {minute} minutes")
    anchor = F.unix_seconds(F.to_utc_timestamp(wall, zone)) * NANOS
    ref = F.unix_seconds(F.to_utc_timestamp(F.to_timestamp(F.lit(f"1970-01-01 {hour:02}:{minute:02}:00")), zone)) * NANOS
    return floor_div(nanos - anchor, step) + floor_div(anchor - ref, step)


def parse_schedule(text: str) -> tuple[int, int, str]:
    """(hour, minute, zone) of 'daily@HH:MM <IANA zone>'."""
    found = re.fullmatch(r"daily@([0-9]{1,2}):([0-9]{2}) (\S+)", text)
    if not found or int(found[1]) > 23 or int(found[2]) > 59:
        raise ValueError(f"not a schedule: {text!r}")
    return int(found[1]), int(found[2]), found[3]


def schedule_parts(text: Column) -> Column:
    """struct(hour, minute, zone), null where the text is no schedule."""
    pattern = r"^daily@([0-9]{1,2}):([0-9]{2}) (\S+)$"
    hour, minute = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
    return F.when((hour < 24) & (minute < 60), F.struct(hour.alias("hour"), minute.alias("minute"), F.regexp_extract(text, pattern, 3).alias("zone")))


def pct_change(close: Column, prev: Column) -> Column:
    """(close - prev) / prev; null without a previous close."""
    return F.when(prev.isNotNull() & (prev != 0), (close - prev) / prev)


def truncate_text(text: Column, most: int, mark: str = "...(truncated)") -> Column:
    """The first ``most`` bytes and a mark where the text is longer."""
    return F.when(F.octet_length(text) > most, F.concat(F.decode(F.substring(text.cast("binary"), 1, most), "UTF-8"), F.lit(mark))).otherwise(text)


def u64_le(raw: Column, at: int) -> Column:
    """Unsigned little-endian 64-bit value at a byte offset, as decimal(20,0)."""
    return F.conv(_reversed_hex(raw, at, 8), 16, 10).cast("decimal(20,0)")


def _reversed_hex(raw: Column, at: int, n: int) -> Column:
    return F.concat(*[F.hex(F.substring(raw, at + 1 + i, 1)) for i in reversed(range(n))])
