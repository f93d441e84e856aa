"""Calendar parts, time buckets and cyclic encodings."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a frequency and their seconds.
UNITS = {"d": 86400, "h": 3600, "min": 60, "t": 60, "s": 1}


def freq_seconds(freq: str) -> int:
    """Seconds of a frequency such as D, 6h or 30min, in any case."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq or "")
    unit = m[2].lower() if m else ""
    if unit not in UNITS or m[1] == "0":
        raise ValueError(f"unknown frequency {freq!r}; use for example D, 12h, 6h, 1h or 30min")
    return int(m[1] or 1) * UNITS[unit]


def floor_time(ts: Column, freq: str) -> Column:
    """Start of the bucket from the epoch that holds ``ts``."""
    return F.window(ts, f"{freq_seconds(freq)} seconds")["start"]


def parse_time(text: Column) -> Column:
    """UTC timestamp without zone, NULL where the text is none; each row by itself."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def calendar(ts: Column) -> dict[str, Column]:
    """Integer parts; Monday is weekday 0."""
    weekday = F.weekday(ts)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "dayofyear": F.dayofyear(ts),
        "weekday": weekday,
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "is_weekend": F.when(weekday >= 5, 1).otherwise(0),
    }


def cyclic(angle: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a phase."""
    turn = F.lit(2 * math.pi) * angle / F.lit(float(period))
    return F.sin(turn), F.cos(turn)


def year_month(year: Column, month: Column) -> Column:
    return (year.cast("int") * 100 + month.cast("int")).cast("int")


def duration(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), two(F.floor(s / 60) % 60), two(s % 60))
