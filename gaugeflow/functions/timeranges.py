"""Periods, intervals and time slices as column expressions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.functions.topics import as_col

UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def period(text: str) -> timedelta:
    """``10m``, ``24h``, ``7d``, ``1w`` or ``30 days`` as a timedelta."""
    match = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", text)
    unit = UNITS.get(match.group(2)[0].lower()) if match else None
    if unit is None or match.group(2).lower() not in (unit[0], unit, unit[:-1], "min", "mins", "hr", "hrs", "sec"):
        raise ValueError(f"not a period: {text!r}")
    return timedelta(**{unit: int(match.group(1))})


def interval_literal(text: str) -> Column:
    return F.lit(period(text))


def choose_interval(length: str | timedelta) -> str:
    """Bucket width for a trend: 10 minutes up to a day, an hour up to a week, else a day."""
    length = period(length) if isinstance(length, str) else length
    if length <= timedelta(days=1):
        return "10m"
    return "1h" if length <= timedelta(days=7) else "1d"


def time_bucket(ts, interval: str) -> Column:
    """Start of the tumbling bucket of a timestamp; week buckets start on Monday."""
    width = period(interval)
    weekly = width >= timedelta(days=7) and width % timedelta(days=7) == timedelta(0)
    window = F.window(as_col(ts), f"{int(width.total_seconds())} seconds", startTime="4 days" if weekly else "0 seconds")
    return window["start"]


def time_slice(ts, seconds: int) -> Column:
    """Number of the fixed-width time slice of a timestamp.

    Slices cut the rows of one busy key into pieces that separate tasks can
    sort and scan; see the operators that stitch slices together.
    """
    micros = F.unix_micros(as_col(ts).cast("timestamp"))
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint")


def latest(df: DataFrame, ts: str = "ts") -> Column:
    """Newest timestamp of a DataFrame as a scalar subquery."""
    return df.agg(F.max(ts)).scalar()
