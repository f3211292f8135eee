"""Dates as sources and prompts show them."""

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_year(seconds: Column) -> Column:
    """The UTC year of seconds since 1970."""
    return F.year(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()))


def spoken_time(ts: Column, minutes: int = 330, zone: str = "IST") -> Column:
    """A UTC wall-clock time at an offset of so many minutes: "Monday, 01 January 2024, 05:30 AM IST"."""
    moved = ts.cast("timestamp_ntz") + F.expr(f"INTERVAL {minutes} MINUTE")
    return F.concat(F.date_format(moved, "EEEE, dd MMMM yyyy, hh:mm a "), F.lit(zone))


def new_batch_id() -> str:
    """A fresh id for an index batch; made on the driver and passed as a constant, so every row has the same."""
    return uuid.uuid4().hex


def elapsed_ms(start: Column, end: Column) -> Column:
    return ((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000).cast("long")
