"""Column functions for time slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_MINUTES = 10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slots_per_day(slot_minutes: int = SLOT_MINUTES) -> int:
    if 1440 % slot_minutes:
        raise ValueError("slot_minutes must divide a day")
    return 1440 // slot_minutes


def slot_of(ts, slot_minutes: int = SLOT_MINUTES) -> Column:
    """Index of the slot that holds ``ts``: minute of day // slot width."""
    ts = _col(ts)
    return ((F.hour(ts) * 60 + F.minute(ts)) / slot_minutes).cast("int")


def slot_hour(slot, slot_minutes: int = SLOT_MINUTES) -> Column:
    """Hour of the slot start."""
    return ((_col(slot) * slot_minutes) / 60).cast("int")


def slot_minute(slot, slot_minutes: int = SLOT_MINUTES) -> Column:
    """Minute of the slot start (the tap minute floored to the slot width)."""
    return ((_col(slot) * slot_minutes) % 60).cast("int")


def clock_to_slot(clock, slot_minutes: int = SLOT_MINUTES) -> Column:
    """``'H:MM'`` clock text to a slot index."""
    parts = F.split(_col(clock), ":")
    minutes = parts.getItem(0).cast("int") * 60 + parts.getItem(1).cast("int")
    return (minutes / slot_minutes).cast("int")


def clock_minutes(text: str) -> int:
    """Driver-side parse of a literal parameter such as ``'7:30'``."""
    h, m = text.split(":")
    return int(h) * 60 + int(m)


def clock_slot(text: str, slot_minutes: int = SLOT_MINUTES) -> int:
    return clock_minutes(text) // slot_minutes
