"""Dates are days, times seconds and datetimes seconds, all counted from 1960-01-01."""

from __future__ import annotations

import datetime as dt
import re

EPOCH = dt.datetime(1960, 1, 1)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def full_year(year: int) -> int:
    """Two-digit years: 00 to 25 are 2000 to 2025, the others 1926 to 1999."""
    return year if year > 99 else 2000 + year if year < 26 else 1900 + year


def _day(text: str) -> float:
    found = re.fullmatch(r"\s*(\d{1,2})\s*-?\s*([A-Za-z]{3})\s*-?\s*(\d{2,4})\s*", text)
    if not found or found[2].lower() not in MONTHS:
        raise ValueError(f"not a date: {text!r}")
    day = dt.datetime(full_year(int(found[3])), MONTHS.index(found[2].lower()) + 1, int(found[1]))
    return float((day - EPOCH).days)


def _seconds(text: str) -> float:
    parts = text.strip().split(":")
    if not 2 <= len(parts) <= 3:
        raise ValueError(f"not a time: {text!r}")
    numbers = [float(p) for p in parts] + [0.0]
    return numbers[0] * 3600 + numbers[1] * 60 + numbers[2]


def date_literal(text: str, kind: str) -> float:
    if kind == "d":
        return _day(text)
    if kind == "t":
        return _seconds(text)
    day, _, rest = text.partition(":")
    return _day(day) * 86400 + (_seconds(rest) if rest else 0)
