"""Functions of times, in the session's time zone. An array of times goes through each()."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _every(x: Column, unit: str, parent: str, interval: int, seconds: int) -> Column:
    """x cut to a multiple of the interval of units within its parent unit."""
    if interval == 1:
        return F.date_trunc(unit, x)
    top = F.date_trunc(parent, x)
    step = interval * seconds
    return F.timestamp_seconds(F.unix_timestamp(top) + F.floor((F.unix_timestamp(x) - F.unix_timestamp(top)) / step) * step)


def classify_second(x: Column, interval: int = 1) -> Column:
    return _every(x, "second", "minute", interval, 1)


def classify_minute(x: Column, interval: int = 1) -> Column:
    return _every(x, "minute", "hour", interval, 60)


def classify_hour(x: Column, interval: int = 1) -> Column:
    return _every(x, "hour", "day", interval, 3600)


def classify_day(x: Column) -> Column:
    return F.date_trunc("day", x)


def classify_week(x: Column) -> Column:
    """The Sunday at or before."""
    return F.date_sub(F.to_date(x), F.dayofweek(x) - 1).cast("timestamp")


def classify_month(x: Column, interval: int = 1) -> Column:
    return F.make_date(F.year(x), F.floor((F.month(x) - 1) / interval).cast("int") * interval + 1, F.lit(1)).cast("timestamp")


def classify_year(x: Column, interval: int = 1) -> Column:
    return F.make_date(F.floor(F.year(x) / interval).cast("int") * interval, F.lit(1), F.lit(1)).cast("timestamp")


def day_of_week(x: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(x) - 1


def each(x: Column, classify, *arguments) -> Column:
    """classify of every time of an array; a lambda of two parameters would get the place as the second."""
    return F.transform(x, lambda t: classify(t, *arguments))


#: strftime's letters as the date patterns of Spark (fixed values).
_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "j": "DDD", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def format(x: Column, pattern: str) -> Column:
    """strftime."""
    pieces, plain = [], ""
    for m in re.finditer(r"%(.)|([^%]+|%$)", pattern, re.S):
        letter, text = m[1], m[2]
        if letter == "%" or text:
            plain += text or "%"
            continue
        if letter not in _LETTERS:
            raise ValueError(f"no format letter {letter}")
        pieces += [F.lit(plain), F.date_format(x, _LETTERS[letter])]
        plain = ""
    return F.concat(*pieces, F.lit(plain)) if pieces else F.when(x.isNotNull(), F.lit(plain))


def format_iso8601(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
