"""Byte-range changes of contents, as a file system's write and truncate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(content: Column, size: Column) -> Column:
    """The first ``size`` bytes; a shorter content grows by zero bytes."""
    return F.rpad(content, size, F.unhex(F.lit("00")))


def written(content: Column, data: Column, at: Column) -> Column:
    """``data`` over the bytes from ``at`` (0 is the first) on; a gap is filled
    by zero bytes, what lies behind stays."""
    head = F.rpad(content, at, F.unhex(F.lit("00")))
    return F.concat(head, data, F.substr(content, at + F.length(data) + 1))
