"""Paths, prefixes and calendar parts."""

from __future__ import annotations

import os
import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = timedelta(hours=23, minutes=59, seconds=59)


def under(path: Column, directory: str) -> Column:
    """Whether a path lies below a directory ('' is the root)."""
    return F.lit(True) if not directory else F.startswith(path, F.lit(directory.rstrip("/") + "/"))


def below(path: Column, directory: str) -> Column:
    return path if not directory else F.substring(path, len(directory.rstrip("/")) + 2, 1 << 30)


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def ancestors(path: Column) -> Column:
    """'' and every directory above a path, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def overlap(a: Column, b: Column) -> Column:
    """Whether one path is the other or lies below it."""
    x, y = (F.concat(F.regexp_replace(c, "/+$", ""), F.lit("/")) for c in (a, b))
    return F.startswith(x, y) | F.startswith(y, x)


def paths_overlap(a: str, b: str) -> bool:
    x, y = (os.path.abspath(p).rstrip("/") + "/" for p in (a, b))
    return x.startswith(y) or y.startswith(x)


def day_end(day: Column) -> Column:
    """Inclusive cutoff of a day's snapshot: 23:59:59 UTC."""
    return F.to_timestamp_ntz(day) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def resolve(path: str) -> tuple[str, datetime | None, str]:
    """(kind, cutoff, rest) of ``live/...`` and ``snapshots/...`` paths. Kinds:
    root, live, snapshots, year, month, latest, day."""
    parts = [p for p in path.split("/") if p]
    if not parts:
        return "root", None, ""
    if parts[0] == "live":
        return "live", None, "/".join(parts[1:])
    if parts[0] != "snapshots":
        raise FileNotFoundError(path)
    if len(parts) == 1:
        return "snapshots", None, ""
    if parts[1] == "latest":
        return "latest", None, "/".join(parts[2:])
    if not re.fullmatch(r"\d{4}", parts[1]):
        raise FileNotFoundError(path)
    if len(parts) == 2:
        return "year", None, parts[1]
    if not re.fullmatch(r"0[1-9]|1[0-2]", parts[2]):
        raise FileNotFoundError(path)
    if len(parts) == 3:
        return "month", None, "/".join(parts[1:3])
    try:
        cutoff = datetime.strptime("-".join(parts[1:4]), "%Y-%m-%d") + DAY
    except ValueError:
        raise FileNotFoundError(path) from None
    return "day", cutoff, "/".join(parts[4:])


def date_valid(year: Column, month: Column, day: Column) -> Column:
    ok = year.rlike(r"^\d{4}$") & month.rlike(r"^(0[1-9]|1[0-2])$") & day.rlike(r"^(0[1-9]|[12]\d|3[01])$")
    return ok & F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").isNotNull()
