"""Order-preserving keys of package versions, so that a range of versions is a comparison of strings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What release words mean beside a plain release (0).
_WORDS = {"dev": -6, "snapshot": -5, "alpha": -4, "a": -4, "beta": -3, "b": -3, "milestone": -3, "m": -3, "rc": -2, "cr": -2, "c": -2, "pre": -2, "preview": -2, "final": 0, "ga": 0, "release": 0, "sp": 1, "post": 1}


def sort_key(version: str | None) -> str | None:
    """Numbers compare as numbers, trailing zeros do not count, pre-releases come before their release, build tags not at all."""
    if version is None or not version.strip():
        return None
    v = re.sub(r"^[vV=]+", "", version.strip()).split("+")[0].lower()
    epoch, _, rest = v.rpartition("!")
    parts = re.findall(r"\d+|[a-z]+", rest)
    out = [f"{int(epoch or 0) if (epoch or '0').isdigit() else 0:04d}"]
    release: list[int] = []
    i = 0
    while i < len(parts) and parts[i].isdigit():
        release.append(int(parts[i]))
        i += 1
    while release and release[-1] == 0:
        release.pop()
    out += [f"{n:012d}" for n in release] + ["!"]
    tail = "".join(f"{(_WORDS.get(p, -1) + 50):02d}." if not p.isdigit() else f"n{int(p):012d}." for p in parts[i:])
    return ".".join(out) + (tail or "50.")


@F.pandas_udf(StringType())
def version_key(version: pd.Series) -> pd.Series:
    return version.map(sort_key)


def in_segment(key: Column, introduced: Column, fixed: Column, last_affected: Column) -> Column:
    """introduced <= key, and key < fixed or key <= last_affected where given; an absent introduced is the start."""
    lower = introduced.isNull() | (key >= introduced)
    return lower & (fixed.isNull() | (key < fixed)) & (last_affected.isNull() | (key <= last_affected))
