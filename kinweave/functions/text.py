"""Parts and forms of names, flags and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_of(name: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(name, "^(.*)/[^/]*$", 1)


def outer_of(name: Column) -> Column:
    """Everything before the last dollar sign that stands at neither end of the simple name; null without one."""
    outer = F.regexp_extract(name, r"^(.*[^/$])\$[^/$]+$", 1)
    return F.when(outer != "", outer)


def inner_of(name: Column) -> Column:
    return F.when(outer_of(name).isNotNull(), F.substring_index(name, "$", -1)).otherwise(F.substring_index(name, "/", -1))


def flag_names(flags: Column, names: tuple[str, ...]) -> Column:
    """Names of the bits that are set, lowest first; what is left beyond them in hexadecimal."""
    known = F.filter(F.array(*[F.when(flags.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    rest = flags - flags.bitwiseAND(F.lit((1 << len(names)) - 1))
    return F.concat_ws(" ", known, F.when(rest != 0, F.concat(F.lit("0x"), F.lower(F.hex(rest)))))


def bucket(similarity: Column, steps: int = 20) -> Column:
    return F.round(similarity * steps) / steps
