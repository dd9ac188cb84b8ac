"""Mapping files in the second tiny format: names of classes, members and variables in several name spaces, as DataFrames.

The first line is ``tiny 2 0`` and the name spaces. Below it, indented by a tab for each level and with fields separated by tabs:
``c`` and a class's names; under a class ``f`` or ``m``, a descriptor and the member's names, or ``c`` and a comment; under a method ``p``, a slot
and an argument's names, ``v``, a slot, the first instruction, an index and a variable's names, or ``c`` and a comment. Names that are equal to the
first one may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lines as numbering

# Kinds by depth and tag, and the place of the first name.
KINDS = {(0, "c"): ("class", 1), (1, "f"): ("field", 2), (1, "m"): ("method", 2), (2, "p"): ("argument", 2), (2, "v"): ("variable", 4)}


def text_of(field: Column) -> Column:
    """A comment's text without the escapes of line ends, tabs and backslashes."""
    marked = F.replace(field, F.lit("\\\\"), F.lit("\0"))
    for mark, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        marked = F.replace(marked, F.lit(mark), F.lit(plain))
    return F.replace(marked, F.lit("\0"), F.lit("\\"))


def escaped(text: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def parsed(lines: DataFrame, source: str, target: str) -> DataFrame:
    """(file, line, kind, class, descriptor, member, slot, src, dst, comment) from (file, line, value).

    ``class`` and ``member`` are names in the first name space; ``src`` and ``dst`` those in the two asked for. A comment's row has
    the kind "comment" and its element's names. A file without either name space, or with a line that fits nowhere, is an error.
    """
    spaces = lines.where(F.startswith("value", F.lit("tiny\t2\t"))).select("file", F.slice(F.split("value", "\t"), 4, 1000).alias("spaces"))
    body = F.ltrim("value", F.lit("\t"))
    # one row a file: met by its name, all lines of a file would be in one task
    rows = lines.where("value <> ''").where(~F.startswith("value", F.lit("tiny\t2\t"))).join(F.broadcast(spaces), "file", "left")
    rows = rows.withColumns({"depth": F.length("value") - F.length(body), "fields": F.split(body, "\t")}).withColumn("tag", F.get("fields", F.lit(0)))
    kind, first = F.lit(None).cast("string"), F.lit(0)
    for (depth, tag), (name, at) in KINDS.items():
        here = (F.col("depth") == depth) & (F.col("tag") == tag)
        kind, first = F.when(here, name).otherwise(kind), F.when(here, at).otherwise(first)
    kind = F.when((F.col("depth") > 0) & (F.col("tag") == "c"), "comment").otherwise(kind)
    wrong = F.raise_error(F.concat(F.lit("no mapping line: "), F.col("value")))
    rows = rows.withColumns({"kind": F.coalesce(kind, wrong.cast("string")), "at": first})

    def named(space: str) -> Column:
        place = F.array_position("spaces", space).cast("int") - 1
        known = F.when(F.coalesce(place, F.lit(-1)) >= 0, place).otherwise(F.raise_error(F.concat(F.lit(f"no name space {space} in "), F.col("file"))).cast("int"))
        own = F.get("fields", F.col("at") + known)
        return F.coalesce(F.when(own != "", own), F.get("fields", F.col("at")))

    plain = F.get("fields", F.col("at"))
    rows = rows.withColumns({"src": F.when(F.col("kind") != "comment", named(source)), "dst": F.when(F.col("kind") != "comment", named(target)), "plain": plain})

    # a class's line ends the member before it
    member = F.when((F.col("depth") == 0) & (F.col("kind") == "class"), F.struct(F.lit(None).cast("string").alias("n"))).when((F.col("depth") == 1) & (F.col("kind") != "comment"), F.struct(F.col("plain").alias("n")))
    rows = numbering.carried(rows, {"class": F.when((F.col("depth") == 0) & (F.col("kind") != "comment"), F.col("plain")), "held": member})
    described = F.when(F.col("kind").isin("field", "method"), F.get("fields", F.lit(1)))
    slot = F.when(F.col("kind").isin("argument", "variable"), F.get("fields", F.lit(1)).try_cast("int"))
    return rows.select(
        "file",
        "line",
        "kind",
        "class",
        described.alias("descriptor"),
        F.when(F.col("depth") > 0, F.col("held.n")).alias("member"),
        slot.alias("slot"),
        "src",
        "dst",
        F.when(F.col("kind") == "comment", text_of(F.get("fields", F.lit(1)))).alias("comment"),
    )


def lines_of(rows: DataFrame) -> DataFrame:
    """(order, value): the lines of ``rows`` (kind, class, descriptor, member, slot, names, comment, order), without the first one.

    ``names`` are those of all name spaces; nulls are written as empty fields. ``order`` sorts the lines; the caller makes it, as it says what
    comes below what.
    """
    names = F.array_join(F.transform("names", lambda n: F.coalesce(n, F.lit(""))), "\t")
    value = F.when(F.col("kind") == "class", F.concat(F.lit("c\t"), names))
    for kind, tag in (("field", "\tf\t"), ("method", "\tm\t")):
        value = F.when(F.col("kind") == kind, F.concat(F.lit(tag), "descriptor", F.lit("\t"), names)).otherwise(value)
    value = F.when(F.col("kind") == "argument", F.concat(F.lit("\t\tp\t"), F.col("slot").cast("string"), F.lit("\t"), names)).otherwise(value)
    value = F.when(F.col("kind") == "variable", F.concat(F.lit("\t\tv\t"), F.col("slot").cast("string"), F.lit("\t-1\t-1\t"), names)).otherwise(value)
    depth = F.when(F.col("member").isNull(), "\t").otherwise("\t\t")
    value = F.when(F.col("kind") == "comment", F.concat(depth, F.lit("c\t"), escaped(F.col("comment")))).otherwise(value)
    return rows.select("order", value.alias("value"))
