"""Ids, names and descriptors of types, and flags by the kind of element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Primitive types by their letter, and the flags with the kinds of element that have them.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void", "Z": "boolean"}
KINDS = {"class": 1, "method": 2, "field": 4, "parameter": 8, "inner": 16}
FLAGS = (
    (0x0001, "public", 7),
    (0x0002, "private", 7),
    (0x0004, "protected", 7),
    (0x0008, "static", 6),
    (0x0010, "final", 15),
    (0x0020, "super", 1),
    (0x0020, "synchronized", 2),
    (0x0040, "volatile", 4),
    (0x0040, "bridge", 2),
    (0x0080, "varargs", 2),
    (0x0080, "transient", 4),
    (0x0100, "native", 2),
    (0x0200, "interface", 1),
    (0x0400, "abstract", 3),
    (0x0800, "strict", 2),
    (0x1000, "synthetic", 15),
    (0x2000, "annotation", 1),
    (0x4000, "enum", 21),
    (0x8000, "mandated", 8),
)
RECORD = 0x10000

#: One type in a descriptor.
TYPE = r"\[*(?:L[^;]*;|[BCDFIJSVZ])"


def id_of(name: Column) -> Column:
    """The id of a class by its name; arrays are their own id, and an empty name has none."""
    return F.when(name.startswith("["), name).when(name != "", F.concat(F.lit("L"), name, F.lit(";")))


def name_of(id_: Column) -> Column:
    return F.when(id_.startswith("L"), F.substring(id_, F.lit(2), F.length(id_) - 2)).otherwise(id_)


def dimensions(id_: Column) -> Column:
    return F.length(id_) - F.length(F.ltrim(id_, F.lit("[")))


def element_of(id_: Column) -> Column:
    """The id without the dimensions of an array."""
    return F.ltrim(id_, F.lit("["))


def is_primitive(id_: Column) -> Column:
    return ~(id_.startswith("L") | id_.startswith("["))


def slot_size(id_: Column) -> Column:
    return F.when(id_.startswith("D") | id_.startswith("J"), 2).otherwise(1)


def display(id_: Column, full: bool = True, name: Column | None = None) -> Column:
    """How a type is shown: primitives spelled out, dots between packages, brackets for each dimension.

    ``name`` is the element's name in another name space; by default the one in its id. The short form begins after the last dot.
    """
    element = element_of(id_)
    plain = F.translate(name_of(element) if name is None else name, "/", ".")
    for letter, word in PRIMITIVES.items():
        plain = F.when(element == letter, word).otherwise(plain)
    shown = F.concat(plain, F.repeat(F.lit("[]"), dimensions(id_)))
    return shown if full else F.substring_index(shown, ".", -1)


def arguments(descriptor: Column) -> Column:
    """The ids of a method's arguments, in order."""
    return F.regexp_extract_all(F.regexp_extract(descriptor, r"^\((.*)\)", 1), F.lit(f"({TYPE})"), F.lit(1))


def result(descriptor: Column) -> Column:
    """The id of what a method returns, or of a field's type."""
    return F.substring_index(descriptor, ")", -1)


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^\p{javaJavaIdentifierStart}\p{javaJavaIdentifierPart}*$")


def flags_of(flags: Column, kind: str) -> Column:
    """Names of the flags that an element of this kind has, in fixed order, and what is left in hexadecimal; a bit is named once."""
    own = [(bit, name) for bit, name, kinds in FLAGS if kinds & KINDS[kind]]
    known = F.filter(F.array(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in own]), lambda x: x.isNotNull())
    rest = flags.bitwiseAND(F.lit(~sum({bit for bit, _ in own})))
    return F.concat_ws(" ", known, F.when(rest != 0, F.concat(F.lit("0x"), F.lower(F.hex(rest)))))


def effective_flags(flags: Column, parent: Column) -> Column:
    """A class's flags with that of records, by its parent's name; a class that isn't known (null flags) is public."""
    record = F.coalesce(parent == "java/lang/Record", F.lit(False))
    return F.coalesce(flags, F.lit(1)).bitwiseOR(F.when(record, RECORD).otherwise(0))
