"""Mapping files of several formats, each as rows of names on two sides, and such rows as lines of them.

Rows have (file, line, kind, class, descriptor, member, slot, src, dst, comment), as ``mappingfile.parsed`` gives them: ``class`` and ``member`` are
first names, ``src`` and ``dst`` the element's own on both sides, whole ones for classes; ``dst`` is the first name where a file gives none. What is below a member
has that member's descriptor, as far as it is told.

============ =====================================================================================================
tiny         ``v1`` and name spaces; ``CLASS``, ``FIELD`` and ``METHOD`` lines with tabs, members with owner and descriptor
srg          ``CL: a b``, ``FD: a/f b/g``, ``MD: a/m desc b/n desc``
tsrg         ``a b``; below it, indented by a tab, ``f g`` or ``m desc n``; below a method, by two, ``slot name name``. A first line ``tsrg2`` names the spaces
enigma       ``CLASS a b``, nested by tabs as classes are; below ``FIELD f g desc``, ``METHOD m n desc``, ``ARG slot name``, ``COMMENT text``
proguard     ``a.B -> c:``; below it ``type f -> g`` and ``1:2:type m(types) -> n``
============ =====================================================================================================

Empty lines and lines that start with ``#`` are left out; another line that fits nowhere is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.storage import shuffled

from . import lines, mappingfile

COLUMNS = ("file", "line", "kind", "class", "descriptor", "member", "slot", "src", "dst", "comment")
# Letters of plain types in descriptors.
PLAIN = {"void": "V", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D"}


def none() -> Column:
    return F.lit(None).cast("string")


def at(i: int) -> Column:
    return F.get("fields", F.lit(i))


def chosen(cases: dict[str, Column]) -> Column:
    """The name of the first of ``cases`` that holds."""
    return F.coalesce(*[F.when(condition, name) for name, condition in cases.items()])


def body(rows: DataFrame, separator: str) -> DataFrame:
    """``rows`` with the depth of their indentation by tabs and their fields."""
    text = F.ltrim("value", F.lit("\t"))
    rows = rows.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    return rows.withColumns({"depth": F.length("value") - F.length(text), "fields": F.split(text, separator), "tag": F.substring_index(text, separator, 1)})


def finished(rows: DataFrame) -> DataFrame:
    """Rows in their final form; one without a kind fits nowhere."""
    wrong = F.raise_error(F.concat(F.lit("no mapping line: "), F.col("value"))).cast("string")
    rows = rows.withColumns({"kind": F.coalesce("kind", wrong), "dst": F.when(F.col("kind") != "comment", F.coalesce(F.when(F.col("dst") != "", F.col("dst")), "src"))})
    return rows.select(*COLUMNS)


def owner_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def tiny(rows: DataFrame) -> DataFrame:
    rows = body(rows, "\t").where("tag <> 'v1'")
    kind = F.when(F.col("tag").isin("CLASS", "FIELD", "METHOD") & (F.size("fields") >= F.when(F.col("tag") == "CLASS", 2).otherwise(4)), F.lower("tag"))
    own = F.col("tag") == "CLASS"
    return finished(rows.select("file", "line", "value", kind.alias("kind"), at(1).alias("class"), F.when(~own, at(2)).alias("descriptor"), F.when(~own, at(3)).alias("member"),
        F.lit(None).cast("int").alias("slot"), F.when(own, at(1)).otherwise(at(3)).alias("src"), F.when(own, at(2)).otherwise(at(4)).alias("dst"), none().alias("comment")))


def srg(rows: DataFrame) -> DataFrame:
    """A field's descriptor isn't told in this format."""
    rows = body(rows, " ").where("tag <> 'PK:'")
    kinds = {"CL:": ("class", 3), "FD:": ("field", 3), "MD:": ("method", 5)}
    kind = chosen({k: (F.col("tag") == t) & (F.size("fields") == n) for t, (k, n) in kinds.items()})
    rows = rows.withColumns({"kind": kind, "other": F.when(F.col("tag") == "MD:", at(3)).otherwise(at(2))})
    own = F.col("kind") == "class"
    return finished(rows.select("file", "line", "value", "kind", F.when(own, at(1)).otherwise(owner_of(at(1))).alias("class"), F.when(F.col("kind") == "method", at(2)).alias("descriptor"),
        F.when(~own, name_of(at(1))).alias("member"), F.lit(None).cast("int").alias("slot"), F.when(own, at(1)).otherwise(name_of(at(1))).alias("src"),
        F.when(own, F.col("other")).otherwise(name_of("other")).alias("dst"), none().alias("comment")))


def tsrg(rows: DataFrame) -> DataFrame:
    """With more than two name spaces the first two count. The second form may tell a field's descriptor, as a method's; a name with one is a method if it starts with a bracket."""
    described = F.substring(at(1), 1, 1) == "("
    typed = (F.size("fields") >= 3) & at(1).rlike(r"^\[*([ZBCSIJFD]|L.*;)$")
    cases = {"class": (F.col("depth") == 0) & (F.size("fields") >= 2), "method": (F.col("depth") == 1) & described, "field": (F.col("depth") == 1) & (F.size("fields") >= 2), "argument": (F.col("depth") == 2) & (F.size("fields") >= 3)}

    def made(rows: DataFrame) -> DataFrame:
        rows = body(rows, " ").where("NOT (tag = 'tsrg2' AND line = 0)").where("NOT (depth = 2 AND tag = 'static' AND size(fields) = 1)")
        return rows.withColumn("kind", chosen(cases)).withColumn("longer", (F.col("depth") == 1) & (described | typed))

    rows = lines.carried(rows, {"class": (F.col("depth") == 0, F.col("tag")), "held": (F.col("depth") == 1, F.struct(at(0).alias("name"), F.when(F.col("longer"), at(1)).alias("described")))}, made=made, gaps=False)
    return finished(rows.select("file", "line", "value", "kind", "class", F.when(F.col("depth") > 0, F.col("held.described")).alias("descriptor"), F.when(F.col("depth") > 0, F.col("held.name")).alias("member"),
        F.when(F.col("depth") == 2, at(0).try_cast("int")).alias("slot"), F.when(F.col("depth") == 2, at(1)).otherwise(at(0)).alias("src"),
        F.when(F.col("longer") | (F.col("depth") == 2), at(2)).otherwise(at(1)).alias("dst"), none().alias("comment")))


def enigma(rows: DataFrame) -> DataFrame:
    """A nested class's name is put behind its outer one's on both sides. An access in front of the line's end (``ACC:``) is left out."""

    def made(rows: DataFrame) -> DataFrame:
        return body(rows, " ").withColumn("fields", F.when(F.contains("value", F.lit("ACC:")), F.filter("fields", lambda f: ~f.startswith("ACC:"))).otherwise(F.col("fields")))

    deepest = body(rows, " ").where("tag = 'CLASS'").agg(F.max("depth")).first()[0] or 0
    is_class, n = F.col("tag") == "CLASS", F.size("fields")
    new = F.coalesce(at(2), at(1))
    values = {f"level{d}": (is_class & (F.col("depth") == d), F.struct(at(1).alias("a"), new.alias("b"), F.col("line").alias("at"))) for d in range(deepest + 1)}
    rows = lines.carried(rows, values | {"held": (F.col("tag").isin("METHOD", "FIELD"), F.struct(at(1).alias("name"), F.element_at("fields", -1).alias("described"), F.col("depth").alias("d"), F.col("line").alias("at"))), "opened": (is_class, F.col("line"))}, made=made, gaps=False)
    # members of a class are one deeper than it; what is below a member is two deeper
    above = F.when(is_class, F.col("depth")).when(F.col("tag").isin("METHOD", "FIELD"), F.col("depth") - 1)
    below = (F.col("held.d") < F.col("depth")) & (F.col("held.at") > F.col("opened"))
    above = F.coalesce(above, F.when(below, F.col("held.d") - 1).otherwise(F.col("depth") - 1))
    rows = rows.withColumn("above", above)
    path = lambda part: F.concat_ws("$", *[F.when(F.col("above") >= d, F.col(f"level{d}.{part}")) for d in range(deepest + 1)])
    cases = {
        "class": is_class & (n >= 2), "field": (F.col("tag") == "FIELD") & (n >= 3), "method": (F.col("tag") == "METHOD") & (n >= 3),
        "argument": (F.col("tag") == "ARG") & (n == 3), "comment": F.col("tag") == "COMMENT",
    }
    rows = rows.withColumns({"kind": chosen(cases), "class": path("a"), "named": path("b")})
    member = F.col("kind").isin("field", "method")
    inside = member | (F.col("kind") == "argument") | ((F.col("kind") == "comment") & below)
    return finished(rows.select("file", "line", "value", "kind", "class", F.when(inside, F.col("held.described")).alias("descriptor"), F.when(inside, F.col("held.name")).alias("member"), F.when(F.col("kind") == "argument", at(1).try_cast("int")).alias("slot"),
        F.when(is_class, F.col("class")).when(member, at(1)).alias("src"), F.when(is_class, F.col("named")).when(member & (n > 3), at(2)).when(F.col("kind") == "argument", at(2)).alias("dst"),
        F.when(F.col("kind") == "comment", mappingfile.text_of(F.array_join(F.slice("fields", 2, 1 << 30), " "))).alias("comment")))


def descriptor_of(java: Column) -> Column:
    """A type's descriptor from how it is written in source, with brackets behind it."""
    bare = F.regexp_replace(java, r"\[\]", "")
    letters = F.create_map(*[F.lit(x) for pair in PLAIN.items() for x in pair])
    return F.concat(F.repeat(F.lit("["), ((F.length(java) - F.length(bare)) / 2).cast("int")), F.coalesce(F.try_element_at(letters, bare), F.concat(F.lit("L"), F.replace(bare, F.lit("."), F.lit("/")), F.lit(";"))))


def proguard(rows: DataFrame) -> DataFrame:
    """Of a method's line numbers nothing is kept, so an inlined method's rows repeat; rows of a method of another class keep that class in their name and are left out."""
    rows = rows.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    is_class = F.col("value").rlike(r"^\S+ -> \S+:$")
    part = lambda i: F.regexp_extract("value", r"^\s+(?:\d+:\d+:)?(\S+) ([^\s(]+)(\([^)]*\))?(?::\d+)*? -> (\S+)$", i)
    rows = rows.withColumns({"kind": F.when(is_class, "class").when(part(3) != "", "method").when(part(2) != "", "field"), "own": F.replace(F.split("value", " -> ")[0], F.lit("."), F.lit("/"))})
    rows = lines.carried(rows, {"class": (is_class, F.col("own"))}, gaps=False).where(~F.contains(part(2), F.lit(".")) | F.col("kind").isNull() | is_class)
    inside = F.regexp_extract(part(3), r"^\((.*)\)$", 1)
    arguments = F.when(inside == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(inside, ","), lambda t: descriptor_of(F.trim(t))), ""))
    described = F.when(F.col("kind") == "field", descriptor_of(part(1))).when(F.col("kind") == "method", F.concat(F.lit("("), arguments, F.lit(")"), descriptor_of(part(1))))
    to = F.when(is_class, F.replace(F.regexp_extract("value", r" -> (\S+):$", 1), F.lit("."), F.lit("/"))).otherwise(part(4))
    return finished(rows.select("file", "line", "value", "kind", "class", described.alias("descriptor"), F.when(~is_class, part(2)).alias("member"), F.lit(None).cast("int").alias("slot"),
        F.when(is_class, F.col("own")).otherwise(part(2)).alias("src"), to.alias("dst"), none().alias("comment")))


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"tiny": tiny, "srg": srg, "tsrg": tsrg, "enigma": enigma, "proguard": proguard}


def read(spark: SparkSession, path: str, form: str, source: str | None = None, target: str | None = None) -> DataFrame:
    """Rows of the mapping files under ``path``. The second tiny format ("tiny2") has name spaces of its own to choose from."""
    found = lines.numbered(spark, path)
    return mappingfile.parsed(found, source or "official", target or "named") if form == "tiny2" else FORMATS[form](found)


def with_outers(rows: DataFrame) -> DataFrame:
    """``rows`` and those of the outer classes that have none, under their own names."""
    parts = F.split("src", r"\$")
    outer = rows.where("kind = 'class'").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "$"))).alias("src")).distinct()
    lacking = outer.join(rows.where("kind = 'class'").select("src"), "src", "left_anti")
    made = lacking.select(F.lit("class").alias("kind"), F.col("src").alias("class"), none().alias("descriptor"), none().alias("member"), F.lit(None).cast("int").alias("slot"), "src", F.col("src").alias("dst"), none().alias("comment"))
    return rows.select(made.columns).unionByName(made)


def written(rows: DataFrame, form: str) -> DataFrame:
    """(order, value): lines of ``rows`` (kind, class, descriptor, member, slot, src, dst, comment) in the formats tiny, srg, tsrg or enigma, in no more than the format can tell.

    ``order`` puts each line below what it belongs to. Members' classes have rows of their own, but for nested ones' outer classes.
    """
    kinds = {"tiny": ("class", "field", "method"), "srg": ("class", "field", "method"), "tsrg": ("class", "field", "method"), "enigma": ("class", "field", "method", "argument", "comment")}[form]
    rows = (with_outers(rows) if form == "enigma" else rows).where(F.col("kind").isin(*kinds))
    if form == "srg":
        # the only format whose members have their owner's name on both sides
        named = rows.where("kind = 'class'").groupBy("class").agg(F.min("dst").alias("owner"))
        rows = rows.join(shuffled(named), "class", "left").withColumn("owner", F.coalesce("owner", "class"))
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("=") else F.coalesce(F.col(p[1:]).cast("string"), F.lit("")) for p in parts])
    kind = F.col("kind")
    if form == "tiny":
        value = F.when(kind == "class", of("CLASS\t", "=src", "\t", "=dst")).otherwise(F.concat(F.upper("kind"), of("\t", "=class", "\t", "=descriptor", "\t", "=src", "\t", "=dst")))
    elif form == "srg":
        value = F.when(kind == "class", of("CL: ", "=src", " ", "=dst")).when(kind == "field", of("FD: ", "=class", "/", "=src", " ", "=owner", "/", "=dst"))
        value = value.otherwise(of("MD: ", "=class", "/", "=src", " ", "=descriptor", " ", "=owner", "/", "=dst", " ", "=descriptor"))
    elif form == "tsrg":
        value = F.when(kind == "class", of("=src", " ", "=dst")).when(kind == "field", of("\t", "=src", " ", "=dst")).otherwise(of("\t", "=src", " ", "=descriptor", " ", "=dst"))
    else:
        depth = F.size(F.split("class", r"\$")) - 1 + F.when(kind == "class", 0).when(kind.isin("field", "method"), 1).when(F.col("member").isNull(), 1).otherwise(2)
        short = {c: F.substring_index(c, "$", -1) for c in ("src", "dst")}
        nested = F.contains("class", F.lit("$"))
        own = F.concat(F.lit("CLASS "), F.when(nested, short["src"]).otherwise(F.col("src")), F.lit(" "), F.when(nested, short["dst"]).otherwise(F.col("dst")))
        rest = F.when(kind == "argument", of("ARG ", "=slot", " ", "=dst")).when(kind == "comment", F.concat(F.lit("COMMENT "), mappingfile.escaped(F.col("comment"))))
        rest = rest.otherwise(F.concat(F.upper("kind"), of(" ", "=src", " ", "=dst", " ", "=descriptor")))
        value = F.concat(F.repeat(F.lit("\t"), depth), F.when(kind == "class", own).otherwise(rest))
    level = F.when(kind == "class", 0).when((kind == "comment") & F.col("member").isNull(), 1).when(kind == "field", 2).otherwise(3)
    member_kind = F.when(F.col("member").isNull(), 0).when(kind == "field", 2).otherwise(3)
    below = F.when(kind.isin("class", "field", "method"), 0).when(kind == "comment", 1).otherwise(2)
    order = F.struct(F.split("class", r"\$").alias("path"), F.when(level < 2, level).otherwise(member_kind).alias("level"), F.coalesce("member", F.lit("")).alias("member"),
        F.coalesce("descriptor", F.lit("")).alias("descriptor"), below.alias("below"), F.coalesce("slot", F.lit(0)).alias("slot"), "value")
    return rows.withColumn("value", value).select(order.alias("order"), "value")


def write(rows: DataFrame, path: str, form: str) -> None:
    """Write ``written`` lines as text files whose names follow their order; a class and what is below it may be cut by a file's end only in flat formats.

    TSRG files have a range of classes each, Enigma files one of outermost classes.
    """
    found = written(rows, form)
    if form in ("tiny", "srg"):
        found.orderBy("order").select("value").write.text(path)
    else:
        found.repartitionByRange(F.col("order.path")[0] if form == "enigma" else F.col("order.path")).sortWithinPartitions("order").select("value").write.text(path)
