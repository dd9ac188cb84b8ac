"""Match files: lines of matched and unmatchable entities, read and written as DataFrames.

Content lines: ``c A B`` and ``cu side id`` for whole entities, then under them, indented by a tab each, ``m A B``, ``f A B``, ``mu side id``
and ``fu side id``, and below those ``ma i j``, ``mv i j``, ``mau side i`` and ``mvu side i``; fields are separated by tabs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lines as numbering

# Tags by their depth of indentation.
TAGS = (("c", "cu"), ("m", "f", "mu", "fu"), ("ma", "mv", "mau", "mvu"))


def parsed(lines: DataFrame) -> DataFrame:
    """(file, line, depth, tag, first, second, owner_a, owner_b, member_a, member_b) from (file, line, value).

    A line belongs to the last line of less depth before it in its file. Lines of other kinds are left out.
    """
    body = F.ltrim("value", F.lit("\t"))
    fields = F.split(body, "\t")
    rows = lines.select("file", "line", (F.length("value") - F.length(body)).alias("depth"), F.get(fields, F.lit(0)).alias("tag"), F.get(fields, F.lit(1)).alias("first"), F.get(fields, F.lit(2)).alias("second"))
    known = F.lit(False)
    for depth, tags in enumerate(TAGS):
        known = known | ((F.col("depth") == depth) & F.col("tag").isin(*tags))
    rows = rows.where(known & F.col("second").isNotNull())
    ends = {f"{name}_{side}": F.when(F.col("depth") == depth, F.col(column)) for depth, name in enumerate(("owner", "member")) for side, column in (("a", "first"), ("b", "second"))}
    found = numbering.carried(rows, ends)
    return found.withColumns({c: F.when(F.col("depth") == 2, F.col(c)) for c in ("member_a", "member_b")})


def strays(lines: DataFrame) -> DataFrame:
    """The rows of ``lines`` (file, line, value) that have an unknown form and come after the first line of content in their file."""
    body = F.ltrim("value", F.lit("\t"))
    fields = F.split(body, "\t")
    known = F.lit(False)
    for depth, tags in enumerate(TAGS):
        known = known | ((F.length("value") - F.length(body) == depth) & F.get(fields, F.lit(0)).isin(*tags) & (F.size(fields) == 3))
    marked = lines.withColumn("_known", known)
    first = marked.where("_known").groupBy("file").agg(F.min("line").alias("_first"))
    return marked.join(first, "file").where("NOT _known AND value <> '' AND line > _first").drop("_known", "_first")


def resolved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(line, kind, a, b, state) of the pairs in ``rows`` (line, kind, a, b, side, id): "unknown" if an end isn't in ``known`` (side, kind, id), "void" if an earlier
    row says that an end can't be matched, else "matched". A pair has a and b, a row of an unmatchable element has side and id."""
    off = rows.where("id IS NOT NULL").groupBy("side", "kind", "id").agg(F.min("line").alias("since"))
    pairs = rows.where("id IS NULL").select("line", "kind", "a", "b")
    for side in ("a", "b"):
        own = known.where(F.col("side") == side).select("kind", F.col("id").alias(side), F.lit(True).alias(f"_{side}")).distinct()
        shut = off.where(F.col("side") == side).select("kind", F.col("id").alias(side), F.col("since").alias(f"_since_{side}"))
        pairs = pairs.join(own, ["kind", side], "left").join(shut, ["kind", side], "left")
    void = F.coalesce(F.col("_since_a") < F.col("line"), F.lit(False)) | F.coalesce(F.col("_since_b") < F.col("line"), F.lit(False))
    state = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown").when(void, "void").otherwise("matched")
    return pairs.select("line", "kind", "a", "b", state.alias("state"))


def header(lines: DataFrame) -> DataFrame:
    """(file, section, ord, size, algorithm, hash, name) of the input files and patterns in the header, from (file, line, value).

    Sections are ``a``, ``b``, ``cp``, ``cp a`` and ``cp b``, with a file a line: its name; or size, SHA-256 and name; or size, algorithm,
    hash and name. A pattern has its key as section (``non-obf cls a`` and so on) and itself as name. The header ends at the
    first line after the file's first one that isn't indented; hashes are base64.
    """
    whole = Window.partitionBy("file")
    first = lines.groupBy("file").agg(F.min("line").alias("first"))
    below = (F.col("line") > F.col("first")) & (F.col("value") != "") & ~F.startswith("value", F.lit("\t"))
    end = lines.join(first, "file").where(below).groupBy("file").agg(F.min("line").alias("end"))
    # only lines of headers are left, so a file's are few
    rows = lines.join(first, "file").join(end, "file", "left").where((F.col("line") > F.col("first")) & (F.col("end").isNull() | (F.col("line") < F.col("end"))))
    title = F.regexp_extract("value", "^\t(a|b|cp|cp a|cp b):$", 1)
    pattern = F.regexp_extract("value", "^\t(non-obf (?:cls|mem) [ab])\t", 1)
    so_far = whole.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"title": title, "pattern": pattern}).withColumn("section", F.last(F.when(F.col("title") != "", F.col("title")), ignorenulls=True).over(so_far))
    fields = F.split(F.substring("value", 3, 1 << 30), "\t")
    n, at = F.size(fields), lambda i: F.get(fields, F.lit(i))
    files = rows.where(F.startswith("value", F.lit("\t\t")) & F.col("section").isNotNull()).select(
        "file", "section", F.col("line").alias("ord"), F.when(n >= 3, at(0).try_cast("long")).alias("size"),
        F.when(n == 3, "SHA256").when(n >= 4, at(1)).alias("algorithm"), F.when(n == 3, at(1)).when(n >= 4, at(2)).alias("hash"), F.element_at(fields, -1).alias("name"),
    )
    none = F.lit(None).cast("string")
    patterns = rows.where("pattern <> ''").select("file", F.col("pattern").alias("section"), F.col("line").alias("ord"), none.cast("long").alias("size"), none.alias("algorithm"), none.alias("hash"), F.substring("value", F.length("pattern") + 3, F.lit(1 << 30)).alias("name"))
    return files.unionByName(patterns)


def header_lines(saved_at: str, files: list[tuple], patterns: dict[str, str] | None = None) -> list[str]:
    """Lines of a header: ``files`` are (section, size, algorithm, hash, name), a handful for each project."""
    out = [f"Matches saved {saved_at}, input files:"]
    for section in ("a", "b", "cp", "cp a", "cp b"):
        out.append(f"\t{section}:")
        out += ["\t\t" + "\t".join(map(str, row[1:])) for row in files if row[0] == section]
    return out + [f"\t{key}\t{value}" for key, value in (patterns or {}).items()]


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Parsed lines of match files, which are read in ranges. Lines of an unknown form are left out, or an error if ``strict``."""
    files = numbering.numbered(spark, path)
    stray = strays(files).first() if strict else None
    if stray:
        raise ValueError(f"no line of a match file: {stray.file}, {stray.line}: {stray.value}")
    return parsed(files)


def lines(owners: DataFrame, members: DataFrame) -> DataFrame:
    """(sort, value): content lines of matched owners (a, b) and their members (owner, kind, a, b), in the order of the file."""
    top = owners.select(F.array(F.col("a"), F.lit(""), F.lit("")).alias("sort"), F.concat_ws("\t", F.lit("c"), "a", "b").alias("value"))
    below = members.select(F.array(F.col("owner"), F.col("kind"), F.col("a")).alias("sort"), F.concat(F.lit("\t"), F.concat_ws("\t", "kind", "a", "b")).alias("value"))
    return top.unionByName(below)


def all_lines(owners: DataFrame, members: DataFrame, variables: DataFrame, off: DataFrame) -> DataFrame:
    """(sort, value): content lines of matched owners (a, b), members (owner, kind, a, b) and variables (owner, member, kind, a, b), kind being ma or mv, and of
    what can't be matched, ``off`` (owner, member, kind, side, id): a class without owner, a member without member. Below a class come its members, below these their variables."""
    none = F.lit("")

    def line(rows: DataFrame, depth: int, owner, member, kind, first, second, tag) -> DataFrame:
        sort = F.array(*[F.coalesce(x, none) for x in (owner, member, kind)], first.cast("string"))
        return rows.select(sort.alias("sort"), F.concat(F.lit("\t" * depth), F.concat_ws("\t", tag, first, second)).alias("value"))

    c, shut = F.col, F.concat(F.col("kind"), F.lit("u"))
    out = line(owners, 0, c("a"), none, none, c("a"), c("b"), F.lit("c"))
    out = out.unionByName(line(members, 1, c("owner"), c("a"), none, c("a"), c("b"), c("kind")))
    out = out.unionByName(line(variables, 2, c("owner"), c("member"), c("kind"), c("a"), c("b"), c("kind")))
    out = out.unionByName(line(off.where("owner IS NULL"), 0, c("id"), none, none, c("side"), c("id"), shut))
    out = out.unionByName(line(off.where("owner IS NOT NULL AND member IS NULL"), 1, c("owner"), c("id"), none, c("side"), c("id"), shut))
    return out.unionByName(line(off.where("member IS NOT NULL"), 2, c("owner"), c("member"), c("kind"), c("side"), c("id"), shut))


def write(content: DataFrame, path: str) -> None:
    """Write ``lines`` as text files whose names follow their order."""
    content.orderBy("sort").select("value").write.text(path)
