"""Names from mapping rows: their way onto classes, hierarchies and variables, and what of them is written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import descriptors
from kinweave.functions.text import inner_of
from kinweave.storage import shuffled, tasks_for


def chosen(rows: DataFrame, key: str, replace: bool) -> DataFrame:
    """(key, dst): of several rows (key, dst, line) the first counts, or the last if each replaces what was there."""
    pick = F.max_by if replace else F.min_by
    return rows.where(F.col("dst").isNotNull()).groupBy(key).agg(pick("dst", "line").alias("dst"))


def named_classes(classes: DataFrame, rows: DataFrame, column: str = "mapped", replace: bool = False) -> DataFrame:
    """``classes`` (src, column, ...) with the names of ``rows`` (src, dst, line), nested ones without their outer class.

    A class keeps the name it has unless ``replace``; ``known``, if there is such a column, is its partner's name and counts as one.
    """
    new = chosen(rows, "src", replace).select("src", inner_of_nested(F.col("dst")).alias("_new"))
    has = F.col(column).isNotNull() | (F.col("known").isNotNull() if "known" in classes.columns else F.lit(False))
    value = F.when(F.col("_new").isNotNull() & (F.lit(replace) | ~has), F.col("_new")).otherwise(F.col(column))
    return classes.join(new, "src", "left").withColumn(column, value).drop("_new")


def inner_of_nested(name: Column) -> Column:
    """The inner name of a nested class; other names are whole, with their package."""
    return F.when(name.rlike(r"[^/$]\$[^/$]"), inner_of(name)).otherwise(name)


def uid_in(name: Column, prefix: str) -> Column:
    """The number after ``prefix``, for a nested name after the prefix's last part; null if the name is of another form."""
    short = prefix.rpartition("/")[2]
    inner = F.substring_index(name, "$", -1)
    digits = F.when(F.contains(name, F.lit("$")) & inner.startswith(short), F.substring(inner, F.lit(len(short) + 1), F.length(inner)))
    digits = F.when(~F.contains(name, F.lit("$")) & name.startswith(prefix), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(digits)
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("long"))


def numbered_classes(classes: DataFrame, rows: DataFrame, prefix: str, replace: bool = False) -> DataFrame:
    """``classes`` (src, uid, ...) with the ids of ``rows`` (src, dst, line): the smaller one counts, or the last row's if it replaces."""
    ids = rows.select("src", "line", uid_in(F.col("dst"), prefix).alias("n")).where("n IS NOT NULL")
    new = ids.groupBy("src").agg((F.max_by("n", "line") if replace else F.min("n")).alias("_new"))
    lower = (F.coalesce("uid", F.lit(-1)) < 0) | (F.col("uid") > F.col("_new")) | F.lit(replace)
    return classes.join(new, "src", "left").withColumn("uid", F.when(F.col("_new").isNotNull() & lower, F.col("_new")).otherwise(F.col("uid"))).drop("_new")


def named_members(members: DataFrame, rows: DataFrame, column: str = "mapped", replace: bool = False) -> DataFrame:
    """``members`` (id, grouped, column, ...) with the names of ``rows`` (id, dst, line), which go to whole hierarchies (grouped)."""
    of_group = rows.join(members.select("id", "grouped"), "id")
    new = chosen(of_group, "grouped", replace).withColumnRenamed("dst", "_new")
    has = members.groupBy("grouped").agg(F.min(column).alias("_has"))
    value = F.when(F.col("_new").isNotNull() & (F.lit(replace) | F.col("_has").isNull()), F.col("_new")).otherwise(F.col(column))
    return members.join(new, "grouped", "left").join(has, "grouped", "left").withColumn(column, value).drop("_new", "_has")


def variable_rows(rows: DataFrame, variables: DataFrame, tasks: int | None = None) -> DataFrame:
    """(line, id): the variable that each row (line, owner, argument, index, slot, entry) means, null if none does.

    An argument is known by its index if that isn't -1. Others are known by their entry in the table of variables, or else by their slot.
    A row is void if an index or slot is out of range, or if slot or entry contradict the variable found. ``variables`` are
    (id, owner, argument, index, slot, entry).

    Both tables are dealt to as many ``tasks`` as their rows need, by owner to be counted and by place to meet; tables that are dealt by owner already aren't shuffled for the first.
    """
    tasks = tasks or tasks_for(rows.sparkSession, rows.count() + variables.count())
    rows, place = rows.repartition(tasks, "owner"), ["owner", "argument", "how", "at"]
    counts = variables.repartition(tasks, "owner").groupBy("owner").agg(F.count_if("argument").alias("n_args"), F.count_if(~F.col("argument")).alias("n_others"))
    rows = rows.join(shuffled(counts), "owner", "left")
    n = F.coalesce(F.when(F.col("argument"), F.col("n_args")).when(~F.col("argument"), F.col("n_others")), F.lit(0))
    n_args = F.coalesce("n_args", F.lit(0))
    void = (F.col("index") >= n_args) | (F.col("argument") & (F.col("index") < -1)) | (F.col("slot") < -1) | (F.col("slot") >= 2 * n + 1) | (F.col("entry") < -1)
    by_index = F.col("argument") & (F.col("index") != -1)
    how = F.when(void, None).when(by_index, "index").when(F.col("entry") >= 0, "entry").when(F.col("slot") >= 0, "slot")
    at = F.when(how == "index", F.col("index")).when(how == "entry", F.col("entry")).when(how == "slot", F.col("slot"))
    keyed = rows.select("line", "owner", "argument", F.col("slot").alias("want_slot"), F.col("entry").alias("want_entry"), how.alias("how"), at.alias("at"))
    held = variables.select("id", "owner", "argument", "slot", "entry", F.explode(F.create_map(F.lit("index"), "index", F.lit("entry"), "entry", F.lit("slot"), "slot")).alias("how", "at"))
    first = held.repartition(tasks, *place).groupBy(*place).agg(F.min_by(F.struct("id", "slot", "entry"), "id").alias("v"))
    joined = keyed.repartition(tasks, *place).join(shuffled(first), place, "left")
    fits = ((F.col("want_slot") == -1) | (F.col("v.slot") == F.col("want_slot"))) & ((F.col("want_entry") == -1) | (F.col("v.entry") == F.col("want_entry")))
    return joined.select("line", F.when(fits, F.col("v.id")).alias("id"))


def statistics(rows: DataFrame) -> DataFrame:
    """(kind, n_names, n_comments) over mapping rows (kind, dst, comment)."""
    return rows.groupBy("kind").agg(F.count("dst").alias("n_names"), F.count("comment").alias("n_comments"))


def cleared(elements: DataFrame) -> DataFrame:
    """``elements`` without mapped names and comments; auxiliary names and ids stay."""
    return elements.withColumns({c: F.lit(None).cast(elements.schema[c].dataType) for c in ("mapped", "comment") if c in elements.columns})


def record_names(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a record's field and its accessor with one mapped name for both.

    They have field_, method_ columns disguised, mapped and full (the name that counts). The method takes the field's name if it is disguised and the field isn't, or
    the field has a mapped name, or the method hasn't; else the field takes the method's. Pairs with equal names, or without a disguised end, stay.
    """
    differ = ~F.col("field_full").eqNullSafe(F.col("method_full")) & (F.col("field_disguised") | F.col("method_disguised"))
    to_method = differ & F.col("method_disguised") & (~F.col("field_disguised") | F.col("method_mapped").isNull() | F.col("field_mapped").isNotNull())
    return pairs.withColumns(
        {
            "method_mapped": F.when(to_method, F.col("field_full")).otherwise(F.col("method_mapped")),
            "field_mapped": F.when(differ & ~to_method, F.col("method_full")).otherwise(F.col("field_mapped")),
        }
    )


def propagated_arguments(arguments: DataFrame, order: str = "id") -> DataFrame:
    """``arguments`` (id, grouped, index, mapped): nulls take the first name of an argument with their index in their hierarchy."""
    first = arguments.where("mapped IS NOT NULL").groupBy("grouped", "index").agg(F.min_by("mapped", order).alias("_first"))
    return arguments.join(first, ["grouped", "index"], "left").withColumn("mapped", F.coalesce("mapped", "_first")).drop("_first")


def exported_methods(methods: DataFrame, verbosity: str) -> DataFrame:
    """The ``methods`` to be written: (id, grouped, root, src, names, comment, n_variables, ord) with ``names`` in the other name spaces.

    A method without a source name never is. One with a comment, or with arguments or variables to write, always is. Others need a name that
    differs from the source name, and then "full" writes all, "roots" those at the root of their hierarchy or alone in it,
    and "minimal" of a hierarchy of several the first root only, in the order of ``ord``. Methods written for other reasons don't use up their hierarchy.

    Methods are dealt by hierarchy to as many tasks as their rows need, and all is done inside these.
    """
    columns = methods.columns
    methods = methods.repartition(tasks_for(methods.sparkSession, methods.count()), "grouped")
    differs = F.exists("names", lambda n: n.isNotNull() & (n != F.col("src")))
    forced = F.col("comment").isNotNull() | (F.col("n_variables") > 0)
    sized = methods.where("src IS NOT NULL").join(shuffled(methods.groupBy("grouped").agg(F.count("*").alias("_size"))), "grouped")
    sized = sized.withColumns({"_named": differs, "_forced": forced})
    by_name = F.lit(True) if verbosity == "full" else (F.col("_size") == 1) | F.col("root")
    if verbosity == "minimal":
        first = sized.where("_named AND NOT _forced AND _size > 1 AND root").groupBy("grouped").agg(F.min("ord").alias("_first"))
        sized = sized.join(shuffled(first), "grouped", "left")
        by_name = (F.col("_size") == 1) | (F.col("ord") == F.col("_first"))
    return sized.where(F.col("_forced") | (F.col("_named") & F.coalesce(by_name, F.lit(False)))).select(*columns)


def exported_variables(variables: DataFrame) -> DataFrame:
    """The ``variables`` (src, names, comment) to be written: with a comment, or a name that isn't the source name."""
    return variables.where(F.col("comment").isNotNull() | F.exists("names", lambda n: n.isNotNull() & ~n.eqNullSafe(F.col("src"))))


def descriptors_in(rows: DataFrame, names: DataFrame, key: str, descriptor: str = "descriptor", strict: bool = True) -> DataFrame:
    """(key, renamed): each row's descriptor with the classes' names (name, full) in another name space.

    A class without a name there makes the whole null if ``strict``; else, as in a renamed view of references, it stays as it is.
    """
    return descriptors_both(rows, names, key, descriptor).select(key, F.col("strict" if strict else "view").alias("renamed"))


def descriptors_both(rows: DataFrame, names: DataFrame, key: str, descriptor: str = "descriptor") -> DataFrame:
    """(key, strict, view): as ``descriptors_in`` gives them, strict and not, by one way to the names and back. The key isn't null.

    Only a descriptor's different classes go to the names, with the key and their place among these. Names found come back by a window, which sorts
    by key and holds one descriptor at a time, and meet the rows where these are. Of several names of a class the smallest counts.
    """
    token = f"([()]|{descriptors.TYPE})"
    rows = rows.where(F.col(descriptor).rlike(token))
    # what is no token is left out
    text = F.array_join(F.regexp_extract_all(F.col(descriptor), F.lit(token), F.lit(1)), "")
    named = F.regexp_extract_all(text, F.lit("L([^;]*);"), F.lit(1))
    # an outer explode filters nothing below it, so both sides read one shuffle of the rows
    asked = rows.select(F.col(key).alias("_key"), F.posexplode_outer(F.array_distinct(named)).alias("_at", "name")).where("name IS NOT NULL")
    known = names.where("full IS NOT NULL").groupBy("name").agg(F.min("full").alias("full"))
    met = asked.join(shuffled(known), "name").select("_key", "_at", "full")
    of_row = Window.partitionBy("_key").orderBy("_at")
    listed = F.collect_list(F.struct("_at", "full")).over(of_row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = met.select("_key", F.row_number().over(of_row).alias("_n"), listed.alias("_found")).where("_n = 1").drop("_n")
    joined = rows.select(key, text.alias("_text"), named.alias("_named")).join(shuffled(found), F.col(key) == F.col("_key"), "left")
    joined = joined.withColumns({"_places": F.array_distinct("_named"), "_full": F.map_from_entries("_found"), "_between": F.split("_text", "L[^;]*;")})

    def renamed(plain: bool) -> Column:
        def new(name: Column) -> Column:
            full = F.try_element_at("_full", (F.array_position("_places", name) - 1).cast("int"))
            return descriptors.id_of(F.coalesce(full, name) if plain else full)

        ids = F.transform("_named", new)
        return F.when(F.size(F.array_compact(ids)) == F.size("_named"), F.array_join(F.zip_with("_between", ids, lambda b, i: F.concat(b, F.coalesce(i, F.lit("")))), ""))

    return joined.select(key, renamed(False).alias("strict"), renamed(True).alias("view"))


def renamed_references(references: DataFrame, names: DataFrame) -> DataFrame:
    """``references`` (target, owner, name) with the target's and its owner's names from ``names`` (id, full), or as they are if unknown."""
    own = names.select(F.col("id").alias("target"), F.col("full").alias("_name"))
    above = names.select(F.col("id").alias("owner"), F.col("full").alias("_owner"))
    joined = references.join(own, "target", "left").join(above, "owner", "left")
    return joined.withColumns({"name": F.coalesce("_name", "name"), "owner_name": F.coalesce("_owner", "owner_name")}).drop("_name", "_owner")


def sorted_variables(variables: DataFrame) -> DataFrame:
    """``variables`` (owner, slot, start) with their place among those of their method: by slot, then by first instruction."""
    order = Window.partitionBy("owner").orderBy("slot", "start", "id")
    return variables.withColumn("place", F.row_number().over(order))
