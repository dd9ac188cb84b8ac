"""Model tables (entity, edge, token, seq) of one side from the rows of its class files.

References are resolved upwards: a call of an inherited member belongs to the class that declares it. What no class of the side
declares stays a plain entity of kind "placeholder" under its own name, so both sides can agree on it.
Names that don't fully match ``plain`` are disguised. Of several classes with one name, the first archive's counts.
A dynamic call that makes a lambda is a call of the lambda's body. Arguments and local variables become entities too if they are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import outer_of
from kinweave.operators import graph, lookups, signatures, structure
from kinweave.operators.measures import Model
from kinweave.storage import stored

from . import initialisers

# What names every class file agrees on.
GIVEN_MEMBERS = ("<init>", "<clinit>")
REFERENCES = ("calls", "reads", "writes")
CONSTANTS = ("string", "int", "long", "float", "double")
PRIVATE_OR_STATIC = 0x0002 | 0x0008
STATIC, ENUM, DYNAMIC = 0x0008, 0x4000, 186
INTERFACE, VARIED = 0x0200, 0x0080 | 0x0100
HANDLE, HANDLE_CALL = "java/lang/invoke/MethodHandle", "([Ljava/lang/Object;)Ljava/lang/Object;"
MAIN, MAIN_FLAGS = "main([Ljava/lang/String;)V", 0x0009


def split_member(reference: Column) -> tuple[Column, Column]:
    """Class and member of a reference: ``class/name(...)...`` or ``class/name;;type``."""
    pattern = r"^(.*?)/([^/(;]+(?:\(.*|;;.*))$"
    return F.regexp_extract(reference, pattern, 1), F.regexp_extract(reference, pattern, 2)


def first_wins(rows: DataFrame, archives: list[str] | None = None) -> DataFrame:
    """Without the rows of classes that an earlier archive has. ``archives`` are paths in their order, which archives are below; without them, and among those of one path, the name decides."""
    if archives is not None:
        place = reduce(lambda found, i: F.when(F.col("archive").startswith(archives[i]), i).otherwise(found), range(len(archives) - 1, -1, -1), F.lit(len(archives)))
        ordered = first_wins(rows.withColumn("archive", F.concat(F.format_string("%09d ", place), "archive")))
        return ordered.withColumn("archive", F.substring("archive", 11, 1 << 30))
    me = F.coalesce("owner", "id")
    in_class = F.when(F.col("kind").isin("class", "implements", "field", "method", "outer"), me)
    known = rows.where("kind = 'class'").groupBy(F.col("id").alias("_class")).agg(F.min("archive").alias("_first"))
    member = split_member(F.col("owner"))[0]
    holder = F.coalesce(in_class, F.when(member != "", member), me)
    kept = rows.where("kind <> 'rejected'").withColumn("_class", holder).join(known, "_class", "left")
    return kept.where("_first IS NULL OR archive = _first").drop("_class", "_first")


def types_of(descriptor: Column) -> Column:
    """Array of the types in a descriptor."""
    return F.regexp_extract_all(descriptor, F.lit(r"\[*(?:L[^;]+;|[BCDFIJSZV])"), F.lit(0))


def generic_shape(signature: Column) -> Column:
    """A generic signature without the names of type variables and classes, so that disguised names don't count."""
    plain = F.regexp_replace(signature, "[^<>;:]+:", ":")
    return F.regexp_replace(F.regexp_replace(plain, "L[^;<]+", "L"), "T[^;<>]+;", "T;")


def class_in(type_: Column) -> Column:
    """Class that a type is of or an array of; null for primitives."""
    found = F.regexp_extract(type_, r"^\[*L([^;]+);$", 1)
    return F.when(found != "", found)


def with_lambdas(rows: DataFrame) -> DataFrame:
    """``rows`` with the bodies of lambdas in place of the makers of dynamic calls, and a row for each such call."""
    dynamic = (F.col("kind") == "code") & (F.col("flags") == DYNAMIC)
    maker = F.regexp_extract("other", r"^(.*)/([^/(]*)(\(.*)$", 1), F.regexp_extract("other", r"^(.*)/([^/(]*)(\(.*)$", 2), F.regexp_extract("other", r"^(.*)/([^/(]*)(\(.*)$", 3)
    tag, interface = F.substring_index("value", " ", 1).try_cast("int"), F.substring_index("value", " ", -1) == "true"
    target = structure.dynamic_target(tag, *maker, interface, F.array(F.lit(None).cast("string"), F.col("name")))["target"]
    code = rows.withColumn("_target", F.when(dynamic, target))
    calls = code.where("_target IS NOT NULL").select(*[F.lit("calls").alias(c) if c == "kind" else F.col("_target").alias(c) if c == "other" else F.col(c) if c in ("archive", "owner", "_class") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    code = code.withColumns({"value": F.when(dynamic, F.col("other")).otherwise(F.col("value")), "other": F.when(dynamic, F.col("_target")).otherwise(F.col("other")), "name": F.when(~dynamic, F.col("name"))})
    return code.drop("_target").unionByName(calls)


def meant(named: DataFrame, classes: DataFrame, implements: DataFrame, paths: DataFrame, members: DataFrame) -> DataFrame:
    """``named`` (other, owner, name) with the member that the reference means, as the virtual machine resolves it (see ``lookups``)."""
    flag = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    parents = classes.where("other IS NOT NULL").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    # what is referred to without being known, and what nothing is above, is only itself
    alone = named.select(F.col("owner").alias("sub")).unionByName(classes.select(F.col("id").alias("sub"))).distinct()
    up = graph.closure(parents)
    up = stored(up.unionByName(alone.join(up.select("sub").distinct(), "sub", "left_anti").select("sub", F.col("sub").alias("sup"), F.lit(0).alias("distance"))), "parents")
    faces = classes.where(flag(INTERFACE)).select(F.col("id").alias("sup"))
    above = paths.where("sub <> sup").join(faces, "sup", "left_semi").select("sub", "sup")
    told = members.select("owner", "name", "short", "desc", "member", "kind", *[flag(bit).alias(n) for n, bit in (("abstract", 0x0400), ("private", 0x0002), ("static", 0x0008), ("public", 0x0001))], (F.col("flags").bitwiseAND(F.lit(VARIED)) == VARIED).alias("varied"))
    calls, accesses = named.where("NOT contains(name, ';;')"), named.where("contains(name, ';;')")
    general = told.where((F.col("owner") == HANDLE) & (F.col("desc") == HANDLE_CALL) & F.col("varied")).select("owner", "short", "member")
    handles = calls.select("name", F.substring_index("name", "(", 1).alias("short")).distinct().join(general, "short").select("owner", "name", "member")
    faced = calls.join(faces.withColumnRenamed("sup", "owner").withColumn("faced", F.lit(True)), "owner", "left").withColumn("faced", F.coalesce("faced", F.lit(False)))
    methods = lookups.specific_methods(faced, up, above, told.where("kind = 'method'"), handles)
    ways = lookups.interface_paths(implements.select(F.col("owner").alias("sub"), F.col("other").alias("sup"), F.coalesce(F.col("id").try_cast("int"), F.lit(0)).alias("ord")))
    fields = lookups.resolved_fields(accesses, up, ways, told.where("kind = 'field'"))
    return methods.select("other", "member").unionByName(fields.select("other", "member"))


def variables_of(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, owner, kind, name, type, ord, slot, start) of the arguments and local variables of methods.

    An argument's name is that of the entry with its slot whose range begins with the code. Entries that are neither an
    argument nor the object itself are local variables, in the order of their ranges.
    """
    methods = members.where("kind = 'method'").select(F.col("member").alias("id"), F.col("desc").alias("descriptor"), (F.col("flags").bitwiseAND(F.lit(STATIC)) != 0).alias("static"))
    arguments = structure.arguments_of(methods).withColumnRenamed("id", "owner")
    table = rows.where("kind = 'local'").select("owner", F.col("id").cast("int").alias("entry"), "name", F.col("other").alias("type"), F.col("flags").alias("slot"), F.col("value").cast("int").alias("start"))
    at_start = table.where("start = 0").groupBy("owner", "slot").agg(F.min_by("name", "entry").alias("name"))
    named = arguments.join(at_start, ["owner", "slot"], "left").select(
        F.concat("owner", F.lit("/arg"), F.col("index").cast("string")).alias("id"), "owner", F.lit("argument").alias("kind"), "name", "type", F.col("index").cast("int").alias("ord"), F.col("slot").cast("int").alias("slot"), F.lit(0).alias("start")
    )
    own = arguments.select("owner", "slot", F.lit(0).alias("start")).unionByName(methods.where("NOT static").select(F.col("id").alias("owner"), F.lit(0).alias("slot"), F.lit(0).alias("start")))
    rest = table.join(own, ["owner", "slot", "start"], "left_anti")
    placed = rest.withColumn("ord", F.row_number().over(Window.partitionBy("owner").orderBy("start", "entry")) - 1)
    local = placed.select(F.concat("owner", F.lit("/lv"), F.col("ord").cast("string")).alias("id"), "owner", F.lit("variable").alias("kind"), "name", "type", "ord", "slot", "start")
    return named.unionByName(local)


def extract(rows: DataFrame, plain: str = r"(?!)", prefix: str = "", plain_members: str | None = None, variables: bool = False, archives: list[str] | None = None, path: DataFrame | None = None) -> Model:
    """The model of ``rows`` (see ``classfile``); ``prefix`` goes before each id, so the ids of two sides differ.

    ``plain`` is matched with whole names of classes. ``plain_members`` is matched with ``class/name(...)...`` of methods and ``class/name;;type`` of fields;
    without it, ``plain`` is matched with members' short names. The main method and the two given methods of enums are never disguised. ``archives`` is the order of inputs (see ``first_wins``).
    ``path`` has rows of the class path (see ``classpath``): its classes are resolved like others, but are given: nothing in them is disguised. Those that the inputs have don't count.
    """
    rows = stored(first_wins(rows, archives), "class_rows")
    if path is not None:
        own = rows.where("kind = 'class'").select(F.col("id").alias("class"))
        held = path.where("kind = 'class'").select("archive", F.col("id").alias("class")).join(own, "class", "left_anti")
        holder = F.coalesce(F.when(F.col("kind") == "class", F.col("id")), F.when(F.col("kind").isin("implements", "field", "method", "outer"), F.col("owner")), F.when(split_member(F.col("owner"))[0] != "", split_member(F.col("owner"))[0]), "owner")
        given = path.where("kind <> 'rejected'").withColumn("class", holder).join(held, ["archive", "class"], "left_semi").drop("class")
        given_classes = stored(held.select("class").distinct(), "given")
        rows = stored(rows.unionByName(given), "class_rows")
    rows = with_lambdas(rows)
    of = lambda *kinds: rows.where(F.col("kind").isin(*kinds))
    classes = of("class").select("id", "other", "flags")
    members = of("field", "method").select(F.concat_ws("/", "owner", "id").alias("member"), "owner", F.col("id").alias("name"), F.col("name").alias("short"), F.col("other").alias("desc"), "kind", "flags", F.col("value").cast("int").alias("ord"))
    up = classes.where("other IS NOT NULL").select(F.col("id").alias("src"), F.col("other").alias("dst")).unionByName(of("implements").select(F.col("owner").alias("src"), F.col("other").alias("dst")))
    paths = graph.closure(up)
    apart = (F.col("flags").bitwiseAND(F.lit(PRIVATE_OR_STATIC)) != 0) | F.col("short").isin(*GIVEN_MEMBERS)
    members = stored(members.withColumn("apart", apart), "class_members")

    code = of("code").select("owner", F.col("id").cast("int").alias("place"), initialisers.normal(F.col("flags")).cast("string").alias("op"), "other", "value", "name")
    refers = of(*REFERENCES).select("owner", "kind", "other").distinct()
    holder, name = split_member(F.col("other"))
    named = refers.select("other").distinct().select("other", holder.alias("owner"), name.alias("name"))
    found = meant(named, classes, of("implements"), paths, members)
    target = stored(found.select("other", F.coalesce("member", "other").alias("target")), "class_targets")

    def edge(rel: str | Column, src: Column, dst: Column, frame: DataFrame) -> DataFrame:
        return frame.select((F.lit(rel) if isinstance(rel, str) else rel).alias("rel"), src.alias("src"), dst.alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")

    resolved = refers.join(target, "other").select("owner", "kind", "target")
    outer = of("outer").select("owner", "other")
    guess = classes.select("id", outer_of(F.col("id")).alias("other")).join(classes.select(F.col("id").alias("other")), "other", "left_semi")
    guess = guess.join(outer.select(F.col("owner").alias("id")), "id", "left_anti")
    typed = members.select("member", "kind", F.posexplode(types_of(F.col("desc"))).alias("at", "type"), F.size(types_of(F.col("desc"))).alias("n"))
    typed = typed.withColumns({"class": class_in(F.col("type")), "last": F.col("at") == F.col("n") - 1})
    c = F.col
    edges = [
        edge("extends", c("id"), c("other"), classes),
        edge("implements", c("owner"), c("other"), of("implements")),
        edge("outer", c("owner"), c("other"), outer),
        edge("outer", c("id"), c("other"), guess),
        edge(F.concat("kind", F.lit(" of")), c("member"), c("owner"), members),
        edge(c("kind"), c("owner"), c("target"), resolved),
        edge("class ref", c("owner"), F.coalesce(class_in("other"), "other"), of("class ref")),
        edge("class ref", c("owner"), split_member(c("target"))[0], resolved),
        edge("class ref", c("member"), c("class"), typed.where("kind = 'method'")),
        edge("returns", c("member"), c("class"), typed.where("kind = 'method' AND last")),
        edge("type", c("member"), c("class"), typed.where("kind = 'field'")),
        edge("overrides", c("member"), c("parent"), graph.nearest_override(paths, members)),
    ]
    edges = stored(reduce(DataFrame.unionByName, edges).distinct(), "class_edges")

    own = of(*CONSTANTS).select("owner", F.col("kind").alias("sort"), "value")
    lifted = own.join(members.select(c("member").alias("owner"), c("owner").alias("holder")), "owner").select(c("holder").alias("owner"), "sort", "value")
    tokens = own.unionByName(lifted).distinct()

    ops = code.join(target, "other", "left").withColumn("rel", F.when(c("op").isin("182", "183", "184", "185"), "calls").when(c("op").isin("178", "180"), "reads").when(c("op").isin("179", "181"), "writes"))
    ops = ops.withColumn("rel", F.when((c("op") == str(DYNAMIC)) & c("target").isNotNull(), "calls").otherwise(c("rel")))
    objects = members.where("kind = 'field'").where(c("desc").rlike(r"^[L\[]")).select(c("member").alias("target"))
    writes = ops.where("rel = 'writes'").join(objects, "target", "left_semi").select(c("target").alias("field"), c("owner").alias("method"), "place")
    traced = stored(initialisers.initialisers(rows, writes, types_of), "initialisers")
    steps = traced.join(ops.withColumnRenamed("owner", "method"), ["method", "place"])
    inits = steps.select(c("field").alias("owner"), F.lit("init").alias("sort"), "place", F.concat_ws(" ", "op", "value").alias("value"), F.coalesce("target", "other").alias("target"), F.lit(None).cast("string").alias("rel"))
    told = steps.where("op = '18'").where(c("value").startswith("string ")).select(c("field").alias("owner"), F.lit("init string").alias("sort"), F.substring(c("value"), F.lit(8), F.length("value")).alias("value"))
    tokens = tokens.unionByName(told.distinct())
    if variables:
        vars_ = stored(variables_of(members, rows), "class_variables")
        # a local variable's range may begin with the instruction after the one that sets it
        touched = of("code").where("name IS NOT NULL").select("owner", F.col("id").cast("int").alias("place"), F.col("name").cast("int").alias("slot"))
        held = touched.join(vars_.select("owner", "slot", "start", c("id").alias("var")), ["owner", "slot"]).where("start <= place + 1")
        held = held.groupBy("owner", "place").agg(F.max_by("var", F.struct("start", "var")).alias("var"))
        ops = ops.join(held, ["owner", "place"], "left").withColumns({"target": F.coalesce("var", "target"), "rel": F.when(c("var").isNotNull(), "uses").otherwise(c("rel"))}).drop("var")
        typed_vars = vars_.select(c("id").alias("member"), class_in(c("type")).alias("class"))
        edges = stored(edges.unionByName(edge("type", c("member"), c("class"), typed_vars)).distinct(), "class_edges")
    ops = ops.select("owner", F.lit("code").alias("sort"), "place", F.concat_ws(" ", "op", "value").alias("value"), F.coalesce("target", "other").alias("target"), "rel")
    args = typed.where("kind = 'method' AND NOT last").select(c("member").alias("owner"), F.lit("arg type").alias("sort"), c("at").alias("place"), F.regexp_replace("type", "L[^;]+;", "L").alias("value"), c("class").alias("target"), F.lit(None).cast("string").alias("rel"))
    kind = F.when(c("owner").contains(";;"), "field").when(c("owner").contains("("), "method").otherwise("class")
    nodes = signatures.trees(of("signature").select("owner", kind.alias("kind"), c("value").alias("text")))
    nodes = nodes.select("owner", F.lit("signature").alias("sort"), F.lit(0).alias("place"), c("label").alias("value"), c("class").alias("target"), c("path").alias("rel"))
    seq = ops.unionByName(args).unionByName(inits).unionByName(nodes)

    depth = graph.depths(graph.closure(edges.where("rel = 'extends'").select("src", "dst"))).select(c("node").alias("id"), "depth")
    children = edges.where("rel = 'extends'").groupBy(c("dst").alias("other")).agg(F.count("*").alias("siblings"))
    signature = of("signature").groupBy(c("owner").alias("id")).agg(F.min(generic_shape(F.col("value"))).alias("signature"))
    known = lambda n: n.rlike(f"^(?:{plain})$")
    none = F.lit(None)
    size = code.groupBy(c("owner").alias("member")).agg(F.count("*").cast("int").alias("size"))
    main = (c("name") == MAIN) & (c("flags") == MAIN_FLAGS)
    enums = classes.where(c("flags").bitwiseAND(F.lit(ENUM)) != 0).select(c("id").alias("owner"), F.lit(True).alias("enum"))
    members = members.join(enums, "owner", "left").withColumn("given", main | (F.coalesce("enum", F.lit(False)) & ((c("name") == F.concat(F.lit("values()[L"), "owner", F.lit(";"))) | (c("name") == F.concat(F.lit("valueOf(Ljava/lang/String;)L"), "owner", F.lit(";"))))) | c("short").isin(*GIVEN_MEMBERS))
    of_plan = known(c("short")) if plain_members is None else c("member").rlike(f"^(?:{plain_members})$")
    value = of(*CONSTANTS).groupBy(c("owner").alias("member")).agg(F.min("value").alias("init"))
    first = classes.join(depth, "id", "left").join(children, "other", "left").join(signature, "id", "left").select(
        "id", F.lit("class").alias("kind"), none.cast("string").alias("owner"), c("id").alias("name"), (~known(c("id"))).alias("disguised"), "flags", "signature",
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("siblings", F.lit(0)).cast("int").alias("siblings"), none.cast("int").alias("ord"), none.cast("string").alias("value"), none.cast("string").alias("shape"), none.cast("int").alias("size"),
    )
    signed = signature.withColumnRenamed("id", "member")
    second = members.join(size, "member", "left").join(value, "member", "left").join(signed, "member", "left").select(
        c("member").alias("id"), "kind", "owner", c("short").alias("name"), (~of_plan & ~c("given")).alias("disguised"), "flags", "signature",
        F.lit(0).alias("depth"), F.lit(0).alias("siblings"), "ord", F.when(c("kind") == "field", c("init")).alias("value"), F.regexp_replace("desc", "L[^;]+;", "L").alias("shape"), "size",
    )
    entities = first.unionByName(second)
    if path is not None:
        holder = F.when(c("kind") == "class", c("id")).otherwise(c("owner"))
        marks = given_classes.select(c("class").alias("_holder"), F.lit(True).alias("_given"))
        entities = entities.withColumn("_holder", holder).join(marks, "_holder", "left").withColumn("disguised", c("disguised") & c("_given").isNull()).drop("_holder", "_given")
    if variables:
        open_ = second.select(c("id").alias("owner"), c("disguised").alias("hidden"))
        fourth = vars_.join(open_, "owner").select(
            "id", "kind", "owner", c("name"), (c("hidden") | c("name").isNull()).alias("disguised"), F.lit(0).alias("flags"), none.cast("string").alias("signature"),
            F.lit(0).alias("depth"), F.lit(0).alias("siblings"), "ord", none.cast("string").alias("value"), F.regexp_replace("type", "L[^;]+;", "L").alias("shape"), none.cast("int").alias("size"),
        )
        entities = entities.unionByName(fourth)
    others = edges.select(c("dst").alias("id")).unionByName(seq.where("target IS NOT NULL").select(c("target").alias("id"))).distinct().join(entities.select("id"), "id", "left_anti")
    third = others.select("id", F.lit("placeholder").alias("kind"), none.cast("string").alias("owner"), c("id").alias("name"), F.lit(False).alias("disguised"), F.lit(0).alias("flags"), *[
        none.cast(t).alias(n) for n, t in (("signature", "string"), ("depth", "int"), ("siblings", "int"), ("ord", "int"), ("value", "string"), ("shape", "string"), ("size", "int"))
    ])
    everything = entities.unionByName(third)
    if variables:
        everything = everything.join(vars_.select("id", "slot"), "id", "left")
    marked = lambda frame, *columns: frame.withColumns({x: F.concat(F.lit(prefix), c(x)) for x in columns})
    return Model(
        stored(marked(everything, "id", "owner"), "entity"),
        stored(marked(edges, "src", "dst"), "edge"),
        stored(marked(tokens, "owner"), "token"),
        stored(marked(seq, "owner", "target"), "seq"),
        sorts=("code", "arg type", "init", "signature"),
    )
