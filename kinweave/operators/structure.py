"""What is derived from classes, methods and calls: kinds, slots, roots, packages, merged archives, similarities of matched elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import descriptors
from kinweave.functions.text import package_of

# The calls that make lambdas, those of no interest, and flags.
STATIC_CALL = 6
METAFACTORY = "java/lang/invoke/LambdaMetafactory"
LAMBDA_MAKERS = {
    "metafactory": "(Ljava/lang/invoke/MethodHandles$Lookup;Ljava/lang/String;Ljava/lang/invoke/MethodType;Ljava/lang/invoke/MethodType;Ljava/lang/invoke/MethodHandle;Ljava/lang/invoke/MethodType;)Ljava/lang/invoke/CallSite;",
    "altMetafactory": "(Ljava/lang/invoke/MethodHandles$Lookup;Ljava/lang/String;Ljava/lang/invoke/MethodType;[Ljava/lang/Object;)Ljava/lang/invoke/CallSite;",
}
OF_NO_INTEREST = ("java/lang/invoke/StringConcatFactory", "java/lang/runtime/ObjectMethods")
PRIVATE, SYNTHETIC = 0x2, 0x1000
RESULT_WEIGHT, ARGUMENTS_WEIGHT = 0.05, 0.2
OTHER_TYPE = 0.5


def makes_lambda(tag: Column, owner: Column, name: Column, descriptor: Column, interface: Column) -> Column:
    """Whether a dynamic call's maker is one of the two that make lambdas."""
    maker = F.lit(False)
    for own_name, own_descriptor in LAMBDA_MAKERS.items():
        maker = maker | ((name == own_name) & (descriptor == own_descriptor))
    return (tag == STATIC_CALL) & (owner == METAFACTORY) & maker & ~interface


def dynamic_target(tag: Column, owner: Column, name: Column, descriptor: Column, interface: Column, arguments: Column) -> Column:
    """(target, known): the second argument of a call that makes a lambda, null for others; ``known`` is false for calls of a sort never heard of."""
    made = makes_lambda(tag, owner, name, descriptor, interface)
    return F.struct(F.when(made, F.get(arguments, F.lit(1))).alias("target"), (made | owner.isin(*OF_NO_INTEREST)).alias("known"))


def method_kinds(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """``methods`` (id, name, flags) with ``kind``: class_init, constructor, lambda or other.

    A lambda's body is synthetic and private, has callers, and all calls (callee, by_lambda) reach it by making a lambda.
    """
    reached = calls.groupBy(F.col("callee").alias("id")).agg(F.bool_and("by_lambda").alias("_only"))
    hidden = F.col("flags").bitwiseAND(F.lit(PRIVATE | SYNTHETIC)) == PRIVATE | SYNTHETIC
    kind = F.when(F.col("name") == "<clinit>", "class_init").when(F.col("name") == "<init>", "constructor").when(hidden & F.coalesce("_only", F.lit(False)), "lambda").otherwise("other")
    return methods.join(reached, "id", "left").withColumn("kind", kind).drop("_only")


def arguments_of(methods: DataFrame) -> DataFrame:
    """(id, index, type, slot) of the arguments of ``methods`` (id, descriptor, static): slots begin at 0, or at 1 after the object itself; long ones take two."""
    types = descriptors.arguments(F.col("descriptor"))
    first = F.when(F.col("static"), 0).otherwise(1)
    before = F.aggregate(F.slice(F.col("types"), F.lit(1), F.col("index")), F.lit(0), lambda acc, t: acc + descriptors.slot_size(t))
    rows = methods.select("id", first.alias("first"), types.alias("types")).select("id", "first", "types", F.posexplode("types").alias("index", "type"))
    return rows.select("id", "index", "type", (F.col("first") + before).alias("slot"))


def group_flags(members: DataFrame, group: str = "grouped") -> DataFrame:
    """(group, disguised): a hierarchy is disguised if all of its members are."""
    return members.groupBy(group).agg(F.bool_and("disguised").alias("disguised"))


def input_roots(members: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, has_parent, any_root) of ``members`` (id, origin), a row for each archive that supplies one.

    ``paths`` is the closure of overriding (sub, sup). A member has a parent if one above it is supplied by the same archive, and is a root
    if there is an archive in which nothing above it is.
    """
    rows = members.select("id", "origin").distinct()
    above = paths.where("sub <> sup").select(F.col("sub").alias("id"), "sup").join(rows.select(F.col("id").alias("sup"), "origin"), "sup").select("id", "origin").distinct().withColumn("_above", F.lit(True))
    marked = rows.join(above, ["id", "origin"], "left").withColumn("_above", F.col("_above").isNotNull())
    return marked.groupBy("id").agg(F.bool_or("_above").alias("has_parent"), F.bool_or(~F.col("_above")).alias("any_root"))


def package_tree(classes: DataFrame, name: str = "name") -> DataFrame:
    """(package, top, n_classes): the classes below each outermost class of each package."""
    top = F.regexp_extract(F.col(name), r"^(.*?[^/$])(?:\$[^/$].*)?$", 1)
    rows = classes.select(F.when(top == "", F.col(name)).otherwise(top).alias("top"))
    return rows.groupBy(package_of(F.col("top")).alias("package"), "top").agg(F.count("*").alias("n_classes"))


def path_index(entries: DataFrame) -> DataFrame:
    """(name, path): the first place of each class name in ``entries`` (name, path, ord)."""
    return entries.groupBy("name").agg(F.min_by("path", F.struct("ord", "path")).alias("path"))


def merged_inputs(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(id, origin, origins) of input classes: the first archive counts, all of them are listed in order; classes already in ``known`` (id) are left out."""
    listed = F.transform(F.array_sort(F.collect_set(F.struct("ord", "origin"))), lambda x: x["origin"])
    return entries.join(known.select("id").distinct(), "id", "left_anti").groupBy("id").agg(listed.alias("origins")).select("id", F.get("origins", F.lit(0)).alias("origin"), "origins")


def type_similarity(potential: Column) -> Column:
    """Similarity of matched fields or variables by whether their types could be equal."""
    return F.when(F.coalesce(potential, F.lit(False)), 1.0).otherwise(OTHER_TYPE)


def method_similarity(pairs: DataFrame, arguments: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(a, b, similarity) of matched methods ``pairs`` (a, b, a_code, b_code, same_result, aligned).

    ``arguments`` (a, similarity) has the matched arguments of each a, and null similarity for its other ones; ``unmatched`` (b) has the unmatched arguments
    of the partners. Codes are lengths, null without code: two without are equal, one is different.
    """
    own = arguments.groupBy("a").agg(F.sum("similarity").alias("_sum"), F.count("*").alias("_n"))
    free = unmatched.groupBy("b").agg(F.count("*").alias("_free"))
    rows = pairs.join(own, "a", "left").join(free, "b", "left")
    n = F.coalesce("_n", F.lit(0)) + F.coalesce("_free", F.lit(0))
    args = F.when(n > 0, F.coalesce("_sum", F.lit(0.0)) / n).otherwise(1.0)
    longest = F.greatest("a_code", "b_code")
    content = F.when(longest > 0, F.col("aligned") / longest).otherwise(1.0)
    whole = F.when(F.col("same_result"), RESULT_WEIGHT).otherwise(0.0) + ARGUMENTS_WEIGHT * args + (1 - RESULT_WEIGHT - ARGUMENTS_WEIGHT) * content
    found = F.when(F.col("a_code").isNull() & F.col("b_code").isNull(), 1.0).when(F.col("a_code").isNull() | F.col("b_code").isNull(), 0.0).otherwise(whole)
    return rows.select("a", "b", found.alias("similarity"))


def class_similarity(matches: DataFrame, a_members: DataFrame, b_members: DataFrame, similarities: DataFrame) -> DataFrame:
    """(a, b, similarity) of matched classes: the sum of their matched members' ``similarities`` (a, b, similarity) over the number of
    a's members and b's unmatched members (id, owner). A member counts only with a partner in b; classes without members are equal."""
    scored = a_members.join(similarities.select(F.col("a").alias("id"), F.col("similarity").alias("_s")), "id", "left").groupBy(F.col("owner").alias("a")).agg(F.sum("_s").alias("_sum"), F.count("*").alias("_n"))
    free = b_members.join(similarities.select(F.col("b").alias("id")), "id", "left_anti").groupBy(F.col("owner").alias("b")).agg(F.count("*").alias("_free"))
    n = F.coalesce("_n", F.lit(0)) + F.coalesce("_free", F.lit(0))
    return matches.join(scored, "a", "left").join(free, "b", "left").select("a", "b", F.when(n > 0, F.coalesce("_sum", F.lit(0.0)) / n).otherwise(1.0).alias("similarity"))


def uid_rows(lines: DataFrame) -> DataFrame:
    """(type, uid, owner_a, member_a, owner_b, member_b) of ``lines`` (type, uid, a, b) of a store of ids: a class's id alone, or its id, a slash and a member's id.

    A method's id ends at its descriptor, and what follows that in an argument's line is the argument's; a field's has two semicolons between name and type.
    """
    rows = lines

    def owner(id_: Column) -> Column:
        return F.when(F.col("type") == "class", id_).otherwise(F.regexp_extract(id_, r"^(.*;)/[^/]*(?:\(|;;)", 1))

    def member(id_: Column) -> Column:
        rest = F.substring(id_, F.length(owner(id_)) + 2, F.length(id_))
        return F.when(F.col("type") == "class", None).when(F.col("type") == "argument", F.regexp_extract(rest, rf"^(.*\){descriptors.TYPE})", 1)).otherwise(rest)

    return rows.select("type", "uid", owner(F.col("a")).alias("owner_a"), member(F.col("a")).alias("member_a"), owner(F.col("b")).alias("owner_b"), member(F.col("b")).alias("member_b"))


def uid_lines(classes: DataFrame, methods: DataFrame, fields: DataFrame, arguments: DataFrame) -> DataFrame:
    """(type, a, b): what is sent to a store of ids for the matches (a, b) of classes, members (owner_a, a, owner_b, b) and arguments (owner_a, method_a, a, ...); local variables aren't."""

    def below(rows: DataFrame, type_: str, a: list[str], b: list[str]) -> DataFrame:
        return rows.select(F.lit(type_).alias("type"), F.concat(*a).alias("a"), F.concat(*b).alias("b"))

    slash = F.lit("/")
    sent = classes.select(F.lit("class").alias("type"), "a", "b")
    for rows, type_ in ((methods, "method"), (fields, "field")):
        sent = sent.unionByName(below(rows, type_, ["owner_a", slash, "a"], ["owner_b", slash, "b"]))
    return sent.unionByName(below(arguments, "argument", ["owner_a", slash, "method_a", "a"], ["owner_b", slash, "method_b", "b"]))


def member_order(members: DataFrame) -> DataFrame:
    """``members`` (id, owner, name, descriptor) with their place in their owner, by name and then descriptor."""
    return members.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("name", "descriptor", "id")))
