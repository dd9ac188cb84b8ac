"""Names in a name space: which of an element's own, its partner's, auxiliary, temporary and plain names counts.

Every function takes one table with a row per element: ``id``, ``partner`` (the matched element's id or null), ``name``
(its plain name), ``disguised``, and what it has of ``mapped``, ``tmp`` (names), ``aux`` (an array) and ``uid``. Missing
columns count as null. The partner's row is met by one equi-join; nested names follow their outer ones level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.descriptors import is_identifier
from kinweave.functions.text import inner_of, package_of
from kinweave.storage import shuffled, stored


@dataclass(frozen=True)
class NameType:
    """A name space: which kinds of names it takes. ``own_tmp`` takes an element's own temporary name only."""

    name: str
    plain: bool = False
    mapped: bool = False
    tmp: bool = False
    aux: int = 0
    own_tmp: bool = False
    uid: bool = False

    @property
    def space(self) -> str:
        """What the name space is called in a mapping file."""
        if self.uid:
            return "intermediary"
        if self.mapped and self.aux:
            if self.aux > 1:
                raise ValueError(f"{self.name} has no name in a file")
            return "named-aux"
        if self.mapped:
            return "named-tmp" if self.tmp or self.own_tmp else "named"
        if self.aux:
            return "aux" if self.aux == 1 else f"aux{self.aux - 1}"
        return "tmp" if self.tmp or self.own_tmp else "official"


# The name types.
PLAIN = NameType("PLAIN", plain=True)
MAPPED = NameType("MAPPED", mapped=True)
AUX = NameType("AUX", aux=1)
AUX2 = NameType("AUX2", aux=2)
MAPPED_PLAIN = NameType("MAPPED_PLAIN", plain=True, mapped=True)
MAPPED_AUX_PLAIN = NameType("MAPPED_AUX_PLAIN", plain=True, mapped=True, aux=1)
MAPPED_AUX2_PLAIN = NameType("MAPPED_AUX2_PLAIN", plain=True, mapped=True, aux=2)
MAPPED_TMP_PLAIN = NameType("MAPPED_TMP_PLAIN", plain=True, mapped=True, tmp=True)
MAPPED_LOCTMP_PLAIN = NameType("MAPPED_LOCTMP_PLAIN", plain=True, mapped=True, own_tmp=True)
UID_PLAIN = NameType("UID_PLAIN", plain=True, uid=True)
TMP_PLAIN = NameType("TMP_PLAIN", plain=True, tmp=True)
LOCTMP_PLAIN = NameType("LOCTMP_PLAIN", plain=True, own_tmp=True)
AUX_PLAIN = NameType("AUX_PLAIN", plain=True, aux=1)
AUX2_PLAIN = NameType("AUX2_PLAIN", plain=True, aux=2)
TYPES = (PLAIN, MAPPED, AUX, AUX2, MAPPED_PLAIN, MAPPED_AUX_PLAIN, MAPPED_AUX2_PLAIN, MAPPED_TMP_PLAIN, MAPPED_LOCTMP_PLAIN, UID_PLAIN, TMP_PLAIN, LOCTMP_PLAIN, AUX_PLAIN, AUX2_PLAIN)


def found(**wanted) -> NameType:
    """The one name type with just these properties."""
    for t in TYPES:
        if all(getattr(t, key) == wanted.get(key, NameType.__dataclass_fields__[key].default) for key in ("plain", "mapped", "tmp", "aux", "own_tmp", "uid")):
            return t
    raise ValueError(f"no name type with {wanted}")


def with_plain(t: NameType, value: bool) -> NameType:
    if t.plain == value:
        return t
    if value:
        return MAPPED_PLAIN if t.mapped else found(plain=True, aux=t.aux)
    if t == MAPPED_PLAIN:
        return MAPPED
    if t.aux and not t.mapped and not t.tmp:
        return found(aux=t.aux)
    raise ValueError(f"{t.name} can't do without plain names")


def with_mapped(t: NameType, value: bool) -> NameType:
    if t.mapped == value:
        return t
    if value:
        return found(plain=True, mapped=True, aux=t.aux) if t.aux else MAPPED_TMP_PLAIN if t.tmp else MAPPED_PLAIN if t.plain else MAPPED
    if t.aux:
        return found(plain=t.plain, aux=t.aux)
    return TMP_PLAIN if t.tmp else LOCTMP_PLAIN if t == MAPPED_LOCTMP_PLAIN else PLAIN


def with_aux(t: NameType, index: int, value: bool) -> NameType:
    if (t.aux - 1 == index) == value:
        return t
    if value:
        return found(plain=t.plain or t.mapped, mapped=t.mapped, aux=index + 1)
    return MAPPED_PLAIN if t.mapped else PLAIN


def with_tmp(t: NameType, value: bool) -> NameType:
    if t.tmp == value:
        return t
    if value:
        return MAPPED_TMP_PLAIN if t.mapped else TMP_PLAIN
    return MAPPED_PLAIN if t.mapped else PLAIN


def with_own_tmp(t: NameType, value: bool) -> NameType:
    """From the partner's temporary names to own ones, or back; other types stay."""
    if value == t.own_tmp or not (t.tmp or t.own_tmp):
        return t
    if value:
        return MAPPED_LOCTMP_PLAIN if t.mapped else LOCTMP_PLAIN
    return MAPPED_TMP_PLAIN if t.mapped else TMP_PLAIN


OPTIONAL = {"mapped": "string", "tmp": "string", "aux": "array<string>", "uid": "long", "outer": "string", "input": "boolean"}


def beside_partner(elements: DataFrame) -> DataFrame:
    """Each element as struct ``me`` beside its partner's, ``it``."""
    rows = elements.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in elements.columns})
    me = rows.select(F.struct(*rows.columns).alias("me"))
    it = rows.select(F.struct(*rows.columns).alias("it"))
    return me.join(shuffled(it), F.col("me.partner") == F.col("it.id"), "left")


def is_known(side: str) -> Column:
    """Whether there is an element on that side and its name isn't disguised."""
    return F.coalesce(~F.col(f"{side}.disguised"), F.lit(False))


def aux_of(side: str, t: NameType) -> Column:
    return F.get(F.col(f"{side}.aux"), F.lit(t.aux - 1))


def pick(choices: list[tuple[bool, Column, Column | None, bool]]) -> Column:
    """(name, far) of the first choice that applies: (whether the type takes it, name, condition, whether it is the partner's)."""
    cases = [
        F.when((condition if condition is not None else F.lit(True)) & name.isNotNull(), F.struct(name.alias("name"), F.lit(far).alias("far")))
        for applies, name, condition, far in choices
        if applies
    ]
    return F.coalesce(*cases, F.struct(F.lit(None).cast("string").alias("name"), F.lit(False).alias("far")))


def class_choice(t: NameType) -> Column:
    """(name, far) of a class, without its outer class."""

    def lendable(name: Column) -> Column:
        # a name of a nested class without a package isn't taken for a class that isn't nested, unless it is a real name
        allowed = is_known("it") | F.col("me.outer").isNotNull() | F.col("it.outer").isNull() | F.substring(name, 1, 1).rlike(r"^\p{javaJavaIdentifierStart}")
        return (name != "") & allowed

    def inner(side: str) -> Column:
        return F.when(F.col(f"{side}.outer").isNull(), F.col(f"{side}.name")).otherwise(inner_of(F.col(f"{side}.name")))

    return pick(
        [
            (t.mapped, F.col("me.mapped"), None, False),
            (t.mapped, F.col("it.mapped"), lendable(F.col("it.mapped")), True),
            (t.mapped, inner("me"), is_known("me"), False),
            (t.mapped, inner("it"), is_known("it"), True),
            (t.aux > 0, aux_of("me", t), None, False),
            (t.aux > 0, aux_of("it", t), lendable(aux_of("it", t)), True),
            (t.tmp, F.col("it.tmp"), None, True),
            (t.tmp or t.own_tmp, F.col("me.tmp"), None, False),
            (t.plain, inner("me"), None, False),
        ]
    )


def class_names(classes: DataFrame, t: NameType, prefix: str = "class_") -> DataFrame:
    """(id, full): the names of all classes in a name space; ``outer`` is the id of the class that one is nested in.

    A nested class follows its outer one, with a partner's name cut to what comes after its package if only the partner isn't
    nested. A class that isn't nested takes its nested partner's name with the package of the partner's outer class. Classes
    wait for the name that they need, so there are as many passes as nesting is deep. A class that is nested in an unknown one, in itself, or in one that is, has
    only its own part.
    """
    if t == PLAIN:
        return classes.select("id", F.col("name").alias("full"))
    both = beside_partner(classes).withColumn("choice", class_choice(t))
    if t.uid:
        least = F.coalesce(F.least(F.when(F.col("me.uid") >= 0, F.col("me.uid")), F.when(F.col("it.uid") >= 0, F.col("it.uid"))), F.lit(-1))
        whole = F.when(least >= 0, F.concat(F.lit(prefix), least.cast("string")))
    else:
        whole = F.lit(None).cast("string")
    nested, far_nested = F.col("me.outer").isNotNull(), F.col("it.outer").isNotNull()
    repackaged = ~nested & far_nested & F.col("choice.far")
    need = F.when(whole.isNotNull() | F.col("choice.name").isNull(), None).when(nested, F.col("me.outer")).when(repackaged, F.col("it.outer"))
    simple = F.when(nested & F.col("choice.far") & ~far_nested, F.substring_index("choice.name", "/", -1)).otherwise(F.col("choice.name"))
    open_ = stored(both.select("me.id", need.alias("need"), F.coalesce(whole, simple).alias("simple"), nested.alias("nested")), "open_names")
    # what is nested in an unknown class starts with its own part
    known = open_.select(F.col("id").alias("need"), F.lit(True).alias("_known"))
    open_ = open_.join(shuffled(known), "need", "left").select("id", F.when(F.col("_known"), F.col("need")).alias("need"), "simple", "nested")
    done = stored(open_.where("need IS NULL").select("id", F.col("simple").alias("full")), "names")
    open_ = open_.where("need IS NOT NULL")
    while not open_.isEmpty():
        ready = open_.join(shuffled(done.select(F.col("id").alias("need"), F.col("full").alias("above"))), "need")
        package = F.coalesce(package_of(F.col("above")), F.lit(""))  # an outer class without a name gives none
        repacked = F.when(package == "", F.col("simple")).otherwise(F.concat(package, F.lit("/"), F.col("simple")))
        full = F.when(F.col("nested"), F.concat_ws("$", "above", "simple")).otherwise(repacked)
        new = stored(ready.select("id", full.alias("full")), "names")
        if new.isEmpty():
            # only what is nested in itself is left, or in such a class
            return done.unionByName(open_.select("id", F.col("simple").alias("full")))
        done = done.unionByName(new)
        open_ = stored(open_.join(shuffled(new.select("id")), "id", "left_anti"), "open_names")
    return done


def member_names(members: DataFrame, t: NameType, prefix: str = "method_") -> DataFrame:
    """(id, full): names of methods or fields. ``mapped``, ``tmp``, ``aux`` and ``uid`` are those of their hierarchies, ``partner``
    is the matched member, and only members of input classes have other than plain names."""
    if t == PLAIN:
        return members.select("id", F.col("name").alias("full"))
    own = F.coalesce(F.col("me.input"), F.lit(True))
    uid = F.coalesce(F.least(F.when(F.col("me.uid") >= 0, F.col("me.uid")), F.when(F.col("it.uid") >= 0, F.col("it.uid"))), F.lit(-1))
    choice = pick(
        [
            (t.uid, F.concat(F.lit(prefix), uid.cast("string")), uid >= 0, False),
            (t.mapped, F.coalesce("me.mapped", "it.mapped"), own, False),
            (t.mapped, F.col("me.name"), is_known("me"), False),
            (t.mapped, F.col("it.name"), is_known("it"), True),
            (t.aux > 0, F.coalesce(aux_of("me", t), aux_of("it", t)), own, False),
            (t.tmp, F.coalesce("me.tmp", "it.tmp"), own, False),
            (t.tmp or t.own_tmp, F.col("me.tmp"), None, False),
            (t.plain, F.col("me.name"), None, False),
        ]
    )
    return beside_partner(members).select("me.id", choice["name"].alias("full"))


def with_valid_names(variables: DataFrame) -> DataFrame:
    """``variables`` (id, owner, name, argument, place) with ``own_name``: the name if it is an identifier, looks unlike a
    typed one and is unique in its method, else null; and ``typed``, that is arg or lv and the place."""
    counts = variables.where("name IS NOT NULL").groupBy("owner", "name").agg(F.count("*").alias("_n"))
    fits = is_identifier(F.col("name")) & ~F.col("name").rlike("^(?:arg|lv)[0-9]") & (F.col("_n") == 1)
    typed = F.concat(F.when(F.col("argument"), "arg").otherwise("lv"), F.col("place").cast("string"))
    return variables.join(counts, ["owner", "name"], "left").withColumns({"own_name": F.when(fits, F.col("name")), "typed": typed}).drop("_n")


def variable_names(variables: DataFrame, t: NameType) -> DataFrame:
    """(id, full): names of arguments and local variables."""
    rows = with_valid_names(variables)
    plain = F.coalesce("me.own_name", "me.typed")
    uid = F.coalesce(F.least(F.when(F.col("me.uid") >= 0, F.col("me.uid")), F.when(F.col("it.uid") >= 0, F.col("it.uid"))), F.lit(-1))
    prefix = F.when(F.col("me.argument"), "arg_").otherwise("var_")
    choice = pick(
        [
            (t.uid, F.concat(prefix, uid.cast("string")), uid >= 0, False),
            (t.mapped, F.col("me.mapped"), None, False),
            (t.mapped, F.col("it.mapped"), None, True),
            (t.mapped, F.col("me.own_name"), is_known("me"), False),
            (t.mapped, F.col("it.name"), is_known("it"), True),
            (t.aux > 0, aux_of("me", t), None, False),
            (t.aux > 0, aux_of("it", t), None, True),
            (t.tmp, F.col("it.tmp"), None, True),
            (t.tmp or t.own_tmp, F.col("me.tmp"), None, False),
            (t.plain, plain, None, False),
        ]
    )
    return beside_partner(rows).select("me.id", choice["name"].alias("full"))


def mapped_state(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(id, has_mapped, has_mapped_children): whether a class, and whether any of its members, has a mapped name of its own or its partner's."""

    def has(rows: DataFrame) -> DataFrame:
        return beside_partner(rows).select("me.*", F.coalesce("me.mapped", "it.mapped").isNotNull().alias("has"))

    below = has(members).groupBy(F.col("owner").alias("id")).agg(F.bool_or("has").alias("has_mapped_children"))
    return has(classes).select("id", F.col("has").alias("has_mapped")).join(below, "id", "left").select("id", "has_mapped", F.coalesce("has_mapped_children", F.lit(False)).alias("has_mapped_children"))
