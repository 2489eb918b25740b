"""Catalogues as tables of facts, and what changes between two of them.

A catalogue has a row (entity, path, owner, fact, value) for each fact of each
thing that it describes: `entity` is its kind, `path` its name with those of all
that it is in, `owner` the path of what it is directly in (null at the top).
Each thing has the fact `present`; its value is null, but `true` or `false` for
things that may be required when they are added. So one full outer join on
(entity, path, fact) finds every change, and rules are a small table.

Repeated facts count once, the greatest value. A thing whose owner is in one
catalogue only is part of that one change and not reported again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, types as T
from pyspark.sql import functions as F

from nestra.sources.shared import saved

# Codes of changes, by entity and fact.
FACT_CHANGES = {
    ("field", "type"): "field.typeChanged",
    ("field", "ordinal"): "field.ordinalChanged",
    ("field", "kind"): "field.kindChanged",
    ("interface", "id"): "interface.idChanged",
    ("method", "ordinal"): "method.ordinalChanged",
    ("method", "paramsStruct"): "method.paramsChanged",
    ("method", "resultsStruct"): "method.resultsChanged",
    ("operation", "httpMethod"): "operation.methodChanged",
    ("operation", "path"): "operation.pathChanged",
    ("operation", "returnType"): "operation.returnTypeChanged",
    ("param", "type"): "param.typeChanged",
    ("param", "required"): "param.requiredChanged",
    ("schema", "$ref"): "schema.refChanged",
    ("schema", "type"): "schema.typeChanged",
    ("schema", "format"): "schema.formatChanged",
    ("schema", "nullable"): "schema.nullableChanged",
    ("schema", "allOf"): "schema.allOfChanged",
    ("property", "$ref"): "schema.refChanged",
    ("property", "type"): "schema.typeChanged",
    ("property", "format"): "schema.formatChanged",
    ("property", "nullable"): "schema.nullableChanged",
    ("property", "allOf"): "schema.allOfChanged",
    ("property", "required"): "schema.propertyRequiredChanged",
}
# Codes of what is gone or new, where they are not the entity with `.removed` or `.added`.
NAMED_CHANGES = {"property": ("schema.propertyRemoved", "schema.propertyAdded"), "enumValue": ("schema.enumValueRemoved", "schema.enumValueAdded")}
# Entities whose new members break readers if they are required; facts that break nothing when they become false or true.
ADDED_REQUIRED = ("param", "property")
LESS_STRICT = {"required": "false", "nullable": "true"}


def facts(df: DataFrame, entity: str, path: Column, owner: Column | None = None, required: Column | None = None, /, **values: Column) -> DataFrame:
    """The facts of the things that the rows of df describe; names of facts that are no words are given with `_` for `$`."""
    text = lambda c: c.cast("string")
    rows = [("present", F.lit(None).cast("string") if required is None else text(required)), *((k.replace("_", "$") if k.startswith("_") else k, text(v)) for k, v in values.items())]
    if required is not None:
        rows.append(("required", text(required)))
    listed = F.array(*[F.struct(F.lit(k).alias("fact"), v.alias("value")) for k, v in rows])
    made = df.select(F.lit(entity).alias("entity"), path.alias("path"), (F.lit(None).cast("string") if owner is None else owner.cast("string")).alias("owner"), F.explode(listed).alias("x"))
    return made.select("entity", "path", "owner", "x.fact", "x.value")


def _code(entity: Column, fact: Column, gone: Column, come: Column) -> Column:
    place = lambda at: F.create_map(*[F.lit(x) for k, v in NAMED_CHANGES.items() for x in (k, v[at])])
    changed = F.create_map(*[F.lit(x) for (e, f), code in FACT_CHANGES.items() for x in (f"{e} {f}", code)])
    removed = F.coalesce(F.try_element_at(place(0), entity), F.concat(entity, F.lit(".removed")))
    added = F.coalesce(F.try_element_at(place(1), entity), F.concat(entity, F.lit(".added")))
    return F.when(gone, removed).when(come, added).otherwise(F.try_element_at(changed, F.concat_ws(" ", entity, fact)))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, path, breaking, before, after) of two tables of facts."""
    sides = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    # Null keys are equal to no others, so they stay on their side.
    keyed = sides.withColumn("__place", F.xxhash64("path")).withColumn("__side", F.when(F.col("entity").isNull() | F.col("path").isNull() | F.col("fact").isNull(), F.col("__new")))
    of = lambda new, value: F.max(F.when(F.col("__new") == F.lit(new), value))
    # Dealt by path and grouped where they are, all facts are shuffled once and sorted once, by a hash first.
    both = keyed.repartition("__place").groupBy("__place", "path", "entity", "fact", "__side").agg(
        of(False, F.col("owner")).alias("before_owner"), of(True, F.col("owner")).alias("after_owner"), of(False, F.col("value")).alias("before"), of(True, F.col("value")).alias("after"),
        of(False, F.lit(True)).alias("in_before"), of(True, F.lit(True)).alias("in_after"),
    )
    both = both.where(F.col("in_before").isNull() | F.col("in_after").isNull() | ~F.col("before").eqNullSafe(F.col("after")))
    here = F.col("fact") == "present"
    gone, come = here & F.col("in_after").isNull(), here & F.col("in_before").isNull()
    severe = F.when(gone, True)
    severe = severe.when(come, F.col("entity").isin(*ADDED_REQUIRED) & F.coalesce(F.col("after") == "true", F.lit(False)))
    for fact, value in LESS_STRICT.items():
        severe = severe.when(F.col("fact") == fact, F.coalesce(F.col("after"), F.lit("false")) != value)
    # What is in a thing that is itself gone or new, or is a fact of such a thing, is told by that thing.
    lost = F.coalesce(F.max(gone | come).over(Window.partitionBy("__place", "path")), F.lit(False)) & F.col("path").isNotNull()
    told = both.select("*", lost.alias("lost"), (gone | come).alias("one_sided")).where(here | ~F.col("lost"))
    coded = told.select(_code(F.col("entity"), F.col("fact"), gone, come).alias("change"), "path", severe.otherwise(True).alias("breaking"), "before", "after", "one_sided", F.when(here, F.coalesce("before_owner", "after_owner")).alias("holder"))
    changes = saved(coded.where(F.col("change").isNotNull() | F.col("one_sided")), "facts")
    out = ["change", "path", "breaking", "before", "after"]
    missing = changes.where("one_sided").select(F.col("path").alias("thing")).distinct()
    held = changes.where(F.col("holder").isNotNull()).join(missing, F.col("holder") == F.col("thing"), "left_anti")
    return changes.where(F.col("holder").isNull()).select(*out).unionByName(held.select(*out)).where(F.col("change").isNotNull())


def operations(methods: DataFrame, owner: str) -> DataFrame:
    """(owner, operations) and, with a null owner, the sum over all: how many operations there are."""
    return methods.rollup(owner).agg(F.count("*").alias("operations"))


# The order in which a document lists an operation's verbs.
VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def verb_order(verb: Column) -> Column:
    """Place of a verb in the documents' order; others come after all of them."""
    at = F.array_position(F.array(*[F.lit(v) for v in VERBS]), F.lower(verb))
    return F.when(at > 0, at - 1).otherwise(len(VERBS)).cast("int")


def later_wins(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """One row for each key: the one that stands last; null keys are a key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(place)).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.`{c}`").alias(c) for c in rest])


#: Keys of a problem document, of which two make one. Fixed values.
PROBLEM_KEYS = ("type", "title", "detail", "status", "instance")


def error_shape(body: Column) -> Column:
    """How a JSON body tells of errors: rfc7807, list, single, or passthrough for any other body."""
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    hits = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in PROBLEM_KEYS])))
    is_list = F.get_json_object(body, "$.errors").startswith("[")
    return F.when(hits >= 2, "rfc7807").when(F.array_contains(keys, "errors") & is_list, "list").when(F.array_contains(keys, "error"), "single").otherwise("passthrough")


def dominant(df: DataFrame, groups: list[str], value: str, place: str) -> DataFrame:
    """(groups, value): the most frequent value of each group, of equals the one that stands first."""
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    return counted.groupBy(*groups).agg(F.max_by(value, F.struct("__n", -F.col("__first"))).alias(value))


def replay_diff(recorded: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, changed, kind) of (key, status, body): what a replayed request answers now against what was recorded."""
    a, b = recorded.select(key, F.struct("status", "body").alias("a")), current.select(key, F.struct("status", "body").alias("b"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("a").isNull(), "no-prior-response").when(F.col("b").isNull(), "no-current-response").when(~F.col("a.status").eqNullSafe(F.col("b.status")), "status").when(~F.col("a.body").eqNullSafe(F.col("b.body")), "body")
    return both.select(key, kind.isNotNull().alias("changed"), kind.alias("kind"))


def dispatch(calls: DataFrame, handlers: DataFrame, keys: list[str], handler: str) -> DataFrame:
    """calls with their handler and an error, `unimplemented`, where no handler has the keys."""
    known = handlers.dropDuplicates(keys).select(*keys, handler)
    return calls.join(known, keys, "left").withColumn("error", F.when(F.col(handler).isNull(), "unimplemented"))


# Kinds of fields and the types that hold them; unsigned ones take the next wider.
KINDS = {
    "Void": "void", "Bool": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint",
    "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Float32": "float", "Float64": "double", "Text": "string", "Data": "binary", "Enum": "int",
}


def define_schema(spec: dict) -> T.StructType:
    """The type of rows with the fields of a spec: name to a kind, a dict for a struct, or a list with one of these for a list.

    A name that is no identifier, an unknown kind and a list of other than one kind are errors.
    """

    def kind_of(name: str, kind) -> T.DataType:
        if isinstance(kind, dict):
            return define_schema(kind)
        if isinstance(kind, list):
            if len(kind) != 1:
                raise ValueError(f"field {name!r}: a list has one kind of elements")
            return T.ArrayType(kind_of(name, kind[0]))
        if kind not in KINDS:
            raise ValueError(f"field {name!r}: unknown kind {kind!r}")
        return T._parse_datatype_string(KINDS[kind])

    if not spec:
        raise ValueError("no fields")
    for name in spec:
        if not isinstance(name, str) or not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"field name {name!r} is no identifier")
    return T.StructType([T.StructField(name, kind_of(name, kind)) for name, kind in spec.items()])


def manifest(spark: SparkSession, schemas: dict[str, T.StructType]) -> DataFrame:
    """The catalogue (see facts()) of named row types: structs, and fields with type, ordinal and kind; structs within have the path of their field."""
    rows = []

    def add(path: str, kind: T.StructType, owner: str | None) -> None:
        rows.append(("struct", path, owner, "present", None))
        for i, f in enumerate(kind):
            at, inner = f"{path}.{f.name}", f.dataType
            while isinstance(inner, T.ArrayType):
                inner = inner.elementType
            shape = "list" if isinstance(f.dataType, T.ArrayType) else "struct" if isinstance(inner, T.StructType) else "value"
            text = f.dataType.simpleString() if not isinstance(inner, T.StructType) else shape
            rows.extend([("field", at, path, "present", None), ("field", at, path, "type", text), ("field", at, path, "ordinal", str(i)), ("field", at, path, "kind", shape)])
            if isinstance(inner, T.StructType):
                add(at, inner, at)

    for name, kind in schemas.items():
        add(name, kind, None)
    return spark.createDataFrame(rows, "entity string, path string, owner string, fact string, value string")


class Refused(Exception):
    """A check does not allow a projection."""


def validated(df: DataFrame, *checks: Callable[[DataFrame], str | None]) -> DataFrame:
    """df if every check of its plan, before it runs, answers None; a text is why it is refused."""
    for check in checks:
        if why := check(df):
            raise Refused(why)
    return df


def only_columns(*allowed: str) -> Callable[[DataFrame], str | None]:
    """A check: nothing but these columns comes out."""
    return lambda df: ", ".join(f"column {c!r} is not allowed" for c in df.columns if c not in allowed) or None
