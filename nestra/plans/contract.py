"""Catalogue operators as joins: keyed compares and diffs, locks, renames, closures, routes, call chains, drift."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestra.sources.shared import numbered, saved


def compare(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): removed, added, changed or same, by a full outer join on the keys."""
    a = old.select(*keys, F.struct(*values).alias("__old"), F.lit(True).alias("__a"))
    b = new.select(*keys, F.struct(*values).alias("__new"), F.lit(True).alias("__b"))
    change = F.when(F.col("__b").isNull(), "removed").when(F.col("__a").isNull(), "added").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def summarise(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count("*").alias("total"), F.count_if("breaking").alias("breaking"), F.count_if(~F.col("breaking")).alias("non_breaking"), (F.count_if("breaking") == 0).alias("compatible"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the SHA-256 of each row's canonical text, its columns in the order of their names."""
    return df.withColumn("fingerprint", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(columns)]), 256))


def extend_lock(locked: DataFrame, members: DataFrame, order: str, next_ordinal: int | None = None) -> DataFrame:
    """The lock with ordinals from next_ordinal on, or from its own maximum plus one, for members it lacks, in their order; old ones never change."""
    key = [c for c in members.columns]
    had = locked.select(*[F.col(c).alias(f"__had_{c}") for c in key])
    new = numbered(members.join(had, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__had_{c}")) for c in key]), "left_anti"), "__rn", [order])
    begin = F.lit(next_ordinal) if next_ordinal is not None else F.col("__next")
    if next_ordinal is None:
        new = new.crossJoin(F.broadcast(locked.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("__next"))))  # one row
    return locked.unionByName(new.select(*key, (F.col("__rn") + begin).alias("ordinal")))


def update_lock(lock: DataFrame, members: DataFrame, detect_renames: bool = False) -> DataFrame:
    """(scope, name, signature, ordinal, state, was): the lock (scope, name, signature, ordinal) brought up to the members (scope, name, signature, place).

    Ordinals count in each scope. A member keeps its own; a new one gets the next
    in its scope, in the order of places; one that is gone stays `removed`, so that
    its ordinal is not used again. With detect_renames, a removed and a new member
    that are the only ones of their signature in the scope are one, `renamed` from `was`.
    Keys are unique in each table; null scopes and names are values.
    """
    both = lock.select("scope", "name", F.col("signature").alias("old_signature"), "ordinal", F.lit(True).alias("__old")).alias("a").join(
        members.select("scope", "name", F.col("signature").alias("new_signature"), "place", F.lit(True).alias("__new")).alias("b"),
        F.col("a.scope").eqNullSafe(F.col("b.scope")) & F.col("a.name").eqNullSafe(F.col("b.name")), "full_outer",
    )
    pick = lambda c: F.when(F.col("__new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    state = F.when(F.col("__new").isNull(), "removed").when(F.col("__old").isNull(), "added").otherwise("unchanged").alias("state")
    both = saved(both.select(pick("scope"), pick("name"), "old_signature", "new_signature", "ordinal", "place", state), "lock")
    added = both.where("state = 'added'").select("scope", "name", F.col("new_signature").alias("signature"), "place")
    gone = both.where("state = 'removed'").select("scope", "name", F.col("old_signature").alias("signature"), "ordinal")
    if detect_renames:
        key = ["scope", F.col("signature").alias("sig"), "name"]
        found = saved(renames(gone.where("signature is not null").select(*key), added.where("signature is not null").select(*key), with_scope=True), "renames")
        moved = found.alias("f").join(gone.alias("g"), F.col("f.scope").eqNullSafe(F.col("g.scope")) & F.col("f.old_name").eqNullSafe(F.col("g.name")))
        moved = saved(moved.select("f.scope", F.col("f.new_name").alias("name"), "g.ordinal", F.col("f.old_name").alias("was")), "moved")
        new = added.alias("n").join(moved.alias("m"), F.col("n.scope").eqNullSafe(F.col("m.scope")) & F.col("n.name").eqNullSafe(F.col("m.name")), "left")
        renamed = new.where("m.ordinal is not null").select("n.scope", "n.name", "n.signature", "m.ordinal", F.lit("renamed").alias("state"), "m.was")
        added = new.where("m.ordinal is null").select("n.scope", "n.name", "n.signature", "n.place")
        gone = gone.alias("g").join(moved.alias("m"), F.col("g.scope").eqNullSafe(F.col("m.scope")) & F.col("g.name").eqNullSafe(F.col("m.was")), "left_anti").select("scope", "name", "signature", "ordinal")
    nothing = F.lit(None).cast("string").alias("was")
    first = lock.groupBy("scope").agg((F.max("ordinal") + 1).alias("next")).withColumnRenamed("scope", "__scope")
    fresh = numbered(added, "__rn", ["place", "name"], ["scope"])
    fresh = fresh.join(first, F.col("scope").eqNullSafe(F.col("__scope")), "left").select("scope", "name", "signature", (F.coalesce("next", F.lit(0)) + F.col("__rn")).alias("ordinal"), F.lit("added").alias("state"), nothing)
    kept = both.where("state = 'unchanged'").select("scope", "name", F.coalesce("new_signature", "old_signature").alias("signature"), "ordinal", "state", nothing)
    out = kept.unionByName(fresh).unionByName(gone.select("scope", "name", "signature", "ordinal", F.lit("removed").alias("state"), nothing))
    return out.unionByName(renamed) if detect_renames else out


def renames(old: DataFrame, new: DataFrame, with_scope: bool = False) -> DataFrame:
    """(old_name, new_name) of (name, sig, scope) where both sides have exactly one member of the signature; null scopes are one."""
    one = lambda df, name: df.groupBy("scope", "sig").agg(F.count("*").alias("n"), F.min("name").alias(name)).where("n = 1").drop("n")
    a, b = one(old, "old_name").alias("a"), one(new, "new_name").alias("b")
    pairs = a.join(b, F.col("a.scope").eqNullSafe(F.col("b.scope")) & (F.col("a.sig") == F.col("b.sig")))
    return pairs.select(*["a.scope"] * with_scope, "old_name", "new_name")


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, target) reachable over at most `depth` edges, or over any number; rounds end when one adds no pair."""
    reach = frontier = saved(edges.select("source", "target").distinct(), "reach")
    step = edges.select(F.col("source").alias("target"), F.col("target").alias("next")).distinct()
    length = 1
    while depth is None or length < depth:
        come = frontier.join(step, "target").select("source", F.col("next").alias("target")).distinct()
        seen = reach.select(F.col("source").alias("__source"), F.col("target").alias("__target"))
        frontier = saved(come.join(seen, F.col("source").eqNullSafe(F.col("__source")) & F.col("target").eqNullSafe(F.col("__target")), "left_anti"), "reach")
        if frontier.isEmpty():
            break
        reach = reach.union(frontier)  # of files; their number is that of rounds
        length += 1
    return reach


def route(df: DataFrame, routes: DataFrame, on: str, key: str, target: str, fallback: str) -> DataFrame:
    """df with the target of its key, or the fallback; a route table holds one row for each key."""
    return df.join(routes.dropDuplicates([key]), df[on] == routes[key], "left").withColumn(target, F.coalesce(target, F.lit(fallback))).drop(key)


def call_chain(df: DataFrame, calls: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Look-ups whose keys come from the results before; `status` names the first call without a result, else ok."""
    missing = F.lit(None).cast("string")
    for name, target, key, own in calls:
        df = df.join(target, F.col(key) == F.col(own), "left")
        missing = F.coalesce(missing, F.when(F.col(own).isNull(), name))
    return df.withColumn("status", F.coalesce(missing, F.lit("ok")))


def since(df: DataFrame, key: str, cursor: int) -> DataFrame:
    """Rows after a cursor; one that is not positive means all."""
    return df.where(F.col(key) > cursor) if cursor > 0 else df


def drift(df: DataFrame, document: Column, declared: list[str]) -> DataFrame:
    """df with the declared keys that a JSON document lacks and those it has beside them."""
    keys = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(k) for k in declared])
    return df.withColumn("missing", F.array_except(wanted, keys)).withColumn("extra", F.array_except(keys, wanted))


def pagination(url: Column) -> Column:
    """How a url pages: page-token, page, cursor, offset or unknown, the most specific first."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    has = lambda name: query.rlike(f"(^|&){name}=")
    return F.when(query.contains("page_token="), "page-token").when(has("page"), "page").when(has("cursor"), "cursor").when(has("offset"), "offset").otherwise("unknown")
