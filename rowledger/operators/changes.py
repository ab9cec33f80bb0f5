"""Differences between versions of a table, by identity. Every version is joined once, null-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both(prev: DataFrame, current: DataFrame, identity: str, columns: list[str]) -> DataFrame:
    """Full outer join on identity: p_ and n_ columns, and in_prev, in_next."""
    a = prev.select(F.col(identity), *[F.col(c).alias(f"p_{c}") for c in columns], F.lit(True).alias("in_prev"))
    b = current.select(F.col(identity), *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("in_next"))
    return a.join(b, identity, "full_outer")


def same(columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"p_{c}").eqNullSafe(F.col(f"n_{c}")) for c in columns])


def classify(prev: DataFrame, current: DataFrame, identity: str, key: str, values: list[str]) -> DataFrame:
    """(identity, change_kind) of the current rows: Added, Renamed, Modified or Unchanged."""
    j = both(prev, current, identity, [key, *values]).where("in_next")
    kind = F.when(F.col("in_prev").isNull(), "Added").when(~same([key]), "Renamed").when(same(values), "Unchanged").otherwise("Modified")
    return j.select(identity, kind.alias("change_kind"))


def removed(prev: DataFrame, current: DataFrame, identity: str) -> DataFrame:
    return prev.join(current.select(identity), identity, "left_anti")


def snapshot_changes(prev: DataFrame, current: DataFrame, identity: str, path: str, key: str, values: list[str], deps: str) -> DataFrame:
    """(identity, kind): Added, Removed, or any of Moved, Renamed, PropertyChanged, DependencyChanged."""
    j = both(prev, current, identity, [path, key, *values, deps])
    here = F.col("in_prev") & F.col("in_next")
    kinds = F.array(
        F.when(F.col("in_prev").isNull(), "Added"),
        F.when(F.col("in_next").isNull(), "Removed"),
        F.when(here & ~same([path]), "Moved"),
        F.when(here & ~same([key]), "Renamed"),
        F.when(here & ~same(values), "PropertyChanged"),
        F.when(here & ~same([deps]), "DependencyChanged"),
    )
    return j.select(identity, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def commit_snapshot(prev: DataFrame, current: DataFrame, path: str, key: str, values: list[str], deps: str, patchable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, events) of the next version of a database.

    prev: entries (table_id, row_guid, state Resident or Missing, generation, path, key, values, deps); current: the same
    without state and generation. Whoever goes stays as a Missing entry and is Removed once; who comes back is Added with
    its old generation; a row that cannot be patched (patchable, over p_ and n_ columns, is false) is Recreated under the
    next generation; else Moved, Renamed, PropertyChanged and DependencyChanged as they apply. The version rises if and
    only if there are events.
    """
    columns, by = list(dict.fromkeys([path, key, *values, deps])), ["table_id", "row_guid"]
    a = prev.select(*by, "state", "generation", *[F.col(c).alias(f"p_{c}") for c in columns])
    b = current.select(*by, F.lit(True).alias("in_next"), *[F.col(c).alias(f"n_{c}") for c in columns])
    j = a.join(b, by, "full_outer").withColumn("in_next", F.col("in_next").isNotNull())
    here = (F.col("state") == "Resident") & F.col("in_next")
    j = j.withColumn("_here", F.coalesce(here, F.lit(False))).withColumn("_patch", F.coalesce(patchable, F.lit(True)) if patchable is not None else F.lit(True))
    stays = F.col("_here") & F.col("_patch")
    kinds = F.array(
        F.when(~F.col("in_next") & (F.col("state") == "Resident"), "Removed"),
        F.when(F.col("in_next") & (F.col("state").isNull() | (F.col("state") == "Missing")), "Added"),
        F.when(F.col("_here") & ~F.col("_patch"), "Recreated"),
        F.when(stays & ~same([path]), "Moved"),
        F.when(stays & ~same([key]), "Renamed"),
        F.when(stays & ~same(values), "PropertyChanged"),
        F.when(stays & ~same([deps]), "DependencyChanged"),
    )
    one = F.lit(1).cast("bigint")
    generation = F.when(F.col("state").isNull(), one).when(F.col("_here") & ~F.col("_patch"), F.col("generation") + 1).otherwise(F.col("generation"))
    entries = j.select(*by, F.when(F.col("in_next"), "Resident").otherwise("Missing").alias("state"), generation.alias("generation"), *[F.when(F.col("in_next"), F.col(f"n_{c}")).otherwise(F.col(f"p_{c}")).alias(c) for c in columns])
    events = j.select(*by, generation.alias("generation"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    return entries, events


def diff_workbooks(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """As diff_versions for rows (table_id, row_guid or null, row_number, key, location, values): rows without identity
    pair by table and row number, the first one of a number."""
    def named(df: DataFrame) -> DataFrame:
        name = F.coalesce(F.concat(F.lit("g:"), "row_guid"), F.concat(F.lit("p:"), F.col("table_id").cast("string"), F.lit(":"), F.col("row_number").cast("string")))
        row = F.struct("row_number", "key", "location", *values)
        return df.withColumn("identity", name).groupBy("identity").agg(F.min(row).alias("_r")).select("identity", "_r.key", "_r.location", *[f"_r.{v}" for v in values])

    return diff_versions(named(left), named(right), "identity", "key", "location", values)


def diff_versions(left: DataFrame, right: DataFrame, identity: str, key: str, location: str, values: list[str]) -> DataFrame:
    """(identity, property, kind, before, after): added and removed rows, renames, moves, and each changed property."""
    j = both(left, right, identity, [key, location, *values])
    here = F.col("in_prev") & F.col("in_next")

    def entry(prop: str, kind: str, c: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(prop).alias("property"), F.lit(kind).alias("kind"), F.col(f"p_{c}").cast("string").alias("before"), F.col(f"n_{c}").cast("string").alias("after")))

    entries = [entry("", "added", key, F.col("in_prev").isNull()), entry("", "removed", key, F.col("in_next").isNull()), entry("$key", "renamed", key, here & ~same([key])), entry("$location", "moved", location, here & ~same([location]))]
    entries += [entry(v, "modified", v, here & ~same([v])) for v in values]
    return j.select(identity, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select(identity, "e.*")
