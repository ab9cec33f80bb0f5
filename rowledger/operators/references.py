"""References between tables: resolution, dangling dependencies, child rows, external keys and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.functions.cells import key_ref, parse_ref, percent, ref_key
from rowledger.operators.tasks import shared_out


def resolve(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs (key, ...) with row_guid and error; targets (key, row_guid).

    Targets are counted before the join, so that a key with many rows joins as one row.
    """
    by = targets.groupBy("key").agg(F.count_distinct("row_guid").alias("_n"), F.min("row_guid").alias("row_guid"))
    out = refs.join(by, "key", "left")
    error = F.when(F.col("key").isNull(), F.lit(None)).when(F.col("_n").isNull(), "ref.unresolved").when(F.col("_n") > 1, "ref.ambiguous")
    return out.withColumn("error", error).withColumn("row_guid", F.when(F.col("error").isNull(), F.col("row_guid"))).drop("_n")


def eligible_tables(fields: DataFrame, tables: DataFrame, members: DataFrame) -> DataFrame:
    """(field, table_id): live tables that a reference field may name, its declared table by name or full name, else all
    tables of its group. fields (field, ref_table, ref_group), tables (table_id, name, full_name, kind), members (ref_group,
    table_id)."""
    live = tables.where("kind = 'asset'")
    names = live.select("table_id", F.explode(F.array_distinct(F.array("name", "full_name"))).alias("ref_table"))
    by_name = fields.where("ref_table is not null").join(names, "ref_table").select("field", "table_id")
    groups = fields.where("ref_table is null and ref_group is not null").join(members, "ref_group").join(live.select("table_id"), "table_id", "left_semi")
    return by_name.union(groups.select("field", "table_id")).distinct()


def resolve_tokens(refs: DataFrame, targets: DataFrame, eligible: DataFrame) -> DataFrame:
    """refs (field, token, ...) with dst_table, dst_guid, canonical token and error.

    targets (table_id, key, row_guid): indexable rows under their composite keys; eligible (field, table_id). A null token is
    no reference. Targets are counted before the join, so that a key of many rows meets its references as one row.
    """
    # Two identities under a key are told by the least and the greatest one, in one aggregate whose tasks are as many as the targets ask for.
    by = shared_out(targets.select(F.col("table_id").alias("_t"), F.col("key").alias("_k"), "row_guid"), targets.count(), "_t", "_k")
    by = by.groupBy("_t", "_k").agg(F.when(F.min("row_guid") < F.max("row_guid"), 2).otherwise(1).alias("_n"), F.min("row_guid").alias("_guid"))
    allowed = eligible.select("field", F.col("table_id").alias("_t"), F.lit(True).alias("_ok")).distinct()
    open_fields = eligible.select("field", F.lit(True).alias("_any")).distinct()
    j = refs.withColumn("_p", parse_ref(F.col("token"))).withColumn("_t", F.col("_p.table_id")).withColumn("_k", ref_key(F.col("_p")))
    j = j.join(open_fields, "field", "left").join(allowed, ["field", "_t"], "left").join(by, ["_t", "_k"], "left")
    error = (
        F.when(F.col("token").isNull(), F.lit(None))
        .when(F.col("_p").isNull(), "ref.malformed")
        .when(F.col("_any").isNull(), "ref.no_target")
        .when(F.col("_ok").isNull(), "ref.wrong_table")
        .when(F.col("_n").isNull(), "ref.unresolved")
        .when(F.col("_n") > 1, "ref.ambiguous")
    )
    j = j.withColumn("error", error)
    good = F.col("token").isNotNull() & F.col("error").isNull()
    token = F.when(good, F.concat(F.col("_t").cast("string"), F.lit(":"), F.array_join(F.transform(F.col("_p.parts"), percent), "|")))
    return j.select(*refs.columns, F.when(good, F.col("_t")).alias("dst_table"), F.when(good, F.col("_guid")).alias("dst_guid"), token.alias("canonical"), "error")


def rewrite_tokens(refs: DataFrame, moved: DataFrame) -> DataFrame:
    """refs (token, formula, ...) with new_token and error under moved (table_id, key, new_key, error) of rekeyed tables:
    a token into such a table is written with the row's new key, one that names no row there or an ambiguous one is an
    error, and formula cells and other tables' tokens stay."""
    tables = moved.select(F.col("table_id").alias("_t"), F.lit(True).alias("_rekeyed")).distinct()
    by = moved.select(F.col("table_id").alias("_t"), F.col("key").alias("_k"), "new_key", F.col("error").alias("_e"))
    j = refs.withColumn("_p", parse_ref(F.col("token"))).withColumn("_t", F.col("_p.table_id")).withColumn("_k", ref_key(F.col("_p")))
    j = j.join(tables, "_t", "left").join(by, ["_t", "_k"], "left")
    mine = F.col("_rekeyed").isNotNull() & (F.coalesce("formula", F.lit("")) == "")
    error = F.when(mine & F.col("_e").isNotNull(), F.col("_e")).when(mine & F.col("new_key").isNull(), "ref.absent")
    j = j.withColumn("error", error)
    token = F.when(mine & F.col("error").isNull(), key_ref(F.col("_t"), F.col("new_key"))).otherwise(F.col("token"))
    return j.select(*refs.columns, token.alias("new_token"), "error")


def dangling(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges whose destination is no record's identity."""
    to = records.select(F.col("table_id").alias("dst_table"), F.col("row_guid").alias("dst_guid"))
    return edges.join(to, ["dst_table", "dst_guid"], "left_anti")


def attach_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """children (parent_guid, ...) with an error where the parent is missing or ambiguous."""
    n = parents.groupBy(F.col("row_guid").alias("parent_guid")).agg(F.count("*").alias("_n"))
    error = F.when(F.col("parent_guid").isNull(), "child.no_parent").when(F.col("_n").isNull(), "child.unknown_parent").when(F.col("_n") > 1, "child.ambiguous_parent")
    return children.join(n, "parent_guid", "left").withColumn("error", error).drop("_n")


def aggregate_children(children: DataFrame, ordinal: str, *values: str) -> DataFrame:
    """(parent_guid, items): a parent's children, in order; the list is the parent's own value."""
    items = F.sort_array(F.collect_list(F.struct(ordinal, *values)))
    return children.where(F.col("error").isNull() & (F.col(ordinal) > 0)).groupBy("parent_guid").agg(items.alias("items"))


def aggregate_child_maps(children: DataFrame, *values: str) -> DataFrame:
    """(parent_guid, items): a parent's children by their map key, as a map that is the parent's own value. A key that
    repeats under a parent is left to its finding (child_rows), and the parent with it."""
    sound = children.where(F.col("error").isNull() & F.col("map_key").isNotNull())
    twice = sound.groupBy("parent_guid", "map_key").count().where("count > 1").select("parent_guid").distinct()
    entries = F.collect_list(F.struct(F.col("map_key"), F.struct(*values)))
    return sound.join(twice, "parent_guid", "left_anti").groupBy("parent_guid").agg(F.map_from_entries(F.array_sort(entries)).alias("items"))


def localize(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (text_key, ...) with the text of the key, or the key itself and missing = true."""
    return rows.join(texts.select("text_key", F.col("text").alias("_t")), "text_key", "left").withColumn("missing", F.col("text_key").isNotNull() & F.col("_t").isNull()).withColumn("text", F.coalesce("_t", "text_key")).drop("_t")


def bind_external(rows: DataFrame, families: DataFrame) -> DataFrame:
    """rows (family, token, ...) with value and error; families (family, token, value). If families say how they write a value
    (canonical), it must be read back as the same value, or the token is an error."""
    known = families.select("family").distinct().withColumn("_f", F.lit(True))
    out = rows.withColumn("token", F.trim("token")).join(known, "family", "left").join(families, ["family", "token"], "left")
    lost = F.lit(False)
    if "canonical" in families.columns:
        back = families.select("family", F.col("token").alias("canonical"), F.col("value").alias("_back"))
        out = out.join(back, ["family", "canonical"], "left")
        lost = ~F.col("_back").eqNullSafe(F.col("value"))
    error = F.when(F.col("_f").isNull(), "external.family").when(F.coalesce("token", F.lit("")) == "", "external.empty").when(F.col("value").isNull(), "external.unregistered").when(lost, "external.round_trip")
    return out.withColumn("error", error).drop("_f", "_back", "canonical")
