"""Releases: rows of one target with references resolved, their checks and their content hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.catalog import Catalog, Table
from rowledger.functions.cells import row_hash, row_path
from rowledger.operators import references
from rowledger.operators.tasks import shared_out


def build(rows: DataFrame, table: Table, target: str) -> DataFrame:
    """Long records (table_id, row_guid, key, path, field, value) of the target's fields, values that are set only.

    rows: row_guid, key and a text column per field, null where the state is neither Value nor Defaulted.
    """
    fields = [f for f in table.fields if target in f.targets]
    entries = F.array(*[F.struct(F.lit(f.field_id).alias("field"), F.col(f.name).cast("string").alias("value")) for f in fields])
    out = rows.where("row_guid is not null and key is not null").select(F.lit(table.table_id).alias("table_id"), "row_guid", "key", row_path(F.lit(table.sheet), F.col("key")).alias("path"), F.explode(entries).alias("e"))
    return out.select("table_id", "row_guid", "key", "path", "e.*").where("value is not null")


def content_hash(records: DataFrame, prefixes: tuple[int, ...] = (8, 6, 4, 2)) -> DataFrame:
    """(bucket, digest) by the shortest guid prefix: a tree of digests, without a global sort.

    A record's digest joins those of its longest prefix, these join by the next shorter one, and so on. As guids are
    random, the list of a leaf stays small up to 10^12 records, and two more digits make at most 256 buckets one.
    """
    rows = records.select(F.substring("row_guid", 1, prefixes[0]).alias("bucket"), row_hash(*[F.col(c) for c in ("table_id", "row_guid", "key", "path", "field", "value")]).alias("h"))
    level = rows.groupBy("bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"))
    for n in prefixes[1:]:
        parts = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"])
        level = level.groupBy(F.substring("bucket", 1, n).alias("_b")).agg(F.sha2(F.array_join(parts, ""), 256).alias("digest")).withColumnRenamed("_b", "bucket")
    return level


def root_hash(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), ""), 256).alias("content_hash"))


def target_fields(catalog: Catalog, target: str) -> list[tuple[int, int, str, int | None]]:
    """(table_id, field_id, property path, referenced table) of what a target holds: its tables, and in them its fields, a
    field of a struct only where all structs around it are the target's as well (paths a.b lie in a)."""
    out = []
    for t in catalog.live(target):
        own = {f.name: f for f in t.fields}
        around = lambda f: [own[p] for p in (f.name.rsplit(".", i)[0] for i in range(1, f.name.count(".") + 1)) if p in own]  # noqa: B023, E731
        out += [(t.table_id, f.field_id, f.name, f.ref_table) for f in t.fields if target in f.targets and all(target in x.targets for x in around(f))]
    return out


def assemble(rows: DataFrame, values: DataFrame, catalog: Catalog, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, dependencies, blockers) of one target.

    rows (table_id, row_guid, key, indexable); values (table_id, row_guid, property_path, state, text). Only indexable rows
    with identity and key take part, and values that are set. A reference becomes the identity table:guid of its row, is
    resolved within the target's tables alone, and is a dependency; one that does not resolve is a blocker (table_id,
    row_guid, property_path, code) and forbids the release.
    """
    spark = rows.sparkSession
    fields = spark.createDataFrame(target_fields(catalog, target), "table_id int, field int, property_path string, ref_table int")
    sheets = spark.createDataFrame([(t.table_id, t.sheet) for t in catalog.live(target)], "table_id int, sheet string")
    live = rows.where("indexable and row_guid <> '' and key <> ''").join(sheets, "table_id").select("table_id", "row_guid", "key", row_path(F.col("sheet"), F.col("key")).alias("path"))
    set_values = values.where(F.col("state").isin("Value", "Defaulted") & F.col("text").isNotNull() & F.col("row_guid").isNotNull()).select("table_id", "row_guid", "property_path", "text")
    # Identities are many and have few values each: they are shared out by their number, so that what a task sorts stays of one size.
    n, identity = set_values.count(), ["table_id", "row_guid"]
    found = shared_out(set_values.join(F.broadcast(fields), ["table_id", "property_path"]), n, *identity).join(shared_out(live, n, *identity).hint("merge"), identity)
    name = F.concat_ws(".", F.col("table_id").cast("string"), F.col("field").cast("string"))
    eligible = fields.where("ref_table is not null").join(sheets.select(F.col("table_id").alias("ref_table")), "ref_table").select(name.alias("field"), F.col("ref_table").alias("table_id"))
    refs = found.where("ref_table is not null").select("table_id", "row_guid", "key", "path", F.col("field").alias("number"), "property_path", name.alias("field"), F.col("text").alias("token"))
    # Records, dependencies and blockers all read it, so it is written once.
    resolved = references.resolve_tokens(refs, live.select("table_id", "key", "row_guid"), eligible).checkpoint()
    to = F.concat(F.col("dst_table").cast("string"), F.lit(":"), "dst_guid")
    plain = found.where("ref_table is null").select("table_id", "row_guid", "key", "path", "field", F.col("text").alias("value"))
    records = plain.union(resolved.where("error is null").select("table_id", "row_guid", "key", "path", "number", to))
    dependencies = resolved.where("error is null").select("table_id", "row_guid", "dst_table", "dst_guid").distinct()
    return records, dependencies, resolved.where("error is not null").select("table_id", "row_guid", "property_path", F.col("error").alias("code"))


def validate(records: DataFrame, dependencies: DataFrame | None = None, schema_hash: str | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(code, n) of what forbids publication: rows without identity or key, an identity under two keys, repeated keys and
    fields, dependencies (dst_table, dst_guid) on what the release does not hold, no schema hash, and findings (severity)
    of errors or blockers. Records (table_id, row_guid, key, field, ...)."""
    spark = records.sparkSession
    rows = records.select("table_id", "row_guid", "key").distinct()
    count = lambda df, code: df.agg(F.lit(code).alias("code"), F.count("*").alias("n"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = [
        count(rows.where(empty("row_guid")), "release.no_identity"),
        count(rows.where(empty("key")), "release.no_key"),
        count(rows.where(~empty("row_guid")).groupBy("table_id", "row_guid").count().where("count > 1"), "release.duplicate_identity"),
        count(rows.where(~empty("key")).groupBy("table_id", "key").count().where("count > 1"), "release.duplicate_key"),
        count(records.groupBy("table_id", "row_guid", "field").count().where("count > 1"), "release.duplicate_field"),
    ]
    if dependencies is not None:
        held = rows.select(F.col("table_id").alias("dst_table"), F.col("row_guid").alias("dst_guid"))
        out.append(count(dependencies.select("dst_table", "dst_guid").distinct().join(held, ["dst_table", "dst_guid"], "left_anti"), "release.dangling"))
    if schema_hash is not None:
        out.append(spark.range(1).select(F.lit("release.no_schema").alias("code"), F.lit(0 if schema_hash.strip("0") else 1).cast("bigint").alias("n")))
    if findings is not None:
        out.append(count(findings.where("severity >= 2"), "release.findings"))
    return reduce(DataFrame.union, out)


def sound_schema(schema_hash: str) -> bool:
    """A schema hash that is not all zeros."""
    return bool(schema_hash.strip("0"))


#: Records of a leaf of the digest tree, on average.
LEAF_ROWS = 200_000


def row_index(records: DataFrame) -> DataFrame:
    """(table_id, row_guid, key, path, keyless, two_keys, repeats) of each identity: one shuffle of the records, after which fields
    and rows are counted where they lie. keyless: a record without key; two_keys: two keys; repeats: a field twice."""
    kept = records.where("coalesce(row_guid, '') <> ''").withColumn("key", F.nullif("key", F.lit(""))).repartition("table_id", "row_guid")
    fields = kept.groupBy("table_id", "row_guid", "field").agg(F.count("*").alias("n"), F.count("key").alias("k"), F.min("key").alias("key"), F.max("key").alias("last"), F.min("path").alias("path"))
    rows = fields.groupBy("table_id", "row_guid").agg(F.min("key").alias("key"), F.min("path").alias("path"), (F.sum("k") < F.sum("n")).alias("keyless"), F.coalesce(F.min("key") != F.max("last"), F.lit(False)).alias("two_keys"), (F.max("n") > 1).alias("repeats"))
    return rows.select("table_id", "row_guid", "key", "path", "keyless", "two_keys", "repeats")


def index_faults(index: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """(code, n) of what an index of rows shows: one aggregate of its flags, one of its keys, and an anti join of what rows depend on."""
    flags = {"release.no_key": "keyless", "release.duplicate_identity": "two_keys", "release.duplicate_field": "repeats"}
    sums = index.agg(*[F.count_if(c).alias(code) for code, c in flags.items()])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.col(f"`{code}`").alias("n")) for code in flags])).alias("x")).select("x.*")
    keys = index.where("key is not null").groupBy("table_id", "key").count().where("count > 1")
    out = out.union(keys.agg(F.lit("release.duplicate_key"), F.count("*")))
    if dependencies is not None:
        held = index.select(F.col("table_id").alias("dst_table"), F.col("row_guid").alias("dst_guid"))
        lost = dependencies.select("dst_table", "dst_guid").distinct().join(held, ["dst_table", "dst_guid"], "left_anti")
        out = out.union(lost.agg(F.lit("release.dangling"), F.count("*")))
    return out


def leaf_digits(rows: int) -> int:
    """Hexadecimal digits of a guid that make leaves of LEAF_ROWS records."""
    return next(n for n in range(1, 17) if rows <= LEAF_ROWS * 16**n)


def digest_leaves(records: DataFrame, digits: int, *more: Column) -> DataFrame:
    """(table_id, prefix, n, digest, more): the records of a table whose guids begin alike, whatever their order and files. A record
    without identity is of the empty prefix."""
    h = row_hash(*[F.col(c) for c in ("table_id", "row_guid", "key", "path", "field", "value")])
    rows = records.withColumn("prefix", F.coalesce(F.substring("row_guid", 1, digits), F.lit(""))).withColumn("h", h)
    return rows.groupBy("table_id", "prefix").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"), *more)


def tree_root(leaves: DataFrame, digits: int, header: str) -> DataFrame:
    """(content_hash) over a header and leaves: two digits at a time they join to at most 256 a node, up to one digest a table."""
    level, named = leaves.select("table_id", "prefix", "digest"), lambda: F.sort_array(F.collect_list(F.struct("prefix", "digest")))
    joined = lambda x: F.sha2(F.array_join(F.transform(x, lambda e: F.concat_ws(":", e["prefix"], e["digest"])), "|"), 256).alias("digest")
    for n in [*range(digits - 2, 0, -2), 0]:
        level = level.groupBy("table_id", F.substring("prefix", 1, n).alias("_p")).agg(joined(named())).withColumnRenamed("_p", "prefix")
    tables = F.transform(F.sort_array(F.collect_list(F.struct("table_id", "digest"))), lambda e: F.concat_ws(":", e["table_id"].cast("string"), e["digest"]))
    return level.agg(F.sha2(F.concat(F.lit(header + "|"), F.array_join(tables, "|")), 256).alias("content_hash"))


def root_revision(content_hash: Column) -> Column:
    """A release's revision: the first 16 digits of its content hash."""
    return F.substring(content_hash, 1, 16)


def freshness(manifests: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (target, schema_hash, content_hash) with reason: null if the staged manifest matches in all."""
    m = manifests.select("target", F.col("schema_hash").alias("_s"), F.col("content_hash").alias("_c"), F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "target").when(~F.col("_s").eqNullSafe(F.col("schema_hash")), "schema_hash").when(~F.col("_c").eqNullSafe(F.col("content_hash")), "content_hash")
    return expected.join(m, "target", "left").withColumn("reason", reason).drop("_s", "_c", "_there")
