"""What may be published: staged targets, the gate over all evidence, schema history, snapshot checks, source switches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.operators import changes
from rowledger.operators.checks import diagnostics, repeated

# What has to be staged for a target.
COMPONENTS = ("registry", "codegen", "bytes", "manifest")
BLOCKER = 3


def publication_gaps(expected: DataFrame, staged: DataFrame, schema_hash: str) -> DataFrame:
    """(target, code): expected (target) against staged (target, a hash per component; null: absent)."""
    by = staged.groupBy("target").agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in COMPONENTS], *[F.min(c).alias(f"_{c}") for c in COMPONENTS])
    j = expected.select("target", F.lit(True).alias("_want")).distinct().join(by, "target", "full_outer")
    want, there = F.col("_want").isNotNull(), F.col("_n").isNotNull()
    found = [F.when(want & ~there, "target.missing"), F.when(~want, "target.stale"), F.when(F.col("_n") > 1, "target.duplicate")]
    for c in COMPONENTS:
        found.append(F.when(want & there & ~F.coalesce((F.col(c) == schema_hash) & (F.col(f"_{c}") == schema_hash), F.lit(False)), f"component.{c}"))
    return j.select("target", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("code"))


def publication_gate(gaps: DataFrame, compatibility: DataFrame, acknowledged: DataFrame, history: bool, initial: bool = False, migrated: bool = True) -> DataFrame:
    """(target, code) of everything that forbids publication; empty: go.

    gaps: of publication_gaps; compatibility (code, severity, target): findings of the schema and data comparison;
    acknowledged (target): removed targets whose hosts have moved.
    """
    nothing = F.lit(None).cast("string")
    worst = compatibility.agg(
        F.coalesce(F.max("severity") >= 2, F.lit(False)).alias("publish.compatibility"),
        F.coalesce(F.bool_or(F.col("code") == "coverage.incomplete"), F.lit(False)).alias("publish.coverage"),
        F.coalesce(F.bool_or(F.col("code").isin("schema.outdated", "migration.pending")), F.lit(False)).alias("publish.workbooks_outdated"),
    )
    flags = {c: F.col(f"`{c}`") for c in worst.columns} | {"publish.history": F.lit(not history and not initial), "publish.migration": F.lit(not migrated)}
    whole = worst.select(F.explode(F.filter(F.array(*[F.when(v, c) for c, v in flags.items()]), lambda x: x.isNotNull())).alias("code"))
    removed = compatibility.where("code = 'target.removed' and target is not null").select("target").distinct().join(acknowledged.select("target"), "target", "left_anti")
    return gaps.select("target", "code").union(whole.select(nothing, "code")).union(removed.select("target", F.lit("publish.host_migration")))


def record_schemas(history: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History (project, sequence, revision, schema_hash, content_hash) with a batch (the same, sequence: its order)
    behind it, each with the hash of its predecessor; and errors (project, revision, code), with which nothing is added.

    A known hash is not recorded again; a revision of another content, or a hash of another content, is an error.
    """
    cols = ["project", "revision", "schema_hash", "content_hash"]
    every = history.select(*cols, F.lit(0).alias("_b"), "sequence").union(batch.select(*cols, F.lit(1), "sequence"))
    at = F.struct("_b", "sequence")
    # The first row of a hash records it.
    kept = every.groupBy("project", "schema_hash").agg(F.min(F.struct("_b", "sequence", "revision", "content_hash")).alias("k")).select("project", "schema_hash", "k.*")
    mine = every.where("_b = 1").withColumn("_at", at)
    other = kept.select("project", "revision", at.alias("_o"), F.col("schema_hash").alias("_h"), F.col("content_hash").alias("_c"))
    taken = mine.join(other, ["project", "revision"]).where((F.col("_o") < F.col("_at")) & ((F.col("_h") != F.col("schema_hash")) | (F.col("_c") != F.col("content_hash"))))
    clash = mine.join(kept.select("project", "schema_hash", F.col("content_hash").alias("_c")), ["project", "schema_hash"]).where(F.col("_c") != F.col("content_hash"))
    errors = taken.select("project", "revision", F.lit("revision.taken").alias("code")).union(clash.select("project", "revision", F.lit("hash.collision"))).distinct()
    bad = errors.select("project", F.lit(True).alias("_bad")).distinct()
    good = kept.join(bad, "project", "left").where("_b = 0 or _bad is null")
    order = Window.partitionBy("project").orderBy("_b", "sequence")
    out = good.select("project", F.row_number().over(order).alias("sequence"), "revision", "schema_hash", "content_hash", F.lag("schema_hash").over(order).alias("previous"))
    return out, errors


def header_findings(expected: dict, declared: dict, actual: dict, capabilities: set[str], release_mode: bool = False, hot_reload: bool = False) -> list[str]:
    """Codes of a source's header: schema_hash and target agree in all three, format_version in two; and whether the
    source may be read at all in this mode."""
    out = []
    if not expected.get("schema_hash") or not expected.get("target"):
        out.append("registry.empty")
    out += [f"{k}.mismatch" for k in ("schema_hash", "target") if len({x.get(k) for x in (expected, declared, actual)}) > 1]
    if not actual.get("format_version") or actual.get("format_version") != declared.get("format_version"):
        out.append("format.mismatch")
    if "read" not in capabilities:
        out.append("source.unreadable")
    if release_mode and "live" in capabilities:
        out.append("source.live_in_release")
    if hot_reload and "watch" not in capabilities:
        out.append("source.not_watchable")
    return out


def validate_snapshot(records: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, row_guid, code) of what makes a candidate unfit, a duplicate once per group.

    records (table_id, row_guid, key, fields array of paths, deps array<struct<table_id, row_guid>>); tables (table_id): bound ones.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    pending = none("row_guid") | F.coalesce(F.col("table_id") <= 0, F.lit(True))
    rules = {"row.pending": (BLOCKER, pending), "key.empty": (BLOCKER, ~pending & none("key")), "field.duplicate": (BLOCKER, ~pending & (F.size(F.array_distinct("fields")) < F.size("fields")))}
    known = records.where(~pending)
    found = [
        diagnostics(records, rules, "table_id", "row_guid").drop("severity"),
        repeated(known, "table_id", "row_guid").select("table_id", "row_guid", F.lit("identity.duplicate").alias("code")),
        known.where(~none("key")).groupBy("table_id", "key").agg(F.count("*").alias("n"), F.min("row_guid").alias("row_guid")).where("n > 1").select("table_id", "row_guid", F.lit("key.duplicate").alias("code")),
        known.join(tables.select("table_id"), "table_id", "left_anti").select("table_id", "row_guid", F.lit("table.unbound").alias("code")),
    ]
    edges = records.select(F.col("table_id").alias("_t"), F.col("row_guid").alias("_g"), F.explode("deps").alias("d")).select("_t", "_g", "d.table_id", "d.row_guid")
    lost = edges.join(known.select("table_id", "row_guid"), ["table_id", "row_guid"], "left_anti")
    found.append(lost.select(F.col("_t").alias("table_id"), F.col("_g").alias("row_guid"), F.lit("ref.dangling").alias("code")).distinct())
    return reduce(DataFrame.union, found)


def switch_source(prev: DataFrame, candidate: DataFrame, header: list[str], found: DataFrame, identity: str, path: str, key: str, values: list[str], deps: str) -> tuple[DataFrame, DataFrame]:
    """(rows, events) after changing to a candidate: it and its changes where nothing was found, else prev and none."""
    events = changes.snapshot_changes(prev, candidate, identity, path, key, values, deps)
    if header or not found.isEmpty():
        return prev, events.limit(0)
    return candidate, events


def order_events(events: DataFrame, *identity: str) -> DataFrame:
    """Events by kind, then identity; for output only."""
    # The kinds in their order of publication.
    kinds = ["Added", "Removed", "Recreated", "Moved", "Renamed", "PropertyChanged", "DependencyChanged"]
    return events.orderBy(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), *identity)
