"""Edits over a mounted version: overlay, errors of the edits, kinds of the commit, and identities owned elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.functions.cells import canonical_labels, write_cell
from rowledger.operators import graph
from rowledger.operators import identity as identities

LAST_REVISION = 4294967295


def _joined(rows: DataFrame, drafts: DataFrame, identity: str, values: list[str]) -> DataFrame:
    a = rows.select(identity, "revision", *values, F.lit(True).alias("_there"))
    b = drafts.select(identity, F.col("kind").alias("_kind"), *[F.col(v).alias(f"_{v}") for v in values])
    j = a.join(b, identity, "full_outer")
    there, kind = F.col("_there").isNotNull(), F.col("_kind")
    error = F.when((kind == "add") & there, "draft.taken").when(kind.isin("edit", "delete") & ~there, "draft.absent").when((kind == "edit") & (F.col("revision") >= LAST_REVISION), "draft.revision_overflow")
    return j.withColumn("_error", error)


def overlay(rows: DataFrame, drafts: DataFrame, identity: str, values: list[str]) -> DataFrame:
    """rows (identity, revision, values) under drafts (identity, kind add, edit or delete, values; one for an identity).

    An edited row gets the draft's values and the next revision, an added one revision 0; a draft with an error has no
    effect. `dirty` marks what a draft made.
    """
    j = _joined(rows, drafts, identity, values)
    takes = F.coalesce(F.col("_error").isNull() & F.col("_kind").isin("add", "edit"), F.lit(False))
    gone = F.coalesce(F.col("_error").isNull() & (F.col("_kind") == "delete"), F.lit(False))
    revision = F.when(~takes, F.col("revision")).when(F.col("_kind") == "add", 0).otherwise(F.col("revision") + 1).cast("bigint")
    kept = j.where(~gone & (F.col("_there").isNotNull() | takes))
    return kept.select(identity, revision.alias("revision"), *[F.when(takes, F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values], takes.alias("dirty"))


def errors(rows: DataFrame, drafts: DataFrame, identity: str) -> DataFrame:
    """(identity, code) of drafts that cannot be saved."""
    return _joined(rows, drafts, identity, []).where("_error is not null").select(identity, F.col("_error").alias("code"))


def commit_kinds(rows: DataFrame, drafts: DataFrame, identity: str, key: str, values: list[str]) -> DataFrame:
    """(identity, change_kind) of what a commit of the drafts does: Added, Deleted, Renamed or Modified."""
    j = _joined(rows, drafts, identity, [key, *values]).where("_kind is not null and _error is null")
    kind = F.when(F.col("_kind") == "add", "Added").when(F.col("_kind") == "delete", "Deleted").when(~F.col(key).eqNullSafe(F.col(f"_{key}")), "Renamed").otherwise("Modified")
    return j.select(identity, kind.alias("change_kind"))


def owned_elsewhere(fresh: DataFrame, rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """fresh (workbook_id, row_guid) whose guid a row of another workbook holds that the same change does not delete."""
    held = rows.join(deleted.select("row_guid"), "row_guid", "left_anti").select("row_guid", F.col("workbook_id").alias("_w"))
    by = held.groupBy("row_guid").agg(F.min("_w").alias("_least"), F.max("_w").alias("_most"))
    other = (F.col("_least") != F.col("workbook_id")) | (F.col("_most") != F.col("workbook_id"))
    return fresh.join(by, "row_guid").where(other).select(*fresh.columns)


def target_changes(tables: DataFrame, *keys: str) -> DataFrame:
    """(keys, target, change, severity) from rows with arrays `before` and `after` of target tags."""
    def entries(left: str, right: str, change: str, severity: int) -> Column:
        return F.transform(F.array_except(F.coalesce(left, F.array()), F.coalesce(right, F.array())), lambda x: F.struct(x.alias("target"), F.lit(change).alias("change"), F.lit(severity).alias("severity")))

    both = F.concat(entries("after", "before", "added", 0), entries("before", "after", "removed", 1))
    return tables.select(*keys, F.explode(both).alias("e")).select(*keys, "e.*")


def patch_conflicts(patches: DataFrame, *cell: str) -> DataFrame:
    """Cells that more than one patch writes, with how many do."""
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cell])
    return patches.where(there).groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1")


def check_save(items: DataFrame, base: DataFrame, theirs: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """(table_id, row_guid, code) of items (workbook_id, table_id, row_guid, revision, deleted) that cannot be saved.

    base (table_id, row_guid, revision): what the editor mounted; theirs (table_id, row_guid): the workbook now;
    elsewhere (workbook_id, table_id, row_guid): all live rows of the project. The first code that holds is given.
    """
    by = ["table_id", "row_guid"]
    n = items.where("row_guid is not null").groupBy(*by).agg(F.count("*").alias("_n"))
    gone = items.where("deleted").select(*by).distinct()
    held = elsewhere.join(gone, by, "left_anti").groupBy(*by).agg(F.min("workbook_id").alias("_least"), F.max("workbook_id").alias("_most"))
    j = items.join(n, by, "left").join(base.select(*by, F.col("revision").alias("_r")), by, "left")
    j = j.join(theirs.select(*by, F.lit(True).alias("_theirs")), by, "left").join(held, by, "left")
    new = F.col("_r").isNull()
    other = F.coalesce((F.col("_least") != F.col("workbook_id")) | (F.col("_most") != F.col("workbook_id")), F.lit(False))
    code = (
        F.when(F.coalesce("row_guid", F.lit("")) == "", "save.no_identity")
        .when(F.col("_n") > 1, "save.repeated")
        .when(~new & ~F.col("revision").eqNullSafe(F.col("_r")), "save.revision")
        .when(new & ~F.col("revision").eqNullSafe(F.lit(0)), "save.new_revision")
        .when(F.col("deleted") & new, "save.absent")
        .when(~F.col("deleted") & ~new & F.col("_theirs").isNull(), "save.deleted_by_others")
        .when(~F.col("deleted") & new & other, "save.owned_elsewhere")
    )
    return j.select(*by, code.alias("code")).where("code is not null").distinct()


def create_rows(rows: DataFrame, wanted: DataFrame, guid: Column) -> tuple[DataFrame, DataFrame]:
    """rows (table_id, key, path, row_guid, revision, values) with wanted ones (table_id, key, path, values) of a new
    identity and revision 0, and errors (path, code): a path or key that is taken, or wanted twice.

    A random guid has to be written before it is read twice, so the new rows are checkpointed.
    """
    taken = [
        wanted.join(rows.select("path"), "path", "left_semi").select("path", F.lit("create.path_taken").alias("code")),
        wanted.join(rows.select("table_id", "key"), ["table_id", "key"], "left_semi").select("path", F.lit("create.key_taken").alias("code")),
        wanted.groupBy("path").count().where("count > 1").select("path", F.lit("create.wanted_twice").alias("code")),
        wanted.join(wanted.groupBy("table_id", "key").count().where("count > 1"), ["table_id", "key"], "left_semi").select("path", F.lit("create.wanted_twice").alias("code")),
    ]
    errors = reduce(DataFrame.union, taken).distinct()
    fresh = wanted.join(errors.select("path"), "path", "left_anti").withColumn("row_guid", guid).withColumn("revision", F.lit(0).cast(rows.schema["revision"].dataType)).checkpoint()
    return rows.unionByName(fresh.select(rows.columns)), errors


def copy_rows(rows: DataFrame, copies: DataFrame, guid: Column) -> tuple[DataFrame, DataFrame]:
    """As create_rows for copies (path, new_path, new_key) of existing rows; a source that is absent is an error."""
    source = rows.join(copies, "path")
    wanted = source.drop("path", "key", "row_guid", "revision").withColumnRenamed("new_path", "path").withColumnRenamed("new_key", "key")
    out, errors = create_rows(rows, wanted, guid)
    return out, errors.union(copies.join(rows, "path", "left_anti").select(F.col("new_path").alias("path"), F.lit("copy.no_source").alias("code")))


def set_labels(rows: DataFrame, wanted: DataFrame, identity: str) -> DataFrame:
    """rows (labels, dirty, ...) under wanted (identity, labels): blank ones dropped, distinct, sorted; a change marks the row."""
    j = rows.join(wanted.select(identity, canonical_labels(F.col("labels")).alias("_l")), identity, "left")
    changed = F.col("_l").isNotNull() & ~F.col("_l").eqNullSafe(F.col("labels"))
    return j.withColumn("dirty", F.col("dirty") | changed).withColumn("labels", F.coalesce("_l", "labels")).select(rows.columns)


def import_into(resident: DataFrame, imported: DataFrame, workbook: str) -> tuple[DataFrame, DataFrame]:
    """resident rows after the import of one workbook, and errors (row_guid, code); with any error nothing changes.

    Both: workbook_id, table_id, key, path, row_guid, values; resident has `dirty` as well. Refused while the workbook has
    unsaved edits, and for a guid, path or key that repeats or that another workbook holds. `reused` marks known guids.
    """
    mine, others = resident.where(F.col("workbook_id") == workbook), resident.where(F.col("workbook_id") != workbook)
    found = [mine.where("dirty").select("row_guid", F.lit("import.unsaved").alias("code"))]
    for code, by in (("import.guid", ["row_guid"]), ("import.path", ["path"]), ("import.key", ["table_id", "key"])):
        twice = imported.join(imported.groupBy(*by).count().where("count > 1"), by, "left_semi").select("row_guid")
        held = imported.join(others.select(*by), by, "left_semi").select("row_guid")
        found.append(twice.union(held).select("row_guid", F.lit(code).alias("code")))
    errors = reduce(DataFrame.union, found).distinct()
    bad = errors.agg((F.count("*") > 0).alias("_bad"), F.lit(1).alias("_one"))
    known = mine.select("table_id", "row_guid", F.lit(True).alias("_k")).distinct()
    new = imported.join(known, ["table_id", "row_guid"], "left").withColumn("reused", F.col("_k").isNotNull()).withColumn("dirty", F.lit(False))
    columns = [*resident.columns, "reused"]
    # One flag decides which side stays: a join with a single row.
    with_flag = lambda df: df.withColumn("_one", F.lit(1)).join(F.broadcast(bad), "_one")
    old = with_flag(mine.withColumn("reused", F.lit(False))).where("_bad").select(columns)
    return others.withColumn("reused", F.lit(False)).select(columns).union(old).union(with_flag(new).where("not _bad").select(columns)), errors


def pending_changes(rows: DataFrame, drafts: DataFrame, identity: str, values: list[str]) -> DataFrame:
    """(identity, kind, property, before, after) of drafts that would take effect, a row per field that changes."""
    j = _joined(rows, drafts, identity, values).where("_kind is not null and _error is null")
    add, gone = F.col("_kind") == "add", F.col("_kind") == "delete"

    def entry(v: str) -> Column:
        before, after = F.when(~add, F.col(v).cast("string")), F.when(~gone, F.col(f"_{v}").cast("string"))
        return F.when(~before.eqNullSafe(after), F.struct(F.lit(v).alias("property"), before.alias("before"), after.alias("after")))

    return j.select(identity, F.col("_kind").alias("kind"), F.explode(F.filter(F.array(*[entry(v) for v in values]), lambda e: e.isNotNull())).alias("e")).select(identity, "kind", "e.*")


def source_blockers(items: DataFrame, mounted: DataFrame, now: DataFrame) -> DataFrame:
    """(workbook_id, code) of the workbooks of a save that are not what the editor mounted: mounted and now (workbook_id,
    fingerprint). A save with any blocker is refused as a whole."""
    a, b = mounted.select("workbook_id", F.col("fingerprint").alias("_a")), now.select("workbook_id", F.col("fingerprint").alias("_b"))
    j = items.select("workbook_id").distinct().join(a, "workbook_id", "left").join(b, "workbook_id", "left")
    return j.where(F.col("_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).select("workbook_id", F.when(F.col("_b").isNull(), "save.source_gone").otherwise("save.source_changed").alias("code"))


def conflict_blockers(scope: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(node, code) of the rows of a save's scope whose conflict (node) is open; with any of them nothing is saved."""
    return scope.join(conflicts.select("node").distinct(), "node", "left_semi").select("node", F.lit("save.conflict_open").alias("code"))


def save_scope(dirty: DataFrame, edges: DataFrame, picked: DataFrame) -> DataFrame:
    """dirty (node) that a save of picked (node) has to include: all that earlier moves and deletions (edges src, dst) link to it."""
    return graph.impact(edges, picked).join(dirty.select("node").distinct(), "node", "left_semi")


def write_plan(rows: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches, blockers) of saved edits; write the patches only where there is no blocker.

    rows (table_id, row_guid, row_number, revision); edits (table_id, row_guid, kind: add, edit or delete, cells
    map<property_path, struct<state, text>>), one per identity, an edit without cells bumps the revision alone.
    patches (table_id, row_guid, row_number, property_path, text): added rows go behind the last one of their table, in
    order of identity, at revision 0; others rise by one; a deleted row is one patch without property_path.
    blockers (table_id, row_guid, code): a table without rows, a taken or absent identity, an invalid value, the last revision.
    """
    by = ["table_id", "row_guid"]
    tables = rows.groupBy("table_id").agg(F.lit(True).alias("_known"))
    there = rows.select(*by, "row_number", "revision").withColumn("_there", F.lit(True))
    j = edits.join(there, by, "left").join(tables, "table_id", "left")
    invalid = F.coalesce(F.exists(F.map_values("cells"), lambda c: c["state"] == "Invalid"), F.lit(False))
    add, gone = F.col("kind") == "add", F.col("kind") == "delete"
    code = (
        F.when(F.col("_known").isNull(), "write.unknown_table")
        .when(add & F.col("_there").isNotNull(), "write.taken")
        .when(~add & F.col("_there").isNull(), "write.absent")
        .when(~gone & invalid, "write.invalid_value")
        .when((F.col("kind") == "edit") & (F.col("revision") >= LAST_REVISION), "write.revision_overflow")
    )
    j = j.withColumn("code", code)
    good = j.where("code is null").drop("_there", "_known", "code")
    fresh = identities.append_positions(good.where(add).drop("row_number"), rows, "table_id", "row_number", "row_guid")
    sound = good.where(~add).unionByName(fresh.select(good.columns))
    text = lambda p, t: F.struct(F.lit(p).cast("string").alias("property_path"), t.cast("string").alias("text"))
    cells = F.transform(F.map_entries(F.coalesce("cells", F.create_map().cast(edits.schema["cells"].dataType))), lambda e: F.struct(e["key"].alias("property_path"), write_cell(e["value"]["state"], e["value"]["text"]).alias("text")))
    revision = F.when(add, F.lit(0)).otherwise(F.col("revision") + 1)
    system = F.when(add, F.array(text("__guid", F.col("row_guid")), text("__rev", revision))).otherwise(F.array(text("__rev", revision)))
    patches = F.when(gone, F.array(text(None, F.lit(None)))).otherwise(F.concat(cells, system))
    out = sound.select(*by, "row_number", F.explode(patches).alias("p")).select(*by, "row_number", "p.*")
    return out, j.where("code is not null").select(*by, "code")
