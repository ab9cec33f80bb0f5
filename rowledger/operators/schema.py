"""Schema catalogs as data: lint, differences between versions, gates and reserved ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.operators import drafts
from rowledger.operators.tasks import shared_out

# Severities by number.
SAFE, WARNING, ERROR, BLOCKER = 0, 1, 2, 3


def lint_fields(fields: DataFrame) -> DataFrame:
    """(table_id, field_id, rule) of fields (table_id, field_id, name, type, shape, key_order, targets, table_targets)."""
    rules = {
        "field.id": F.col("field_id") <= 0,
        "key.shape": F.col("key_order").isNotNull() & (F.col("shape") != "scalar"),
        "target.grammar": F.exists("targets", lambda t: ~t.rlike("^[a-z][a-z0-9-]*$")),
        "target.repeated": F.size(F.array_distinct("targets")) < F.size("targets"),
        "target.not_in_table": F.size(F.array_except("targets", "table_targets")) > 0,
        "key.not_in_all_targets": F.col("key_order").isNotNull() & (F.size(F.array_except("table_targets", "targets")) > 0),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()]), lambda r: r.isNotNull())
    one = fields.select("table_id", "field_id", F.explode(broken).alias("rule"))
    ids = fields.groupBy("table_id", "field_id").count().where("count > 1").select("table_id", "field_id", F.lit("field.duplicate").alias("rule"))
    orders = fields.where("key_order is not null").groupBy("table_id", "key_order").agg(F.count("*").alias("n"), F.min("field_id").alias("field_id")).where("n > 1").select("table_id", "field_id", F.lit("key.order_repeated").alias("rule"))
    keyless = fields.groupBy("table_id").agg(F.count("key_order").alias("n")).where("n = 0").select("table_id", F.lit(None).cast("int").alias("field_id"), F.lit("table.no_key").alias("rule"))
    return one.union(ids).union(orders).union(keyless)


def diff_fields(prev: DataFrame, current: DataFrame) -> DataFrame:
    """(table_id, field_id, change, severity) by numeric id; fields: table_id, field_id, name, type, required, has_default,
    reserved (a removed field's number is set aside in current)."""
    a = prev.where("not reserved").select("table_id", "field_id", F.col("name").alias("pn"), F.col("type").alias("pt"))
    b = current.select("table_id", "field_id", F.col("name").alias("nn"), F.col("type").alias("nt"), "required", "has_default", "reserved")
    j = a.join(b, ["table_id", "field_id"], "full_outer")
    live = F.col("nn").isNotNull() & ~F.coalesce("reserved", F.lit(False))
    entries = F.array(
        F.when(F.col("pn").isNull() & live, F.struct(F.lit("added").alias("change"), F.when(F.col("required") & ~F.col("has_default"), ERROR).otherwise(SAFE).alias("severity"))),
        F.when(F.col("pn").isNotNull() & ~live, F.struct(F.lit("removed").alias("change"), F.when(F.col("reserved"), WARNING).otherwise(BLOCKER).alias("severity"))),
        F.when(F.col("pn").isNotNull() & live & (F.col("pn") != F.col("nn")), F.struct(F.lit("renamed").alias("change"), F.lit(SAFE).alias("severity"))),
        F.when(F.col("pn").isNotNull() & live & (F.col("pt") != F.col("nt")), F.struct(F.lit("retyped").alias("change"), F.lit(BLOCKER).alias("severity"))),
    )
    return j.select("table_id", "field_id", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("table_id", "field_id", "e.*")


def gate(reports: DataFrame, rules: DataFrame) -> DataFrame:
    """(project, version, operation, allowed, reason): reports (project, version, severity, evidence) against a rule
    frame (operation, ceiling, needs) of a few rows."""
    sums = reports.groupBy("project", "version").agg(F.max("severity").alias("severity"), F.array_sort(F.collect_set("evidence")).alias("evidence"))
    j = sums.join(F.broadcast(rules), F.col("severity").isNotNull())
    lacking = (F.col("needs") != "") & ~F.array_contains("evidence", F.col("needs"))
    reason = F.when(F.col("severity") > F.col("ceiling"), "severity").when(lacking, "evidence")
    return j.select("project", "version", "operation", reason.isNull().alias("allowed"), reason.alias("reason"))


# What each operation asks for. Severity below which it is allowed (null: any), whether the schema's history
# must be known, the evidence that must be there, and the findings that must not be.
OPERATIONS = [
    ("schema_build", BLOCKER, False, [], []),
    ("generate_dry_run", None, False, [], []),
    ("generate_apply", BLOCKER, True, ["fresh_plan", "stable_source", "ownership", "mapping"], []),
    ("import_check", None, False, [], []),
    ("save", ERROR, False, ["stable_source", "mapping"], []),
    ("normalize", BLOCKER, False, ["fresh_plan", "stable_source", "ownership", "mapping", "legacy_unambiguous"], []),
    ("convert", ERROR, True, ["migration", "stable_source", "mapping", "parseable", "target_ready"], ["schema.outdated", "migration.pending"]),
    ("publish", ERROR, True, ["migration", "coverage", "stable_source", "mapping", "parseable", "target_ready"], ["schema.outdated", "migration.pending", "coverage.incomplete"]),
    ("runtime_open", ERROR, False, ["runtime_identity"], []),
    ("destructive_apply", BLOCKER, True, ["fresh_plan", "migration", "data_loss_confirmed", "coverage", "stable_source", "ownership", "mapping", "parseable"], ["coverage.incomplete"]),
    ("purge", BLOCKER, True, ["fresh_plan", "migration", "data_loss_confirmed", "coverage", "stable_source", "ownership", "mapping", "parseable"], ["coverage.incomplete"]),
    ("rekey", BLOCKER, True, ["fresh_plan", "migration", "coverage", "stable_source", "ownership", "mapping", "parseable"], ["coverage.incomplete"]),
    ("data_loss_migration", BLOCKER, True, ["fresh_plan", "migration", "data_loss_confirmed", "coverage", "stable_source", "ownership", "mapping", "parseable"], ["coverage.incomplete"]),
]
REPORT_FORMAT, READ_ONLY = 1, ("generate_dry_run", "import_check")
RULES = "operation string, ceiling int, history boolean, needs array<string>, bans array<string>"


def gate_operations(reports: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(project, version, operation, allowed, severity, reason) of each report and each operation.

    reports (project, version, format, history); findings (project, version, code, severity); evidence (project, version,
    flag). A report of another format allows reading only. reason: the first of format, history, severity, the lacking
    evidence in the order of the rule, and the finding that forbids it.
    """
    spark, by = reports.sparkSession, ["project", "version"]
    codes = sorted({c for *_, bans in OPERATIONS for c in bans})
    flags = sorted({f for _, _, _, needs, _ in OPERATIONS for f in needs})
    # One bool a known code or flag, so that no list grows with the findings of a report.
    found = findings.groupBy(*by).agg(F.max("severity").alias("severity"), *[F.bool_or(F.col("code") == c).alias(f"c{i}") for i, c in enumerate(codes)])
    given = evidence.groupBy(*by).agg(*[F.bool_or(F.col("flag") == f).alias(f"f{i}") for i, f in enumerate(flags)])
    j = reports.withColumnRenamed("history", "known_history").join(found, by, "left").join(given, by, "left")
    held = F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.lit(f)) for i, f in enumerate(flags)]))
    bad = F.array_compact(F.array(*[F.when(F.col(f"c{i}"), F.lit(c)) for i, c in enumerate(codes)]))
    j = j.select(*by, "format", "known_history", F.coalesce("severity", F.lit(SAFE)).alias("severity"), held.alias("held"), bad.alias("bad"))
    rules = spark.createDataFrame(OPERATIONS, RULES)  # fixed rows
    j = j.join(F.broadcast(rules), F.col("format").isNotNull() | F.col("format").isNull())
    lacking, banned = F.get(F.array_except("needs", "held"), F.lit(0)), F.get(F.array_intersect("bans", "bad"), F.lit(0))
    known = F.col("format").eqNullSafe(F.lit(REPORT_FORMAT))
    reason = (
        F.when(~known, F.when(~F.col("operation").isin(*READ_ONLY), "format"))
        .when(F.col("operation").isin(*READ_ONLY), F.lit(None))
        .when(F.col("history") & ~F.coalesce(F.col("known_history"), F.lit(False)), "history")
        .when(F.col("severity") >= F.col("ceiling"), "severity")
        .when(lacking.isNotNull(), F.concat(F.lit("evidence."), lacking))
        .when(banned.isNotNull(), banned)
    )
    return j.withColumn("reason", reason).select(*by, "operation", F.col("reason").isNull().alias("allowed"), "severity", "reason")


def diff_tables(prev: DataFrame, current: DataFrame, filled: DataFrame, complete: bool) -> DataFrame:
    """(table, change, severity) between the tables of two versions.

    Tables: table_id, full_name, name, sheet, kind (asset, embedded or retired), keys (array of field ids), targets. Assets
    and retired ones meet by table_id, embedded ones by full name. filled (table_id): tables that hold rows; complete:
    whether every workbook was seen, so that the others are known to be empty.
    """
    same_name = prev.select("full_name", F.col("kind").alias("_k")).join(current.select("full_name", "kind"), "full_name").where("kind <> _k and kind <> 'retired' and _k <> 'retired'")
    kinds = same_name.select(F.col("full_name").alias("table"), F.lit("table.kind").alias("change"), F.lit(BLOCKER).alias("severity")).distinct()
    ident = F.when(F.col("kind") == "embedded", F.concat(F.lit("n:"), "full_name")).otherwise(F.concat(F.lit("t:"), F.col("table_id").cast("string")))
    columns = ["full_name", "name", "sheet", "kind", "keys", "targets"]
    a = prev.select(ident.alias("_i"), F.col("table_id").alias("_pid"), *[F.col(c).alias(f"p_{c}") for c in columns])
    b = current.select(ident.alias("_i"), F.col("table_id").alias("_nid"), *[F.col(c).alias(f"n_{c}") for c in columns])
    j = a.join(b, "_i", "full_outer").withColumn("table_id", F.coalesce("_nid", "_pid")).join(filled.select("table_id", F.lit(True).alias("_filled")).distinct(), "table_id", "left")
    was, now = F.col("p_kind"), F.col("n_kind")
    live = (was == "asset") & (now == "asset")
    named = (F.col("p_full_name") != F.col("n_full_name")) | (live & ((F.col("p_name") != F.col("n_name")) | (F.col("p_sheet") != F.col("n_sheet"))))
    alike = live | ((was == "embedded") & (now == "embedded"))
    rekeyed = alike & ~F.col("p_keys").eqNullSafe(F.col("n_keys"))
    risky = (was == "asset") & (F.coalesce(F.col("_filled"), F.lit(False)) | F.lit(not complete))
    entry = lambda when, change, severity: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(change).alias("change"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity")))
    entries = F.array(
        entry(was.isNull() & (now == "asset"), "table.added", SAFE),
        entry(was.isin("asset", "retired") & now.isin("asset", "retired") & ~((was == "retired") & (now == "asset")) & named, "table.renamed", SAFE),
        entry((was == "asset") & (now == "retired"), "table.retired", WARNING),
        entry(was.isin("asset", "retired") & now.isNull(), "table.tombstone_missing", BLOCKER),
        entry((was == "retired") & (now == "asset"), "table.reactivated", BLOCKER),
        entry(rekeyed, "table.key", F.when(risky, BLOCKER).otherwise(SAFE)),
    )
    table = F.coalesce("n_full_name", "p_full_name").alias("table")
    one = j.select(table, F.explode(F.array_compact(entries)).alias("e")).select("table", "e.*")
    targets = j.where(alike).select(table, F.col("p_targets").alias("before"), F.col("n_targets").alias("after"))
    return kinds.union(one).union(drafts.target_changes(targets, "table").select("table", F.concat_ws(".", F.lit("table.target"), "change"), "severity"))


def diff_declared(prev: DataFrame, current: DataFrame, proven: DataFrame) -> DataFrame:
    """(table_id, field_path, change, severity) between the fields of tables that both versions have, at any depth.

    Fields: table_id, field_path (numbers joined by dots), name, signature (all that gives a value its meaning but format
    and targets), format (null: none), legacy (array), targets, required, has_default, reserved (the number is set aside
    among current's fields). proven (table_id, field_path): where evidence shows that no cell needs a legacy format.
    """
    by, columns = ["table_id", "field_path"], ["name", "signature", "format", "legacy", "targets"]
    a = prev.where("not reserved").select(*by, F.lit(True).alias("_was"), *[F.col(c).alias(f"p_{c}") for c in columns])
    b = current.select(*by, F.lit(True).alias("_is"), "required", "has_default", "reserved", *[F.col(c).alias(f"n_{c}") for c in columns])
    j = a.join(b, by, "full_outer").join(proven.select(*by, F.lit(True).alias("_proven")).distinct(), by, "left")
    live = F.col("_is").isNotNull() & ~F.coalesce("reserved", F.lit(False))
    was, none = F.col("_was").isNotNull(), F.array().cast("array<string>")
    j = j.withColumn("_live", live).withColumn("_both", was & live)
    before, after = F.coalesce("p_legacy", none), F.coalesce("n_legacy", none)
    both_formats = F.col("p_format").isNotNull() & F.col("n_format").isNotNull()
    changed = F.col("p_format") != F.col("n_format")
    kept = F.array_contains(after, F.col("p_format"))
    entry = lambda change, severity: F.struct(F.lit(change).alias("change"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    when = lambda cond, change, severity: F.when(F.coalesce(cond, F.lit(False)), entry(change, severity))
    added = F.filter(F.array_except(after, before), lambda x: ~F.coalesce(changed & (x == F.col("p_format")), F.lit(False)))
    gone = F.filter(F.array_except(before, after), lambda x: ~F.coalesce(x == F.col("n_format"), F.lit(False)))
    entries = F.array_compact(
        F.array(
            when(~was & F.col("_live"), "field.added", F.when(F.col("required") & ~F.col("has_default"), ERROR).otherwise(SAFE)),
            when(was & ~F.col("_live"), "field.removed", F.when(F.coalesce("reserved", F.lit(False)), WARNING).otherwise(BLOCKER)),
            when(F.col("_both") & (F.col("p_name") != F.col("n_name")), "field.renamed", SAFE),
            when(F.col("_both") & ~F.col("p_signature").eqNullSafe(F.col("n_signature")), "field.changed", BLOCKER),
            when(F.col("_both") & ~both_formats & ~F.col("p_format").eqNullSafe(F.col("n_format")), "format.in_place", BLOCKER),
            when(F.col("_both") & both_formats & changed & ~kept, "format.in_place", BLOCKER),
            when(F.col("_both") & both_formats & changed & kept, "format.migrating", WARNING),
        )
    )
    legacy = F.when(
        F.col("_both") & both_formats,
        F.concat(F.transform(added, lambda x: entry("format.legacy_added", SAFE)), F.transform(gone, lambda x: entry("format.legacy_removed", F.when(F.col("_proven"), SAFE).otherwise(BLOCKER)))),
    )
    one = j.select(*by, F.explode(F.concat(entries, F.coalesce(legacy, F.array().cast("array<struct<change:string,severity:int>>")))).alias("e")).select(*by, "e.*")
    targets = j.where("_both").select(*by, F.col("p_targets").alias("before"), F.col("n_targets").alias("after"))
    return one.union(drafts.target_changes(targets, *by).select(*by, F.concat_ws(".", F.lit("field.target"), "change"), "severity"))


def diff_enums(prev: DataFrame, current: DataFrame, reserved: DataFrame) -> DataFrame:
    """(enum, number, change, severity) of the values (enum, number, name) of enums that both versions have; reserved (enum,
    first, last): numbers that current sets aside."""
    both = prev.select("enum").distinct().join(current.select("enum").distinct(), "enum")
    a = prev.join(both, "enum").select("enum", "number", F.col("name").alias("_p"))
    j = a.join(current.join(both, "enum").select("enum", "number", F.col("name").alias("_n")), ["enum", "number"], "full_outer")
    gone = j.where("_n is null").select("enum", "number")
    ranges = merge_reserved(reserved.withColumnRenamed("enum", "owner")).withColumnRenamed("owner", "enum")
    held = gone.join(ranges, "enum").where("number between first and last").select("enum", "number", F.lit(True).alias("_held")).distinct()
    removed = gone.join(held, ["enum", "number"], "left").select("enum", "number", F.lit("value.removed").alias("change"), F.when(F.col("_held"), WARNING).otherwise(BLOCKER).alias("severity"))
    change = F.when(F.col("_p").isNull(), "value.added").when(F.col("_p") != F.col("_n"), "value.renamed")
    return j.where("_n is not null").select("enum", "number", change.alias("change"), F.lit(SAFE).alias("severity")).where("change is not null").union(removed)


def merge_reserved(ranges: DataFrame) -> DataFrame:
    """(owner, first, last): overlapping or touching ranges of an owner as one. Owners are shared out to as many tasks
    as the ranges ask for, so that what a task sorts stays of one size."""
    ranges = shared_out(ranges.select("owner", "first", "last"), ranges.count(), "owner")
    order = Window.partitionBy("owner").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") <= reach + 1, 0).otherwise(1)).over(order)
    return ranges.withColumn("_i", island).groupBy("owner", "_i").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_i")


# Types that a map's key may have.
MAP_KEYS = ("string", "bool", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64")


def lint_tables(tables: DataFrame) -> DataFrame:
    """(table_id, name, rule) of tables (table_id, name, kind: asset, embedded or null, retired, keys: number of key fields)."""
    asset, embedded = F.col("kind") == "asset", F.col("kind") == "embedded"
    positive = F.coalesce(F.col("table_id") > 0, F.lit(False))
    rules = {
        "table.id": asset & ~F.col("retired") & ~positive,
        "table.kind": ~F.coalesce(asset | embedded, F.lit(False)),
        "embedded.id_or_key": embedded & (F.col("table_id").isNotNull() | (F.col("keys") > 0)),
        "retired.shape": F.col("retired") & ~(F.coalesce(asset, F.lit(False)) & positive),
    }
    one = tables.select("table_id", "name", _broken(rules))
    twice = tables.where(F.col("table_id") > 0).groupBy("table_id").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1")
    return one.union(twice.select("table_id", "name", F.lit("table.duplicate")))


def lint_declarations(fields: DataFrame) -> DataFrame:
    """(table_id, field_id, rule) of what fields declare, each by its own row.

    fields: shape (scalar, struct, list, structs or map), type, map_key, expand, child_table, labels, oneof, separators
    and legacy (arrays, null: none), format (text of the canonical one), ref_table, ref_group, is_ref.
    """
    shape, separators = F.col("shape"), F.col("separators")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    targets = F.col("ref_table").isNotNull().cast("int") + F.col("ref_group").isNotNull().cast("int")
    # One separator inside another: more than the separator itself contains it.
    nested = F.exists(separators, lambda s: F.size(F.filter(separators, lambda o: o.contains(s))) > 1)
    rules = {
        "expand.shape": on("expand") & (shape != "struct"),
        "child_table.shape": on("child_table") & ((shape != "structs") | separators.isNotNull()),
        "labels.shape": on("labels") & ~((shape == "list") & (F.col("type") == "string")),
        "oneof.shape": F.col("oneof").isNotNull() & shape.isin("list", "structs", "map"),
        "map.key": (shape == "map") & ~F.coalesce(F.col("map_key").isin(*MAP_KEYS), F.lit(False)),
        "ref.target": F.when(on("is_ref"), targets != 1).otherwise(targets > 0),
        "format.separators": F.exists(separators, lambda s: (s == "") | s.contains('"')) | nested,
        "format.layers": separators.isNotNull() & ((shape == "scalar") | (F.size(separators) > 2) | ((shape == "list") & (F.size(separators) > 1))),
        "legacy.repeated": F.size(F.array_distinct("legacy")) < F.size("legacy"),
        "legacy.canonical": F.array_contains("legacy", F.col("format")),
    }
    return fields.select("table_id", "field_id", _broken(rules))


def lint_references(fields: DataFrame, tables: DataFrame, members: DataFrame) -> DataFrame:
    """(table_id, field_id, rule): declared targets (ref_table) that are no live asset or ambiguous, groups (ref_group)
    without members. tables (table_id, kind, retired), members (ref_group, table_id)."""
    by = tables.groupBy(F.col("table_id").alias("ref_table")).agg(F.count_if((F.col("kind") == "asset") & ~F.col("retired")).alias("_live"), F.count("*").alias("_n"))
    groups = members.select("ref_group", F.lit(True).alias("_g")).distinct()
    j = fields.join(by, "ref_table", "left").join(groups, "ref_group", "left")
    rules = {
        "ref.unknown": F.col("ref_table").isNotNull() & (F.coalesce("_live", F.lit(0)) == 0),
        "ref.ambiguous": F.col("_n") > 1,
        "ref.empty_group": F.col("ref_group").isNotNull() & F.col("_g").isNull(),
    }
    return j.select("table_id", "field_id", _broken(rules))


def lint_enums(values: DataFrame, reserved: DataFrame) -> DataFrame:
    """(enum, number, rule): enums without zero, numbers that repeat or lie in a reserved range (enum, first, last)."""
    sums = values.groupBy("enum").agg(F.count_if(F.col("number") == 0).alias("z"))
    none = sums.where("z = 0").select("enum", F.lit(None).cast("int").alias("number"), F.lit("enum.no_zero").alias("rule"))
    twice = values.groupBy("enum", "number").count().where("count > 1").select("enum", "number", F.lit("enum.duplicate"))
    held = values.join(merge_reserved(reserved.withColumnRenamed("enum", "owner")).withColumnRenamed("owner", "enum"), "enum").where("number between first and last")
    return none.union(twice).union(held.select("enum", "number", F.lit("enum.reserved")).distinct())


def _broken(rules: dict[str, Column]) -> Column:
    return F.explode(F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()]), lambda r: r.isNotNull())).alias("rule")
