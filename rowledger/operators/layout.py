"""Physical columns against the declared schema: binding, drift, projection to another layout, and canonical rewriting.

Layouts are frames with a row per column of every workbook, so all of this is joins and aggregates on schema-sized keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN = ["workbook_id", "table_id", "position"]


def _matches(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(observed's COLUMN, column_path, field_path, rule) of every way in which a column names a field: 1 by numeric
    path, 2 by property path, 3 by an alias of either side. Equality of names only, so it is one equi-join."""
    key = lambda via, rule, name: F.struct(F.lit(via).alias("via"), F.lit(rule).alias("rule"), name.alias("name"))
    keys = lambda via, rule, names: F.transform(F.coalesce(names, F.array()), lambda n: key(via, rule, n))
    path = F.col("property_path")
    seen = F.concat(F.array(key("number", 1, F.col("field_path")), key("name", 2, path), key("declared", 3, path)), keys("observed", 3, F.col("aliases")))
    known = F.concat(F.array(key("number", 1, F.col("field_path")), key("name", 2, path), key("observed", 3, path)), keys("declared", 3, F.col("aliases")))
    a = observed.select(*COLUMN, path.alias("column_path"), F.explode(seen).alias("k")).select(*COLUMN, "column_path", "k.via", "k.rule", "k.name")
    b = declared.select("table_id", "field_path", F.explode(known).alias("k")).select("table_id", "field_path", "k.via", "k.name")
    return a.join(b, ["table_id", "via", "name"]).select(*COLUMN, "column_path", "field_path", "rule")


def bind_columns(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(workbook_id, table_id, field_path, column_path, position, rule): the column that serves each field.

    observed (workbook_id, table_id, position, field_path, property_path, aliases), declared (table_id, field_path,
    property_path, aliases). The first rule that holds wins, then the first column. Null names match nothing.
    """
    best = F.min(F.struct("rule", "position", "column_path")).alias("_b")
    return _matches(observed, declared).groupBy("workbook_id", "table_id", "field_path").agg(best).select("workbook_id", "table_id", "field_path", "_b.column_path", "_b.position", "_b.rule")


def binding_findings(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(workbook_id, table_id, path, code, severity): columns that no field owns (info), fields without a column (error)."""
    matched = _matches(observed, declared)
    spare = observed.where(F.col("table_id").isNotNull()).join(matched.select(*COLUMN), COLUMN, "left_anti").select("workbook_id", "table_id", F.col("property_path").alias("path"), F.lit("column.unknown").alias("code"), F.lit(0).alias("severity"))
    tables = observed.select("workbook_id", "table_id").distinct()
    fields = tables.join(declared.select("table_id", "field_path", "property_path"), "table_id")
    missing = fields.join(matched.select("workbook_id", "table_id", "field_path"), ["workbook_id", "table_id", "field_path"], "left_anti")
    return spare.union(missing.select("workbook_id", "table_id", F.col("property_path").alias("path"), F.lit("column.missing").alias("code"), F.lit(2).alias("severity")))


def layout_drift(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(workbook_id, table_id, code, severity) of whole sheets; nothing is written.

    observed (workbook_id, table_id, schema_hash, has_metadata, key_hash) has a row per sheet, declared (table_id,
    schema_hash, key_hash, retired) one per table. Every workbook with a row is held against every live table it names.
    """
    j = observed.select("workbook_id", "table_id", "has_metadata", F.col("schema_hash").alias("_s"), F.col("key_hash").alias("_k")).join(declared.withColumn("_known", F.lit(True)), "table_id", "left")
    known, live = F.col("_known").isNotNull(), F.col("_known") & ~F.col("retired")
    found = F.array(
        F.when(~F.coalesce("has_metadata", F.lit(False)), F.struct(F.lit("metadata.missing").alias("code"), F.lit(2).alias("severity"))),
        F.when(~known, F.struct(F.lit("sheet.unknown").alias("code"), F.lit(3).alias("severity"))),
        F.when(F.col("retired"), F.struct(F.lit("sheet.retired").alias("code"), F.lit(0).alias("severity"))),
        F.when(live & F.col("has_metadata") & ~F.col("_s").eqNullSafe(F.col("schema_hash")), F.struct(F.lit("metadata.stale").alias("code"), F.lit(2).alias("severity"))),
        F.when(live & F.col("has_metadata") & ~F.col("_k").eqNullSafe(F.col("key_hash")), F.struct(F.lit("keys.stale").alias("code"), F.lit(1).alias("severity"))),
    )
    return j.select("workbook_id", "table_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("workbook_id", "table_id", "f.*")


def missing_sheets(observed: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (workbook_id, table_id) that no sheet serves."""
    return wanted.join(observed.select("workbook_id", "table_id"), ["workbook_id", "table_id"], "left_anti").withColumn("code", F.lit("sheet.missing")).withColumn("severity", F.lit(2))


def metadata_drift(observed: DataFrame) -> DataFrame:
    """(workbook_id, table_id, code, severity) of sheets whose metadata is there (has_metadata) but does not say what it has to: no hash
    of 16 hexadecimal digits, or another table's id (meta_hash, meta_table)."""
    sound = F.coalesce(F.col("meta_hash").rlike(r"^[0-9a-f]{16}\z") & (F.col("meta_table") == F.col("table_id")), F.lit(False))
    return observed.where(F.coalesce("has_metadata", F.lit(False)) & ~sound).select("workbook_id", "table_id", F.lit("metadata.invalid").alias("code"), F.lit(2).alias("severity"))


def child_drift(sheets: DataFrame, children: DataFrame) -> DataFrame:
    """(workbook_id, table_id, sheet, code, severity) of child sheets: one that a table declares (table_id, sheet) and a workbook with
    that table (sheets: workbook_id, table_id, sheet; table_id null for a child sheet) lacks is an error, and one whose table
    the workbook does not hold an info."""
    own = sheets.where("table_id is not null").select("workbook_id", "table_id").distinct()
    there = sheets.where("table_id is null").select("workbook_id", "sheet").distinct()
    wanted = own.join(children.select("table_id", "sheet").distinct(), "table_id")
    missing = wanted.join(there, ["workbook_id", "sheet"], "left_anti").select("workbook_id", "table_id", "sheet", F.lit("child_sheet.missing").alias("code"), F.lit(2).alias("severity"))
    orphans = there.join(children.select("table_id", "sheet").distinct(), "sheet").join(own, ["workbook_id", "table_id"], "left_anti")
    return missing.union(orphans.select("workbook_id", "table_id", "sheet", F.lit("child_sheet.orphan"), F.lit(0)))


def project_to_schema(cells: DataFrame, old: DataFrame, new: DataFrame, purge: bool = False) -> DataFrame:
    """cells (table_id, row_guid, property_path, text) moved from the old layout to the new one.

    old and new: (table_id, field_path, property_path). A cell goes to the new field of its property path, else to the
    one of its numeric path. Where the property path of one old field and the numeric path of another meet, the former
    wins. Fields and tables that the new schema lacks are kept as they are; `purge` drops them.
    """
    by_name = new.select("table_id", "property_path", F.lit(True).alias("_same"))
    by_number = new.select("table_id", "field_path", F.col("property_path").alias("_moved"))
    numbers = old.select("table_id", "property_path", "field_path")
    plan = numbers.join(by_name, ["table_id", "property_path"], "left").join(by_number, ["table_id", "field_path"], "left")
    plan = plan.select("table_id", "property_path", F.when(F.col("_same"), F.col("property_path")).otherwise(F.col("_moved")).alias("_to"), F.coalesce("_same", F.lit(False)).alias("_named"))
    # Of several old fields that would land on one new field the named one stays; the plan is schema-sized.
    lead = plan.where("_to is not null").groupBy("table_id", "_to").agg(F.min(F.struct(~F.col("_named"), F.col("property_path"))).alias("_l")).select("table_id", "_to", F.col("_l.property_path").alias("property_path"))
    lost = plan.where("_to is not null").join(lead, ["table_id", "_to", "property_path"], "left_anti").select("table_id", "property_path", F.lit(True).alias("_lost"))
    j = cells.join(lead, ["table_id", "property_path"], "left").join(lost, ["table_id", "property_path"], "left")
    target = F.col("_to") if purge else F.coalesce("_to", "property_path")
    return j.where(F.col("_lost").isNull()).withColumn("property_path", target).where("property_path is not null").select(cells.columns)


def normalize_plan(cells: DataFrame, canonical: Column) -> DataFrame:
    """Cells (text, formula, ...) whose stored text is not its canonical one (null: unreadable), with `patch`, the text
    to write. Formulas, blank and unreadable cells stay."""
    plain = (F.coalesce(F.col("formula"), F.lit("")) == "") & (F.coalesce(F.col("text"), F.lit("")) != "")
    return cells.withColumn("patch", canonical).where(plain & F.col("patch").isNotNull() & (F.col("patch") != F.col("text")))


def flatten_struct(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """Fields of a struct column as columns column.field, in the order of the struct."""
    fields = rows.schema[column].dataType.names
    return rows.select(*keep, *[F.col(column)[f].alias(f"{column}.{f}") for f in fields])


def assemble_struct(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """The inverse: columns named column.field as one struct, null where all of them are."""
    names = [c for c in rows.columns if c.startswith(f"{column}.")]
    parts = [F.col(f"`{c}`").alias(c[len(column) + 1 :]) for c in names]
    return rows.select(*keep, F.when(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in names]), F.struct(*parts)).alias(column))


def capture_values(typed: DataFrame, base: DataFrame, identity: str, values: dict[str, Column]) -> DataFrame:
    """(identity, property_path, state, text): typed columns back to canonical states.

    values: property path to the text of the typed value (null: none). base (identity, property_path, state, text): a
    null keeps a Missing or Null base, a value equal to a Defaulted base stays Defaulted; else Null or Value.
    """
    entries = F.array(*[F.struct(F.lit(p).alias("property_path"), v.cast("string").alias("_v")) for p, v in values.items()])
    long = typed.select(identity, F.explode(entries).alias("e")).select(identity, "e.*")
    j = long.join(base.select(identity, "property_path", F.col("state").alias("_s"), F.col("text").alias("_t")), [identity, "property_path"], "left")
    v, s = F.col("_v"), F.col("_s")
    state = F.when(v.isNull() & s.isin("Missing", "Null"), s).when(v.isNull(), "Null").when((s == "Defaulted") & (F.col("_t") == v), s).otherwise("Value")
    return j.select(identity, "property_path", state.alias("state"), v.alias("text"))
