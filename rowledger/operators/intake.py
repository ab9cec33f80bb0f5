"""From staging rows of workbooks to typed rows: values, keys, revisions and findings of every declared table in one pass.

What parse_table gives holds a row's values and findings as arrays, so that a table is read once; rows_of, values_of and
findings_of are its views. A staging folder that is written by sheet is read by each table for its own sheet only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.catalog import Catalog, Table
from rowledger.functions.cells import apart, build_key, parse_columns, parse_revision, valid_guid
from rowledger.operators import checks, identity, project, references
from rowledger.operators.checks import check_oneof
from rowledger.operators.tasks import shared_out
from rowledger.registry import Format, Registry

ERROR, BLOCKER = 2, 3
#: Kinds of repeats that one number tells apart.
BITS = 62


def parse_table(staging: DataFrame, table: Table, formats: dict[str, Format] | None = None, incomplete: DataFrame | None = None) -> DataFrame:
    """(table_id, path, sheet, row_number, row_guid, revision, key, indexable, values, findings) of one table's rows.

    staging: as read_workbooks gives it. A field reads the cell of its name, else of the first alias that is there.
    incomplete (path, sheet): sheets that lack an owned column. A row is indexable if no cell, revision or key has an
    error, its guid is sound, and its sheet is complete.
    """
    rows = staging.where(F.col("sheet") == table.sheet).select("path", "sheet", "row_number", "raw_guid", "raw_revision", "cells")
    at = lambda f: F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in (f.name, *f.aliases)])
    rows = rows.select("*", *[at(f).alias(f"cell{i}") for i, f in enumerate(table.fields)])
    parsed = parse_columns(rows, {f"value{i}": (F.col(f"cell{i}.text"), F.col(f"cell{i}.formula"), f) for i, f in enumerate(table.fields)}, formats)
    place = {f.field_id: i for i, f in enumerate(table.fields)}
    key = build_key(*[(f.name, F.col(f"value{place[f.field_id]}")) for f in table.keys()])
    parsed = parsed.withColumn("made", key).withColumn("rev", parse_revision(F.col("raw_revision")))
    finding = lambda path, code, severity: F.struct(F.lit(path).cast("string").alias("property_path") if path is None or isinstance(path, str) else path.alias("property_path"), code.alias("code"), F.lit(severity).alias("severity"))
    found = [F.when(F.col(f"value{i}.error").isNotNull(), finding(f.name, F.col(f"value{i}.error"), ERROR)) for i, f in enumerate(table.fields)]
    found.append(F.when(F.col("rev").isNull(), finding("__rev", F.lit("row.revision"), BLOCKER)))
    found.append(F.when(F.col("made.error").isNotNull(), finding(F.col("made.field"), F.col("made.error"), ERROR)))
    names = ("state", "text", "raw_state", "raw_text", "legacy")
    values = F.array(*[F.struct(F.lit(f.name).alias("property_path"), F.lit(f.field_id).alias("field_id"), *[F.col(f"value{i}.{n}").alias(n) for n in names]) for i, f in enumerate(table.fields)])
    parsed = parsed.withColumns(apart({"findings": F.array_compact(F.array(*found)), "values": values}))
    whole = F.lit(True)
    if incomplete is not None:
        # A row a sheet is sent to the rows, as those of a few large sheets would all go to a few tasks.
        parsed = parsed.join(F.broadcast(incomplete.select("path", "sheet", F.lit(True).alias("lacks")).distinct()), ["path", "sheet"], "left")
        whole = F.col("lacks").isNull()
    sound = (F.coalesce("raw_guid", F.lit("")) == "") | valid_guid(F.col("raw_guid"))
    guid = F.when(valid_guid(F.col("raw_guid")), F.col("raw_guid"))
    return parsed.select(F.lit(table.table_id).alias("table_id"), "path", "sheet", "row_number", guid.alias("row_guid"), F.col("rev").alias("revision"), F.col("made.key").alias("key"), (whole & sound & (F.size("findings") == 0)).alias("indexable"), "values", "findings")


def parse_tables(staging: DataFrame, catalog: Catalog, formats: dict[str, Format] | None = None, incomplete: DataFrame | None = None) -> DataFrame:
    """parse_table of every live table of the catalog; each reads staging for its sheet. See routed."""
    return reduce(DataFrame.union, [parse_table(staging, t, formats, incomplete) for t in catalog.live()])


def routed(staging: DataFrame, catalog: Catalog, folder: str) -> DataFrame:
    """staging, each row written once to the part of its sheet: what made it (unzipping workbooks) runs once, and of a catalog of any
    number of tables each one then reads its own part alone. Sheets of no live table are left out."""
    rows = staging.where(F.col("sheet").isin([t.sheet for t in catalog.live()]))
    # A task has rows of few sheets and a sheet of many rows keeps many files.
    rows.write.mode("error").partitionBy("sheet").parquet(folder)
    back = staging.sparkSession.read.schema(staging.schema).parquet(folder)
    return back.select(staging.columns)


def with_indexable(parsed: DataFrame, catalog: Catalog, validators: Registry | None = None, child_findings: DataFrame | None = None) -> DataFrame:
    """parsed (of parse_tables) with all that makes a row unfit in its findings, and indexable false for it.

    Added are identities (row.duplicate) and keys (key.duplicate) that another row of the table has, of the whole group; texts that
    repeat in a field declared unique (field.duplicate, by its path); groups of which more than one field is set, by the
    raw side (oneof.<name>); registered validators that fail over cells map<path, text> (validator.<name>), or lack registration; and
    child_findings (path, sheet, row_number, code) of a row's children. Repeats are counted over the rows of all workbooks by
    (table, what, text), in tasks of bounded size; texts that very many rows have are found in a sample before, so that none gathers
    its rows. What a row has in common with others comes back to it as a bit for each kind of repeat, and what it lacks by itself is
    found on the row, so that the values are neither copied into maps nor taken apart. catalog is the one that parse_tables had.
    """
    # What tells most rows apart comes first, also in the joins: Spark sorts by eight bytes of the first column and compares rows only where
    # they are equal.
    at = ["row_number", "path", "sheet", "table_id"]
    none, error = F.lit(None).cast("string"), F.lit(ERROR)
    finding = lambda path, code, severity=error: F.struct(path.alias("property_path"), code.alias("code"), severity.alias("severity"))
    of = lambda ids: F.col("table_id").isin(ids) if ids else F.lit(False)
    live = catalog.live()

    def held(name: str) -> Column:
        """The value of a field, taken where the catalog has it: a search by a lambda would keep a pass out of generated code."""
        tables, found = [t for t in live if any(f.name == name for f in t.fields)], F
        for i in dict.fromkeys(i for t in tables for i, f in enumerate(t.fields) if f.name == name):
            found = found.when(F.get("values", F.lit(i))["property_path"] == name, F.get("values", F.lit(i)))
        return F.when(of([t.table_id for t in tables]), found.otherwise(F.raise_error(F.lit(f"{name} is not where the catalog has it"))))

    unique = {f.name: [t.table_id for t in live if any(x.name == f.name and x.unique for x in t.fields)] for t in live for f in t.fields if f.unique}
    kinds = [("row.duplicate", none, F.col("row_guid")), ("key.duplicate", none, F.col("key"))]
    kinds += [("field.duplicate", F.lit(name), F.when(of(tables) & held(name)["state"].isin("Value", "Defaulted"), held(name)["text"])) for name, tables in unique.items()]
    marks = F.array(*[F.struct(F.lit(i).alias("what"), text.alias("text")) for i, (_, _, text) in enumerate(kinds)])
    long = parsed.select(*at, F.explode(marks).alias("m")).select(*at, "m.*").where("text is not null")
    repeats, rows = checks.repeated_rows(long, ["text", "what", "table_id"], at)
    bits = {f"_bits{w}": F.bit_or(F.when(F.floor(F.col("what") / BITS) == w, F.expr(f"shiftleft(1L, what % {BITS})"))) for w in range(-(-len(kinds) // BITS))}
    more = shared_out(repeats, rows, *at).groupBy(*at).agg(*[c.alias(n) for n, c in bits.items()])

    own, rules = [], validators or Registry()
    for t in live:
        for group in dict.fromkeys(f.oneof for f in t.fields if f.oneof):
            raw = [held(f.name)["raw_state"] for f in t.fields if f.oneof == group]
            own.append(F.when(of([t.table_id]) & check_oneof(*[~x.isin("Missing", "Null") for x in raw]), finding(F.lit(group), F.lit(f"oneof.{group}"))))
        for name in t.validators:
            rule = rules.get(name)
            fails = of([t.table_id]) & ~F.coalesce(rule(), F.lit(False)) if rule else of([t.table_id])
            own.append(F.when(fails, finding(none, F.lit(f"validator.{name}" if rule else f"validator.unregistered.{name}"))))
    rows = parsed
    if any(rules.get(name) for t in live for name in t.validators):
        rows = rows.withColumn("cells", F.map_from_entries(F.transform("values", lambda v: F.struct(v["property_path"], v["text"]))))
    rows = rows.select(*parsed.columns, F.array(*own).alias("_own")) if own else rows
    rows = rows.join(more, at, "left")
    shared = [F.when(F.expr(f"_bits{i // BITS} & shiftleft(1L, {i % BITS})") != 0, finding(path, F.lit(code))) for i, (code, path, _) in enumerate(kinds)]
    found = [F.array(*shared), *([F.col("_own")] if own else [])]
    if child_findings is not None:
        known = parsed.select(*at).join(child_findings.select("path", "sheet", "row_number", "code"), ["path", "sheet", "row_number"])
        rows = rows.join(known.groupBy(*at).agg(F.collect_list(finding(none, F.col("code"))).alias("_children")), at, "left")
        found.append(F.coalesce("_children", F.array().cast(parsed.schema["findings"].dataType)))
    rows = rows.withColumn("_more", F.array_sort(F.array_compact(F.concat(*found))))
    return rows.select(*[c for c in parsed.columns if c not in ("indexable", "findings")], (F.col("indexable") & (F.size("_more") == 0)).alias("indexable"), F.concat("findings", "_more").alias("findings"))


def rows_of(parsed: DataFrame) -> DataFrame:
    return parsed.drop("values", "findings")


def values_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("table_id", "path", "row_number", "row_guid", F.explode("values").alias("v")).select("table_id", "path", "row_number", "row_guid", "v.*")


def findings_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("table_id", "path", "sheet", "row_number", F.explode("findings").alias("f")).select("table_id", "path", "sheet", "row_number", "f.*")


def concat_workbooks(frames: list[DataFrame]) -> DataFrame:
    """The rows of all workbooks; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def data_facts(parsed: DataFrame, layout: DataFrame, workbooks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts per workbook, tables with rows) of what intake found, for the comparison of schemas.

    parsed: of parse_tables; layout (path, code): findings of the binding of columns and sheets; workbooks (path, revision,
    schema_hash): all that were to be read. Pending are rows without identity; legacy_hits are cells that only a former
    format read, and legacy_errors cells with an error.
    """
    count = lambda f: F.size(F.filter("values", f)).cast("bigint")
    sums = parsed.groupBy("path").agg(
        F.sum(count(lambda v: v["state"] == "Invalid")).alias("unparseable"),
        F.count_if(F.col("row_guid").isNull()).alias("pending"),
        F.sum(count(lambda v: F.coalesce(v["legacy"], F.lit(False)))).alias("legacy_hits"),
        F.sum(F.size(F.filter("findings", lambda f: f["code"].startswith("cell."))).cast("bigint")).alias("legacy_errors"),
    )
    broken = layout.where(F.col("code").isin("column.missing", "sheet.unknown", "metadata.stale", "metadata.missing")).select("path", F.lit(False).alias("_ok")).distinct()
    zero = F.lit(0).cast("bigint")
    facts = workbooks.join(sums, "path", "left").join(broken, "path", "left")
    facts = facts.select(F.col("path").alias("workbook_id"), "revision", "schema_hash", F.coalesce("_ok", F.lit(True)).alias("mapping_complete"), *[F.coalesce(c, zero).alias(c) for c in ("unparseable", "pending", "legacy_hits", "legacy_errors")])
    return facts, parsed.select("table_id").distinct()


def run_checks(workbooks: DataFrame, staging: DataFrame, parsed: DataFrame, known: DataFrame, catalog: Catalog) -> DataFrame:
    """(step, workbook_id, code, severity, n) of a whole project, step by step: sources, identities, cells, keys, references.

    workbooks (path, workbook_id): all that were to be read; staging: their rows; parsed: of parse_tables over them; known
    (table_id, row_guid, key): identities of the last state. Rows of a workbook that sources refuse are left out of the steps
    behind. A summary is checks.summarize over it, and what is empty may be published.
    """
    good, refused = project.check_sources(workbooks)
    kept = parsed.join(good.select("path", "workbook_id"), "path")
    place = ["path", "sheet", "row_number"]
    rows = kept.join(staging.select(*place, "raw_guid"), place)
    scanned = identity.scan(rows.select(F.struct("workbook_id", *place).alias("row_no"), "table_id", "raw_guid", "key"), known)
    # The rows that project.duplicate_keys_across gives, in tasks of bounded size.
    twice, _ = checks.repeated_rows(kept.where("table_id is not null and key is not null").select(*place, "workbook_id", "table_id", "key"), ["key", "table_id"], place)
    steps = [
        refused.select(F.lit("sources").alias("step"), "workbook_id", "code", "severity"),
        scanned.where("severity > 0").select(F.lit("identities"), F.col("row_no.workbook_id"), F.concat(F.lit("identity."), F.lower("status")), "severity"),
        kept.select("workbook_id", F.explode("findings").alias("f")).select(F.lit("cells"), "workbook_id", "f.code", "f.severity"),
        twice.select(F.lit("keys"), "workbook_id", F.lit("key.duplicate"), F.lit(ERROR)),
    ]
    fields = [(t.table_id, f.name, f.ref_table) for t in catalog.live() for f in t.fields if f.ref_table is not None]
    if fields:
        spark = parsed.sparkSession
        declared = spark.createDataFrame(fields, "table_id int, property_path string, to int").withColumn("field", F.concat_ws(".", F.col("table_id").cast("string"), "property_path"))
        cells = kept.select("workbook_id", "table_id", "row_guid", F.explode("values").alias("v")).select("workbook_id", "table_id", "row_guid", "v.property_path", "v.state", F.col("v.text").alias("token"))
        tokens = cells.where("state in ('Value', 'Defaulted')").join(F.broadcast(declared), ["table_id", "property_path"])
        targets = kept.where("indexable and row_guid is not null and key is not null").select("table_id", "key", "row_guid")
        resolved = references.resolve_tokens(tokens.drop("table_id", "to", "state"), targets, declared.select("field", F.col("to").alias("table_id")))
        steps.append(resolved.where("error is not null").select(F.lit("references"), "workbook_id", "error", F.lit(BLOCKER)))
    return reduce(DataFrame.union, steps).groupBy("step", "workbook_id", "code", "severity").agg(F.count("*").alias("n"))
