"""Checks over a whole project: sources, row rules, keys across workbooks, evidence of compatibility, and reports.

Groups are counted and met again by a join, so that a key with a third of all rows never becomes one list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.functions.cells import valid_guid
from rowledger.operators.checks import diagnostics, repeated, summarize
from rowledger.registry import Registry


def check_sources(workbooks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """workbooks (path, workbook_id) as (those to read, findings): a path counts once in any case, the first spelling
    stays; of workbooks with one id the first path stays, later ones are blockers."""
    path = F.lower("path")
    once = workbooks.where("path is not null").groupBy(path.alias("_p")).agg(F.min(F.struct("path", "workbook_id")).alias("w")).select("_p", "w.*")
    first = once.where("workbook_id is not null").groupBy("workbook_id").agg(F.min("_p").alias("_first"))
    j = once.join(first, "workbook_id", "left")
    late = F.coalesce(F.col("_p") != F.col("_first"), F.lit(False))
    return j.where(~late).select("path", "workbook_id"), j.where(late).select("path", "workbook_id", F.lit("workbook.duplicate").alias("code"), F.lit(3).alias("severity"))


def drop_retired(rows: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (table_id, ...) of live tables, and one finding per other table: retired (info) or unknown (blocker).

    tables (table_id, retired) is unique in table_id."""
    j = rows.join(tables.select("table_id", F.col("retired").alias("_r")), "table_id", "left")
    other = j.where("_r or _r is null").groupBy("table_id").agg(F.first("_r").alias("_r"), F.count("*").alias("n"))
    found = other.select("table_id", F.when(F.col("_r"), "table.retired").otherwise("table.unknown").alias("code"), F.when(F.col("_r"), 0).otherwise(3).alias("severity"), "n")
    return j.where("not _r").drop("_r"), found


def validate_rows(rows: DataFrame, table_validators: dict[int, list[str]], registry: Registry, *keys: str) -> DataFrame:
    """(keys, code, severity) of the registered row rules of each table that fail; a rule without registration is an error
    of every row of its table. Rows with a finding are not indexable."""
    of = lambda v: F.col("table_id").isin([t for t, vs in table_validators.items() if v in vs])
    rules = {}
    for v in dict.fromkeys(v for vs in table_validators.values() for v in vs):
        known = registry.get(v)
        rules[v if known else f"validator.unregistered.{v}"] = (2, of(v) & ~F.coalesce(known(), F.lit(False)) if known else of(v))
    return diagnostics(rows, rules, *keys)


def duplicate_keys_across(rows: DataFrame) -> DataFrame:
    """(table_id, key, workbook_id, row_number, n, workbooks) of every row whose (table_id, key) another row of the project has."""
    same = rows.where("table_id is not null and key is not null").groupBy("table_id", "key").agg(F.count("*").alias("n"), F.count_distinct("workbook_id").alias("workbooks")).where("n > 1")
    return rows.join(same, ["table_id", "key"]).select("table_id", "key", "workbook_id", "row_number", "n", "workbooks")


def workbook_summary(rows: DataFrame, workbooks: DataFrame, expected: str) -> DataFrame:
    """(workbook_id, tables, n_rows, schema_hash, current) of all workbooks (workbook_id, schema_hash), without rows too."""
    sums = rows.groupBy("workbook_id").agg(F.count_distinct("table_id").alias("tables"), F.count("*").alias("n_rows"))
    zero = F.lit(0).cast("bigint")
    return workbooks.join(sums, "workbook_id", "left").select("workbook_id", F.coalesce("tables", zero).alias("tables"), F.coalesce("n_rows", zero).alias("n_rows"), "schema_hash", F.col("schema_hash").eqNullSafe(F.lit(expected)).alias("current"))


def duplicate_fields(records: DataFrame) -> DataFrame:
    """(table_id, row_guid, field, n) of fields that repeat inside a row of long records."""
    return repeated(records, "table_id", "row_guid", "field")


def target_list(tables: DataFrame) -> DataFrame:
    """(target): distinct export targets of tables with an array `targets`."""
    return tables.select(F.explode("targets").alias("target")).where("target is not null").distinct()


def fact_findings(facts: DataFrame, current: str, previous: str | None, complete: bool = True) -> DataFrame:
    """(workbook_id, code, severity) of facts (workbook_id, revision, schema_hash, mapping_complete, ownership_safe,
    unparseable, pending, legacy_hits, legacy_errors)."""
    counts = [F.col(c) for c in ("unparseable", "pending", "legacy_hits", "legacy_errors")]
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    old = F.col("schema_hash").eqNullSafe(F.lit(previous)) & F.lit(previous is not None)
    stale = ~F.col("schema_hash").eqNullSafe(F.lit(current))
    errors = F.col("legacy_errors") > 0
    rules = {
        "evidence.invalid": (3, blank("workbook_id") | blank("revision") | reduce(lambda a, b: a | b, [c < 0 for c in counts])),
        "schema.outdated": (1, stale & old),
        "schema.drift": (2, stale & ~old),
        "mapping.invalid": (3, ~F.col("mapping_complete")),
        "ownership.conflict": (3, ~F.col("ownership_safe")),
        "data.unparseable": (2, F.col("unparseable") > 0),
        "migration.pending": (2, F.col("pending") > 0),
        "legacy.errors": (2, errors),
        "legacy.hits": (1, ~errors & (F.col("legacy_hits") > 0)),
    }
    twice = repeated(facts, "workbook_id").select("workbook_id", F.lit("evidence.duplicate").alias("code"), F.lit(3).alias("severity"))
    found = diagnostics(facts, rules, "workbook_id").union(twice)
    if complete:
        return found
    cover = facts.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(None).cast("string").alias("workbook_id"), F.lit("coverage.incomplete").alias("code"), F.lit(1).alias("severity"))
    return found.union(cover)


def legacy_removal_proof(facts: DataFrame, evidence: DataFrame, revisions: DataFrame, expected: str, complete: bool) -> DataFrame:
    """(format, safe): a legacy format may go only with one evidence row at the expected schema without hits or errors,
    complete coverage, and the revision of every workbook seen.

    facts (workbook_id, revision); evidence (format, schema_hash, hits, errors); revisions (format, workbook_id, revision):
    what the evidence of a format has seen, a row a workbook.
    """
    known = facts.agg(F.count("*").alias("_all"), F.count_distinct("workbook_id").alias("_ids"), F.lit(1).alias("_one"))
    by = ["workbook_id", "revision"]
    seen = revisions.join(facts.select(*by, F.lit(1).alias("_same")).distinct(), by, "left").groupBy("format").agg(F.count("*").alias("_listed"), F.count("_same").alias("_agreed"), F.count_distinct("workbook_id").alias("_books"))
    one = evidence.groupBy("format").agg(F.count("*").alias("_n"), F.max("schema_hash").alias("_s"), F.max(F.greatest("hits", "errors")).alias("_bad"))
    j = one.join(seen, "format", "left").withColumn("_one", F.lit(1)).join(F.broadcast(known), "_one")
    whole = (F.col("_listed") == F.col("_all")) & (F.col("_agreed") == F.col("_all")) & (F.col("_books") == F.col("_all")) & (F.col("_ids") == F.col("_all"))
    safe = (F.col("_n") == 1) & F.lit(complete) & (F.col("_s") == expected) & (F.col("_bad") == 0) & (whole | (F.col("_all") == 0))
    return j.select("format", F.coalesce(safe, F.lit(False)).alias("safe"))


def check_project(findings: list[DataFrame], *by: str) -> DataFrame:
    """One report over findings (by, code, severity) of all checks; equal findings count once."""
    every = reduce(DataFrame.unionByName, [f.select(*by, "code", "severity") for f in findings])
    return summarize(every.distinct(), *by)


def order_diagnostics(found: DataFrame, *location: str) -> DataFrame:
    """Distinct findings, the worst first; sorting is for output only."""
    return found.distinct().orderBy(F.desc("severity"), "code", *location)


def recent_reports(reports: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The latest n reports; Spark keeps n rows a task, so that nothing is sorted whole."""
    return reports.orderBy(*[F.desc(c) for c in order]).limit(n)


def append_report(report: DataFrame, path: str, operation: str) -> None:
    """Keep the latest report of an operation: its partition alone is overwritten."""
    report.withColumn("operation", F.lit(operation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("operation").parquet(path)


def pending_count(rows: DataFrame) -> DataFrame:
    """(workbook_id, pending): rows without a sound identity, which forbid publication."""
    return rows.groupBy("workbook_id").agg(F.count_if(~valid_guid(F.col("row_guid"))).alias("pending"))
