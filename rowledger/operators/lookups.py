"""Batch lookups and listings over live rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """wanted (by, ...) with the columns of the live row that it names, and exists; `by` identifies a row."""
    return wanted.join(rows.withColumn("exists", F.lit(True)), list(by), "left").withColumn("exists", F.col("exists").isNotNull())


def containers(rows: DataFrame) -> DataFrame:
    """(path) of the workbooks and workbook tables that hold rows (path = workbook/table/key)."""
    return rows.select(F.explode(F.array(F.substring_index("path", "/", 1), F.substring_index("path", "/", 2))).alias("path")).distinct()


def table_rows(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows of a table in order, with the full number of rows and whether the list is cut."""
    total = rows.count()
    return rows.orderBy(*order).limit(limit).withColumn("total", F.lit(total).cast("bigint")).withColumn("status", F.lit("Truncated" if total > limit else "Complete"))


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the row that comes first; an aggregate, so that a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*").select(rows.columns)


def guids_in_tables(known: DataFrame) -> DataFrame:
    """(row_guid, tables, n) of guids that more than one table owns."""
    return known.groupBy("row_guid").agg(F.count_distinct("table_id").alias("tables"), F.count("*").alias("n")).where("tables > 1")


def dependency_sets(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, deps): a row's distinct dependencies in order; the set is the row's own value."""
    return edges.select(src, dst).distinct().groupBy(src).agg(F.array_sort(F.collect_list(dst)).alias("deps"))


def order_identity(rows: DataFrame) -> DataFrame:
    """By table, then identity; a range sort, for output only."""
    return rows.orderBy("table_id", "row_guid")
