"""Checks over rows: duplicates, row rules, reports. No group is collected: counts meet their rows again by a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.operators.tasks import shared_out

#: One row in so many is a sample for hot groups, which so many rows of the sample have.
SAMPLED, HOT = 256, 16


def repeated(rows: DataFrame, *by: str) -> DataFrame:
    """Groups of `by` (null in none of them) that more than one row has, with their number n."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])).groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def without_repeated(rows: DataFrame, *by: str) -> DataFrame:
    """Rows whose group is unique: of a repeated identity or key no row survives."""
    return rows.join(repeated(rows, *by).drop("n"), list(by), "left_anti")


def repeated_rows(rows: DataFrame, by: list[str], at: list[str]) -> tuple[DataFrame, int]:
    """(rows whose group of `by`, null in none of them, another row has too; about how many rows there are). `at` tells most rows apart.

    A group that is often met in a sample repeats, without being counted: its rows are told where they stand. What is left has no hot
    group, so that it is dealt out once, to tasks of bounded size, and counted where it lies.
    """
    same = ["_h", *by]  # Spark sorts by eight bytes of the first column, and compares rows only where they are equal
    hashed = rows.withColumn("_h", F.xxhash64(*by))
    sample = hashed.where(F.pmod(F.xxhash64(*at), F.lit(SAMPLED)) == 0).groupBy(*same).agg(F.count("*").alias("n")).checkpoint()
    n = SAMPLED * (sample.agg(F.sum("n")).first()[0] or 0)
    told = hashed.join(F.broadcast(sample.where(F.col("n") >= HOT).select(*same, F.lit(True).alias("_hot"))), same, "left")
    dealt = shared_out(told.where("_hot is null").select(*rows.columns, "_h"), n, *same)
    counted = dealt.withColumn("_n", F.count("*").over(Window.partitionBy(*same)))
    return counted.where("_n > 1").select(*rows.columns).union(told.where("_hot").select(*rows.columns)), n


def duplicate_unique(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(property_path, text, n) of texts that repeat in fields declared unique, in one pass over the rows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("property_path"), F.col(f).cast("string").alias("text")) for f in fields])).alias("v")).select("v.*")
    return repeated(long, "property_path", "text")


def check_oneof(*set_states: Column) -> Column:
    """True where more than one variant is set."""
    return reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(False)).cast("int") for s in set_states]) > 1


def diagnostics(rows: DataFrame, rules: dict[str, tuple[int, Column]], *keys: str) -> DataFrame:
    """(keys, code, severity) of every rule (severity, failing condition) that a row breaks; one pass, no self-union."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, bad) in rules.items()])
    return rows.select(*keys, F.explode(F.filter(found, lambda d: d.isNotNull())).alias("d")).select(*keys, "d.*")


def summarize(found: DataFrame, *by: str) -> DataFrame:
    """Exit code: the greatest severity, and how many findings of each one there are."""
    return found.groupBy(*by).agg(F.max("severity").alias("exit_code"), *[F.count_if(F.col("severity") == i).alias(n) for i, n in enumerate(("infos", "warnings", "errors", "blockers"))])
