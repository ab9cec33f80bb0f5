"""How many tasks share the rows of a step out."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task sorts or aggregates, on average.
TASK_ROWS = 250_000


def shared_out(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df by a hash of `by` in as many partitions as give each one TASK_ROWS of its `rows`. Spark leaves a number that is given as it is, so
    what a task holds of a sort, a window or a hash table stays of one size however many rows come; without it the rows go to
    a fixed number of partitions and each task's share grows with the input."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *by)
