"""Three-way merge of edits, by identity and field, and its resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_way_merge(base: DataFrame, theirs: DataFrame, mine: DataFrame, identity: str, values: list[str]) -> DataFrame:
    """One row per identity of any version: kept (theirs, mine, merged or gone), conflict (null, ConcurrentAdd,
    DeleteModify or Field), the merged values (theirs where a field is in conflict), conflicts: the fields in conflict.

    mine is the whole edited version; a row of base that it lacks is deleted by it. The key is a field like any other.
    """
    j = base.select(F.col(identity), F.struct(*values).alias("b"))
    j = j.join(theirs.select(F.col(identity), F.struct(*values).alias("t")), identity, "full_outer")
    j = j.join(mine.select(F.col(identity), F.struct(*values).alias("m")), identity, "full_outer")
    b, t, m = F.col("b"), F.col("t"), F.col("m")
    all3 = b.isNotNull() & t.isNotNull() & m.isNotNull()
    kept = (
        F.when(b.isNull() & m.isNull(), "theirs")
        .when(b.isNull(), F.when(t.isNull() | t.eqNullSafe(m), "mine").otherwise("theirs"))
        .when(m.isNull(), F.when(t.isNull() | t.eqNullSafe(b), "gone").otherwise("theirs"))
        .when(t.isNull(), F.when(m.eqNullSafe(b), "gone").otherwise("mine"))
        .otherwise("merged")
    )
    clash = {v: all3 & ~m[v].eqNullSafe(b[v]) & ~t[v].eqNullSafe(b[v]) & ~m[v].eqNullSafe(t[v]) for v in values}
    conflict = (
        F.when(b.isNull() & t.isNotNull() & m.isNotNull() & ~t.eqNullSafe(m), "ConcurrentAdd")
        .when(b.isNotNull() & m.isNull() & t.isNotNull() & ~t.eqNullSafe(b), "DeleteModify")
        .when(b.isNotNull() & t.isNull() & m.isNotNull() & ~m.eqNullSafe(b), "DeleteModify")
        .when(reduce(lambda x, y: x | y, clash.values()), "Field")
    )
    merged = [F.when(F.col("kept") == "mine", m[v]).when((F.col("kept") == "merged") & ~m[v].eqNullSafe(b[v]) & t[v].eqNullSafe(b[v]), m[v]).when(F.col("kept") != "gone", t[v]).alias(v) for v in values]
    names = F.filter(F.array(*[F.when(c, F.lit(v)) for v, c in clash.items()]), lambda x: x.isNotNull())
    return j.withColumn("kept", kept).select(identity, "kept", conflict.alias("conflict"), names.alias("conflicts"), *merged, "b", "t", "m")


def resolve(merged: DataFrame, choices: DataFrame, identity: str, values: list[str]) -> DataFrame:
    """Apply choices (identity, take: mine, base or theirs); what is unresolved keeps its conflict and blocks.

    A field conflict takes the chosen side's fields in conflict only; a row conflict takes the whole row or drops it.
    """
    j = merged.join(choices.select(identity, "take"), identity, "left")
    side = F.when(F.col("take") == "mine", F.col("m")).when(F.col("take") == "base", F.col("b")).when(F.col("take") == "theirs", F.col("t"))
    row = F.col("conflict").isin("ConcurrentAdd", "DeleteModify") & F.col("take").isNotNull()
    field = (F.col("conflict") == "Field") & F.col("take").isNotNull()
    j = j.withColumn("_s", side)
    out = [F.when(row, F.col("_s")[v]).when(field & F.array_contains("conflicts", v), F.col("_s")[v]).otherwise(F.col(v)).alias(v) for v in values]
    kept = F.when(row, F.when(F.col("_s").isNull(), "gone").otherwise(F.col("take"))).otherwise(F.col("kept"))
    return j.select(identity, kept.alias("kept"), F.when(F.col("take").isNull(), F.col("conflict")).alias("conflict"), *out)
