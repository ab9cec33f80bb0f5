"""Migration of long cell frames between schema versions, step by step, all or nothing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["workbook_id", "table_id", "row_guid"]


@dataclass(frozen=True)
class Step:
    order: int
    id: str
    table_id: int
    source: str
    target: str
    transform: Callable[[Column], Column] | None
    overwrite: bool = False
    materialize_default: bool = False
    version: int = 1
    data_loss: bool = False
    #: Where it holds for a source text, the step has nothing to do there.
    skips: Callable[[Column], Column] | None = None

    def marker(self) -> str:
        return f"{self.id}@{self.version}"


def ordered(steps: list[Step]) -> list[Step]:
    return sorted(steps, key=lambda s: (s.order, s.id, s.version, s.table_id, s.source, s.target))


def check_steps(steps: list[Step], old_fields: set[tuple[int, str]], new_fields: set[tuple[int, str]]) -> list[tuple[str, str]]:
    """(code, step's marker) of steps that no plan can hold; steps and fields (table_id, field path) are declarations."""
    found, seen = [], set()
    for s in ordered(steps):
        rules = {
            "step.number": s.order <= 0 or s.version <= 0 or s.table_id <= 0,
            "step.source": (s.table_id, s.source) not in old_fields,
            "step.target": (s.table_id, s.target) not in new_fields or (s.table_id, s.target) in old_fields,
            "step.unregistered": s.transform is None,
            "step.overwrite": s.overwrite and not s.data_loss,
            "step.repeated": (s.marker(), s.table_id, s.source, s.target) in seen,
        }
        found += [(code, s.marker()) for code, bad in rules.items() if bad]
        seen.add((s.marker(), s.table_id, s.source, s.target))
    return found


def plan_hash(steps: list[Step], source_schema: str, target_schema: str) -> str:
    """SHA-256 of what a plan declares, whatever order its steps are given in."""
    lines = [source_schema, target_schema] + ["\x1f".join(map(str, (s.order, s.marker(), s.table_id, s.source, s.target, s.overwrite, s.materialize_default, s.data_loss))) for s in ordered(steps)]
    return hashlib.sha256("\x1e".join(lines).encode()).hexdigest()


def has_all_markers(applied: Column, required: list[str]) -> Column:
    """True where the array `applied` holds every required marker."""
    return F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce(applied, F.array().cast("array<string>")))) == 0


def workbook_states(workbooks: DataFrame, steps: list[Step], source_schema: str, target_schema: str) -> DataFrame:
    """(workbook_id, action, code) of workbooks (workbook_id, schema_hash, markers): migrate those of the source schema,
    none of the target schema with all markers; anything else blocks the plan."""
    at_target = F.col("schema_hash") == target_schema
    code = F.when(at_target & ~has_all_markers(F.col("markers"), [s.marker() for s in steps]), "migration.markers").when(~at_target & ~F.col("schema_hash").eqNullSafe(F.lit(source_schema)), "migration.schema")
    action = F.when(code.isNotNull(), "blocked").when(at_target, "done").otherwise("migrate")
    return workbooks.select("workbook_id", action.alias("action"), code.alias("code"))


def outcomes(cells: DataFrame, steps: list[Step]) -> DataFrame:
    """(keys, position, step, outcome, target, value): Converted, Skipped or Error of each source cell, in order of steps.

    cells: keys, field_path, state, text, one for a field of a row. A step sees what earlier ones made. The fields that any
    step touches become columns of their row in one aggregate, the steps are expressions over these one after the other,
    and the outcomes are unpacked at the end: one shuffle, however many steps there are.
    """
    plan = ordered(steps)
    touched = list(dict.fromkeys((s.table_id, f) for s in plan for f in (s.source, s.target)))
    column = {x: f"f{i}" for i, x in enumerate(touched)}
    own = [((F.col("table_id") == t) & (F.col("field_path") == f)) for t, f in touched]
    some = own[0]
    for o in own[1:]:
        some = some | o
    rows = cells.where(some).groupBy(*KEYS).agg(*[F.max(F.when(o, F.struct("state", "text"))).alias(column[x]) for o, x in zip(own, touched, strict=True)])
    for i, s in enumerate(plan):
        source, target = F.col(column[s.table_id, s.source]), F.col(column[s.table_id, s.target])
        rows = rows.withColumn(f"v{i}", s.transform(source["text"]))
        value = F.col(f"v{i}")
        filled = F.coalesce(target["state"], F.lit("Missing")) != "Missing"
        outcome = (
            F.when(source.isNull(), F.lit(None))
            .when(source["state"] == "Invalid", "Error")
            .when((source["state"] == "Missing") | ((source["state"] == "Defaulted") & F.lit(not s.materialize_default)), "Skipped")
            .when(F.coalesce(s.skips(source["text"]), F.lit(False)) if s.skips else F.lit(False), "Skipped")
            .when(value.isNull(), "Error")
            .when(filled & target["text"].eqNullSafe(value), "Skipped")
            .when(filled & F.lit(not s.overwrite), "Error")
            .otherwise("Converted")
        )
        rows = rows.withColumn(f"o{i}", outcome)
        made = F.when(F.col(f"o{i}") == "Converted", F.struct(F.lit("Value").alias("state"), value.alias("text"))).otherwise(target)
        rows = rows.withColumn(column[s.table_id, s.target], made)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(s.id).alias("step"), F.col(f"o{i}").alias("outcome"), F.lit(s.target).alias("target"), F.col(f"v{i}").alias("value")) for i, s in enumerate(plan)]
    return rows.select(*KEYS, F.explode(F.array(*entries)).alias("e")).select(*KEYS, "e.*").where("outcome is not null")


def undetermined(cells: DataFrame, found: DataFrame, steps: list[Step]) -> DataFrame:
    """(keys, step, code) of outcomes that a second evaluation does not give again: their transforms are no functions of the text, so
    the plan must not be applied. found: what outcomes gave, written (by checkpoint(), or to a table), so that it is a first evaluation."""
    again = outcomes(cells, steps).select(*KEYS, "position", F.col("outcome").alias("_o"), F.col("value").alias("_v"))
    j = found.select(*KEYS, "position", "step", "outcome", "value").join(again, [*KEYS, "position"], "full_outer")
    same = F.col("outcome").eqNullSafe(F.col("_o")) & F.col("value").eqNullSafe(F.col("_v"))
    return j.where(~same).select(*KEYS, F.coalesce("step", F.lit("")).alias("step"), F.lit("migration.undetermined").alias("code"))


def apply(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells after the migration, or as they were if any outcome anywhere is an error: a join with one flag. Of several
    steps that fill a cell the last one counts."""
    bad = found.agg(F.coalesce(F.bool_or(F.col("outcome") == "Error"), F.lit(False)).alias("_bad"))
    last = found.where("outcome = 'Converted'").groupBy(*KEYS, F.col("target").alias("field_path")).agg(F.max_by("value", "position").alias("text"))
    done = last.select(*KEYS, "field_path", F.lit("Value").alias("state"), "text").join(F.broadcast(bad), ~F.col("_bad")).drop("_bad")
    kept = cells.select(*KEYS, "field_path", "state", "text")
    return kept.join(done.select(*KEYS, "field_path"), [*KEYS, "field_path"], "left_anti").unionByName(done)


def apply_checked(cells: DataFrame, found: DataFrame, planned: DataFrame, current: DataFrame, steps: list[Step], confirmed: bool = False, states: DataFrame | None = None, intact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cells, errors): apply a plan if the workbooks are still those it was made for; else the cells as they are.

    planned, current (workbook_id, revision); states: of workbook_states, whose blockers stop the plan; intact: whether the
    plan's hash is that of its steps; errors (workbook_id, code). Overwriting steps need `confirmed`. Applying a plan that
    has been applied changes nothing, as every target then holds its value.
    """
    a, b = planned.select("workbook_id", F.col("revision").alias("_p")), current.select("workbook_id", F.col("revision").alias("_c"))
    errors = a.join(b, "workbook_id", "full_outer").where(~F.col("_p").eqNullSafe(F.col("_c"))).select("workbook_id", F.lit("plan.stale").alias("code"))
    if any(s.overwrite for s in steps) and not confirmed:
        errors = errors.union(planned.select("workbook_id", F.lit("plan.data_loss_unconfirmed")))
    if not intact:
        errors = errors.union(planned.select("workbook_id", F.lit("plan.hash")))
    if states is not None:
        errors = errors.union(states.where("action = 'blocked'").select("workbook_id", "code"))
    return (apply(cells, found) if errors.isEmpty() else cells.select(*KEYS, "field_path", "state", "text")), errors


def migrated_workbooks(workbooks: DataFrame, states: DataFrame, found: DataFrame, steps: list[Step], target_schema: str) -> DataFrame:
    """workbooks (workbook_id, schema_hash, markers, revision) after the plan: those to migrate get the markers of its steps,
    the target schema and the next revision, unless a blocker or an error anywhere reverts all of them."""
    bad = states.select((F.col("action") == "blocked").alias("_x")).union(found.select(F.col("outcome") == "Error")).agg(F.coalesce(F.bool_or("_x"), F.lit(False)).alias("_bad"))
    j = workbooks.join(states.select("workbook_id", "action"), "workbook_id").join(F.broadcast(bad))
    go = (F.col("action") == "migrate") & ~F.col("_bad")
    markers = F.array_sort(F.array_union(F.coalesce("markers", F.array().cast("array<string>")), F.array(*[F.lit(s.marker()) for s in ordered(steps)])))
    return j.select("workbook_id", F.when(go, F.lit(target_schema)).otherwise(F.col("schema_hash")).alias("schema_hash"), F.when(go, markers).otherwise(F.col("markers")).alias("markers"), F.when(go, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))
