"""The declared schema: tables and fields by numeric id. Small, so it lives on the driver and generates expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    field_id: int
    name: str
    type: str = "string"
    key_order: int | None = None
    required: bool = False
    default: str | None = None
    min: float | None = None
    max: float | None = None
    regex: str | None = None
    unique: bool = False
    enum: tuple[tuple[str, int], ...] = ()
    aliases: tuple[str, ...] = ()
    ref_table: int | None = None
    targets: tuple[str, ...] = ("client", "server")
    #: Names of registered cell formats: the one that is written, and those that are still read.
    format: str | None = None
    legacy: tuple[str, ...] = ()
    #: scalar, struct, list, structs (a list of structs) or map; a cell of what is not scalar and has no format is JSON.
    shape: str = "scalar"
    #: The group of which at most one field may be set.
    oneof: str | None = None


@dataclass(frozen=True)
class Table:
    table_id: int
    sheet: str
    fields: tuple[Field, ...]
    retired: bool = False
    targets: tuple[str, ...] = ("client", "server")
    #: Names of registered row validators.
    validators: tuple[str, ...] = ()

    def keys(self) -> list[Field]:
        return sorted((f for f in self.fields if f.key_order is not None), key=lambda f: f.key_order)


@dataclass(frozen=True)
class Catalog:
    tables: tuple[Table, ...]

    def table(self, table_id: int) -> Table | None:
        return next((t for t in self.tables if t.table_id == table_id), None)

    def live(self, target: str | None = None) -> list[Table]:
        return [t for t in self.tables if not t.retired and (target is None or target in t.targets)]

    def columns(self, spark: SparkSession) -> DataFrame:
        rows = [(t.table_id, f.field_id, f.name, f.type, list(f.aliases), f.ref_table) for t in self.tables for f in t.fields]
        return spark.createDataFrame(rows, "table_id int, field_id int, name string, type string, aliases array<string>, ref_table int")
