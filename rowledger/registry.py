"""Named extensions: cell formats, row validators, migrations, families of external keys, sources of identities.

An entry is a function that returns a Column, so that what is registered runs inside the plan like everything else; a
pandas_udf returns one as well. Equal names are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Registry:
    entries: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, f: Callable) -> Callable:
        if not name.strip():
            raise ValueError("a registered name must not be empty")
        if name in self.entries:
            raise ValueError(f"{name} is registered already")
        self.entries[name] = f
        return f

    def get(self, name: str) -> Callable | None:
        return self.entries.get(name)


@dataclass(frozen=True)
class Format:
    """Reading and writing of a cell's text; both null where it does not apply."""

    parse: Callable[[Column], Column]
    write: Callable[[Column], Column]


@dataclass
class Extensions:
    formats: dict[str, Format] = field(default_factory=dict)
    validators: Registry = field(default_factory=Registry)
    migrations: Registry = field(default_factory=Registry)

    def register_format(self, name: str, parse: Callable[[Column], Column], write: Callable[[Column], Column]) -> None:
        if name in self.formats:
            raise ValueError(f"{name} is registered already")
        self.formats[name] = Format(parse, write)

    def register_validator(self, name: str, rule: Callable[[], Column]) -> None:
        """rule: a condition over the row that holds where the row is sound."""
        self.validators.add(name, rule)

    def register_migration(self, name: str, version: int, transform: Callable[[Column], Column]) -> None:
        """transform: text to text, null for an error."""
        if version <= 0:
            raise ValueError("a version must be positive")
        self.migrations.add(f"{name}@{version}", transform)

    def migration(self, name: str, version: int) -> Callable[[Column], Column]:
        found = self.migrations.get(f"{name}@{version}")
        if found is None:
            raise KeyError(f"{name}@{version} is not registered")
        return found


def register_family(spark: SparkSession, family: str, version: int, values: DataFrame) -> DataFrame:
    """values (token, value) as a family frame (family, token, value) for bind_external; an empty or repeated token is an error."""
    if not re.fullmatch(r"[a-z][a-z0-9.-]*", family) or version <= 0:
        raise ValueError("a family needs a name of a-z, 0-9, dot and dash, and a positive version")
    bad = values.groupBy("token").count().where("count > 1 or token is null or trim(token) = ''")
    if not bad.isEmpty():
        raise ValueError(f"family {family} has empty or repeated tokens")
    return values.select(F.lit(family).alias("family"), "token", "value")


def random_guid() -> Column:
    """Default source of identities: 32 hex digits, new at every evaluation, so write them before reading them twice."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def fixed_guid(*key: Column) -> Callable[[], Column]:
    """A source for tests: the same key gets the same identity."""
    return lambda: F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary"))
