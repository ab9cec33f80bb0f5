"""Pointers: small files that name what counts, each created once and never changed, so that of two writers one loses.

A pointer is one line of JSON. It is written under a hidden name first and then takes its own name only if nothing has it:
on a local disk by a hard link, elsewhere by a rename without overwriting, which file systems with a name server make
atomic. Whoever reads sees a whole pointer or none.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(Exception):
    """Somebody else has published what this writer was about to."""


def create_once(spark: SparkSession, path: str, entry: dict) -> bool:
    """Create the pointer at `path`; false, and nothing changed, if there is one already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = target.makeQualified(system.getUri(), system.getWorkingDirectory())
    draft = hadoop.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = system.create(draft, False)
    try:
        out.write(bytearray((json.dumps(entry, sort_keys=True) + "\n").encode()))
    finally:
        out.close()
    try:
        if system.getScheme() == "file":
            os.link(*[unquote(urlparse(p.toUri().toString()).path) for p in (draft, target)])
        else:
            context = hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(draft, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
    finally:
        system.delete(draft, False)


def read_pointers(spark: SparkSession, folder: str) -> DataFrame | None:
    """(number, entry fields) of all pointers of a folder, None if there are none."""
    kind = "number long, writer string, notes map<string,string>, paths map<string,string>"
    try:
        found = spark.read.schema(kind).json(folder)
        return None if found.isEmpty() else found
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest_pointer(spark: SparkSession, folder: str) -> dict | None:
    found = read_pointers(spark, folder)
    row = found.orderBy(F.desc("number")).first() if found is not None else None
    return row.asDict() if row else None


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
