"""Workbook files to staging rows, and versioned outputs."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowledger.functions.cells import valid_guid
from rowledger.operators import release
from rowledger.sources.pointers import CommitConflict, create_once, delete, newest_pointer, read_pointers

STAGING = "path string, sheet string, row_number int, raw_guid string, raw_revision string, cells map<string,struct<text:string,formula:string>>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


Cell = tuple[str | None, str | None]

#: Rows of a batch that the reader hands on.
BATCH_ROWS = 2_000


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind as they are read; what came before is forgotten, so that a part of any size takes little memory."""
    with z.open(name) as f:
        above: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == f"{MAIN}{tag}":
                yield e
                e.clear()
                if above:
                    above[-1].remove(e)


def sheet_rows(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, dict[str, Cell]]]:
    """(row, {column letters: (text, formula)}) of a sheet, one row after the other as the file holds them."""
    for row in _elements(z, part, "row"):
        found: dict[int, dict[str, Cell]] = {}
        for c in row.iter(f"{MAIN}c"):
            column, n = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            value, formula, kind = c.find(f"{MAIN}v"), c.find(f"{MAIN}f"), c.get("t")
            text = value.text if value is not None else None
            if kind == "s" and text is not None:
                text = shared[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            elif kind == "b" and text is not None:
                text = "true" if text == "1" else "false"
            found.setdefault(int(n), {})[column] = (text, formula.text if formula is not None else None)
        yield from found.items()


def sheets(data: bytes) -> Iterator[tuple[str, Iterator[tuple[int, dict[str, Cell]]]]]:
    """(name, rows) of each sheet of one workbook; a sheet's rows are read while they are asked for. The texts that cells share are held."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in _elements(z, "xl/sharedStrings.xml", "si")]
        links = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            yield sheet.get("name"), sheet_rows(z, "xl/" + links[sheet.get(f"{REL}id")], shared)


def staging_rows(path: str, data: bytes) -> Iterator[tuple]:
    """Staging rows of one workbook, in the order of its sheets and their rows."""
    for name, rows in sheets(data):
        paths: dict[str, str] = {}
        for n, cells in rows:
            if n == 2:
                paths = {c: t for c, (t, _) in cells.items() if t}
            if n <= 3:
                continue
            found = {paths[c]: {"text": t, "formula": f} for c, (t, f) in cells.items() if c in paths and (t or f)}
            guid, revision = (found.pop(x, {}).get("text") for x in ("__guid", "__rev"))
            if found or guid or revision:
                yield path, name, n, guid, revision, list(found.items())


def read_workbooks(spark: SparkSession, glob: str) -> DataFrame:
    """Staging rows of many workbooks, one file per input row: row 1 names, row 2 property paths, row 3 types, data from
    row 4, columns __guid and __rev among them. Blank cells are absent, blank rows are skipped. A file's rows come in batches while it is
    read, so that a task holds the compressed file, the texts its cells share, and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.struct([("text", pa.string()), ("formula", pa.string())])
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), cell)]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = staging_rows(path, content.as_py())
                while rows := list(islice(found, BATCH_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "sheet", "row_number", "raw_guid", "raw_revision", "cells"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(run, STAGING)


# How a source of workbooks describes itself.
SOURCE_KIND, SOURCE_FORMAT, CAPABILITIES = "workbooks", "1", ("read", "watch", "live")


def source_info(spark: SparkSession, glob: str) -> DataFrame:
    """One row: kind, capabilities, format_version, revision, number of files, and a hash over the hashes of their contents, whatever
    their names and order. The hashes join by prefixes, so that no task gets those of all files."""
    level = spark.read.format("binaryFile").load(glob).select(F.sha2("content", 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for digits in (4, 2, 0):
        joined = F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d")
        # A node begins like those below it, so that the next level finds it.
        prefix = F.substring("h", 1, digits)
        level = level.groupBy(prefix.alias("p")).agg(joined, F.sum("n").alias("n")).select(F.concat("p", "d").alias("h"), "n")
    root = level.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("content_hash"), F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("files"))
    shown = F.array(*map(F.lit, CAPABILITIES)).alias("capabilities")
    return root.select(F.lit(SOURCE_KIND).alias("kind"), shown, F.lit(SOURCE_FORMAT).alias("format_version"), release.root_revision(F.col("content_hash")).alias("revision"), "files", "content_hash")


@dataclass(frozen=True)
class Version:
    """A published version: its number, what its writer noted, and its frames by name."""

    number: int
    writer: str
    notes: dict[str, str]
    frames: dict[str, DataFrame]


def publish(df: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write a version to a folder that nothing names yet, then its pointer, whose creation publishes it. A version that is
    published stays as it is: rerunning is a no-op, and a run that dies leaves no trace that anything reads."""
    return commit_workbooks({"": df}, root, version, partition_by)[""]


def commit_workbooks(frames: dict[str, DataFrame], root: str, version: int, partition_by: list[str] | None = None, expect: int | None = None, writer: str = "", notes: dict[str, str] | None = None) -> dict[str, str]:
    """Publish the frames of many workbooks as one version, all or none: the pointer names all of their folders.

    expect: the newest version that the writer has seen (0: none). If another one is there by now, or is there when the
    pointer is to be created, CommitConflict is raised, what was published stays named and this writer's folders go. A version that the
    same writer (a name, not empty) has published is its own, so running again after a failure is a no-op; without expect every
    version that is there before the writing begins counts as its own.
    """
    spark = next(iter(frames.values())).sparkSession
    pointer = f"{root}/pointer/version={version}.json"
    found = read_pointers(spark, f"{root}/pointer")
    there = found.where(F.col("number") == version).first() if found is not None else None
    if there and (there.writer == writer if writer else expect is None):
        return there.paths
    last = found.agg(F.max("number")).first()[0] if found is not None else 0
    if expect is not None and last != expect:
        raise CommitConflict(f"version {last} is published, {expect} was expected")
    paths = {name: _write_once(df, f"{root}/data/version={version}" + (f"-{i}" if name else ""), partition_by) for i, (name, df) in enumerate(frames.items())}
    if not create_once(spark, pointer, {"number": version, "writer": writer, "notes": notes or {}, "paths": paths}):
        delete(spark, *paths.values())
        raise CommitConflict(f"version {version} was published by another writer")
    return paths


def newest_version(spark: SparkSession, root: str) -> Version | None:
    """The newest published version, None if there is none."""
    row = newest_pointer(spark, f"{root}/pointer")
    return Version(row["number"], row["writer"], row["notes"], {n: spark.read.parquet(p) for n, p in row["paths"].items()}) if row else None


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest published frame, None if there is none."""
    return current_workbooks(spark, root).get("")


def current_workbooks(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The frames of the newest published version by name."""
    found = newest_version(spark, root)
    return found.frames if found else {}


def child_rows(staging: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of child sheets (those with __parent_guid) as (path, sheet, row_number, parent_guid, ordinal, map_key, cells),
    and findings (path, sheet, row_number, code): no sound ordinal or key, or one that repeats under its parent. A parent
    that is no guid stays null for attach_children to report."""
    at = lambda name: F.try_element_at("cells", F.lit(name))["text"]
    system = ["__parent_guid", "__ordinal", "__map_key"]
    rows = staging.where(F.arrays_overlap(F.map_keys("cells"), F.array(*map(F.lit, system))))
    number = F.when(at("__ordinal").rlike(r"^\d{1,10}$"), at("__ordinal").try_cast("int"))
    rows = rows.select(
        "path", "sheet", "row_number", F.when(valid_guid(at("__parent_guid")), at("__parent_guid")).alias("parent_guid"),
        F.when(number > 0, number).alias("ordinal"), at("__map_key").alias("map_key"), F.map_filter("cells", lambda k, v: ~k.isin(system)).alias("cells"),
    )
    name = F.coalesce(F.col("ordinal").cast("string"), "map_key")
    by = ["path", "sheet", "parent_guid", "_name"]
    named = rows.withColumn("_name", name)
    twice = named.where("parent_guid is not null and _name is not null").groupBy(*by).count().where("count > 1")
    bad = named.where("parent_guid is not null and _name is null").select("path", "sheet", "row_number", F.lit("child.no_identity").alias("code"))
    return rows, bad.union(named.join(twice, by, "left_semi").select("path", "sheet", "row_number", F.lit("child.duplicate")))


def save_snapshot(values: DataFrame, root: str, version: int, workbook: str, schema_hash: str) -> None:
    """Write cells with their raw and effective states to a folder of their own, then a manifest row, whose commit is what
    counts; a version that is saved stays as it is."""
    spark = values.sparkSession
    if _saved(spark, root, version):
        return
    path = _write_once(values, f"{root}/data/version={version}")
    rows = spark.read.parquet(path).count()
    _manifest(spark, root, version, {"workbook": workbook, "schema_hash": schema_hash, "path": path, "rows": str(rows)})


def load_snapshot(spark: SparkSession, root: str, workbook: str, schema_hash: str) -> tuple[DataFrame | None, str | None]:
    """(cells, null) of the newest version, or (null, code) where there is none, it is another's, or it is damaged: a
    base for a merge is never guessed."""
    m = _newest(spark, root)
    if m is None:
        return None, "snapshot.missing"
    if m.get("workbook") != workbook or m.get("schema_hash") != schema_hash:
        return None, "snapshot.foreign"
    found = _read(spark, m.get("path"))
    if found is None or str(found.count()) != m.get("rows"):
        return None, "snapshot.corrupt"
    return found, None


def write_release(records: DataFrame, root: str, version: int, target: str, schema_hash: str, dependencies: DataFrame | None = None, findings: DataFrame | None = None, blockers: DataFrame | None = None) -> None:
    """Long records of one target, a directory per table, with their dependencies, an index of the rows, the leaves of their digest tree, and a
    manifest whose hash covers header and content.

    blockers (as release.assemble gives them) and findings of errors forbid the release before anything is written; rows
    that are not sound forbid it by leaving no manifest, without which nothing reads what was written. A version that is
    written stays as it is.
    """
    spark = records.sparkSession
    if _saved(spark, root, version):
        return
    codes = [] if release.sound_schema(schema_hash) else ["release.no_schema"]
    codes += ["release.blockers"] if blockers is not None and not blockers.isEmpty() else []
    codes += ["release.findings"] if findings is not None and not findings.where("severity >= 2").isEmpty() else []
    if codes:
        raise ValueError(f"not fit for release: {', '.join(codes)}")
    # A prefix of a table lies in one file, so that a file that changes touches few leaves.
    path = _write_once(records.repartition("table_id", F.substring("row_guid", 1, 4)), f"{root}/data/version={version}", ["table_id"])
    edges = _write_once(dependencies, f"{root}/data/dependencies={version}") if dependencies is not None else ""
    written = _read(spark, path)
    held = written if written is not None else records.limit(0)
    index = _write_once(release.row_index(held), f"{root}/data/index={version}")
    found = release.index_faults(spark.read.parquet(index), _read(spark, edges) if edges else None).where("n > 0").collect()  # a row a rule
    codes = sorted(r.code for r in found) + ([] if held.where("coalesce(row_guid, '') = ''").isEmpty() else ["release.no_identity"])
    if codes:
        raise ValueError(f"not fit for release: {', '.join(sorted(codes))}")
    rows = held.count()
    digits = release.leaf_digits(rows)
    tree = _write_once(_leaves(held, digits), f"{root}/data/tree={version}")
    files = _write_once(_files(spark, path), f"{root}/data/files={version}")
    leaves = spark.read.parquet(tree)
    header = {"format": "2", "schema_hash": schema_hash, "target": target, "tables": str(leaves.select("table_id").distinct().count()), "rows": str(rows), "digits": str(digits)}
    digest = release.tree_root(leaves, digits, json.dumps(header, sort_keys=True)).first()[0]
    _manifest(spark, root, version, header | {"content_hash": digest, "revision": digest[:16], "path": path, "schema": held.schema.json(), "dependencies": edges, "index": index, "tree": tree, "files": files})


def open_release(spark: SparkSession, root: str, target: str, schema_hash: str, whole: bool = False) -> tuple[DataFrame | None, list[str]]:
    """(records, no codes), or (null, what is wrong) of the newest release.

    Target, schema, and the hash of header and tree are always checked, which reads the tree alone. Of the records only the
    files that differ in name, length or time from those that were written are hashed again (`whole`: all of them) and
    compared leaf by leaf; what was checked when it was written and did not change is sound still.
    """
    m = _newest(spark, root)
    if m is None:
        return None, ["release.missing"]
    codes = [f"release.{k}" for k, v in (("format", "2"), ("target", target), ("schema_hash", schema_hash)) if m.get(k) != v]
    parts = {k: _read(spark, m[k]) if m.get(k) else None for k in ("tree", "files", "index", "dependencies")}
    if any(m.get(k) and parts[k] is None for k in parts) or parts["tree"] is None or parts["files"] is None:
        return None, [*codes, "release.corrupt"]
    header = json.dumps({k: m[k] for k in ("format", "schema_hash", "target", "tables", "rows", "digits")}, sort_keys=True)
    if release.tree_root(parts["tree"], int(m["digits"]), header).first()[0] != m["content_hash"] or not damaged_leaves(spark, root, whole).isEmpty():
        codes.append("release.content_hash")
    records = _read(spark, m["path"], T.StructType.fromJson(json.loads(m["schema"])))
    if records is None or not records.inputFiles():
        codes.append("release.corrupt")
    return (None, codes) if codes else (records, [])


def damaged_leaves(spark: SparkSession, root: str, whole: bool = False) -> DataFrame:
    """(table_id, prefix) of the newest release whose records are not those that were written. See open_release."""
    m = _newest(spark, root)
    leaves, then = spark.read.parquet(m["tree"]), spark.read.parquet(m["files"])
    now = _files(spark, m["path"])
    j = then.withColumn("_then", F.lit(True)).join(now.withColumn("_now", F.lit(True)), ["file", "length", "time"], "full_outer")
    changed = j.groupBy("file").agg(F.bool_or("_now").alias("there"), (F.bool_and(F.col("_then").isNotNull() & F.col("_now").isNotNull())).alias("same"))
    changed = changed if whole else changed.where("not same")
    names = {r.file: r.there for r in changed.select("file", "there").collect()}  # the files that are read again
    if not names:
        return leaves.select("table_id", "prefix").limit(0)
    touched = leaves.where(F.arrays_overlap("files", F.array(*map(F.lit, names))))
    others = {r.file for r in touched.select(F.explode("files").alias("file")).distinct().collect()} - set(names)
    read = [f"{m['path']}/{f}" for f in [*(f for f, there in names.items() if there), *others]]
    by = ["table_id", "prefix"]
    if not read:
        return touched.select(*by)
    kind = T.StructType.fromJson(json.loads(m["schema"]))
    again = _leaves(spark.read.schema(kind).option("basePath", m["path"]).parquet(*read), int(m["digits"])).select(*by, F.col("digest").alias("_d"), F.col("files").alias("_f"))
    bad = touched.join(again, by, "left").where(~F.col("digest").eqNullSafe(F.col("_d"))).select(*by)
    # Of a leaf beside the touched ones only a part was read; it is damaged if a changed file has some of its records.
    stray = again.join(touched.select(*by), by, "left_anti").where(F.arrays_overlap("_f", F.array(*map(F.lit, names)))).select(*by)
    return bad.union(stray).distinct()


def _leaves(records: DataFrame, digits: int) -> DataFrame:
    file = F.substring_index(F.col("_metadata.file_path"), "/", -2) if records.inputFiles() else F.lit("")
    return release.digest_leaves(records.withColumn("file", file), digits, F.array_sort(F.collect_set("file")).alias("files"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, time) below a folder, by its listing: no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return found.select(F.substring_index("path", "/", -2).alias("file"), "length", F.unix_micros("modificationTime").alias("time"))


def _write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write to the folder, or to one of this attempt alone where another has claimed it, one that died or one still running;
    nothing that was written is ever overwritten. The folder is returned for a pointer to name."""
    spark, (parent, name) = df.sparkSession, path.rsplit("/", 1)
    claimed = create_once(spark, f"{parent}/_claims/{name}.json", {"number": 0})
    if not claimed:
        path = f"{path}-{uuid.uuid4().hex}"
    try:
        df.write.mode("error").partitionBy(*(partition_by or [])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        path = f"{path}-{uuid.uuid4().hex}"
        df.write.mode("error").partitionBy(*(partition_by or [])).parquet(path)
    return path


def _saved(spark: SparkSession, root: str, version: int) -> bool:
    found = read_pointers(spark, f"{root}/manifest")
    return found is not None and not found.where(F.col("number") == version).isEmpty()


def _manifest(spark: SparkSession, root: str, version: int, entries: dict[str, str]) -> None:
    if not create_once(spark, f"{root}/manifest/version={version}.json", {"number": version, "writer": "", "notes": entries, "paths": {}}):
        raise CommitConflict(f"version {version} was saved by another writer")


def _newest(spark: SparkSession, root: str) -> dict[str, str] | None:
    row = newest_pointer(spark, f"{root}/manifest")
    return row["notes"] if row else None


def inbox(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of query=.../batch=... folders with both as columns, None if there are none."""
    found = _read(spark, path)
    if found is None:
        return None
    found = found.withColumn("query", F.col("query").cast("string")).withColumn("batch", F.col("batch").cast("long"))
    return None if found.isEmpty() else found


def _read(spark: SparkSession, path: str, kind: T.StructType | None = None) -> DataFrame | None:
    """A Parquet folder, None where it is absent or holds no readable file; with its types given no file is opened."""
    try:
        return (spark.read.schema(kind) if kind else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
