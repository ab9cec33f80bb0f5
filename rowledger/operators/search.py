"""Search over rows: the text of a filter becomes one predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_folder(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def predicate(text: str, aliases: dict[str, str], folders: list[str] | None = None) -> tuple[Column, list[str]]:
    """Predicate over key, type, labels and path, and the terms of `ref:`.

    Plain words must all be in the key, in any case; terms of one prefix are alternatives, prefixes must all hold.
    """
    words, by = [], {"t": [], "l": [], "ref": []}
    for token in text.split():
        prefix, colon, term = token.partition(":")
        if not colon:
            words.append(token)
        elif prefix in by and term:
            by[prefix].append(term)
    tests = [F.lower("key").contains(w.lower()) for w in words]
    if by["t"]:
        tests.append(F.col("type").isin([aliases.get(t, t) for t in by["t"]]))
    if by["l"]:
        tests.append(F.arrays_overlap("labels", F.array(*map(F.lit, by["l"]))))
    if folders:
        tests.append(reduce(lambda a, b: a | b, [in_folder(F.col("path"), f) for f in folders]))
    return reduce(lambda a, b: a & b, tests, F.lit(True)), by["ref"]


def search(rows: DataFrame, text: str, aliases: dict[str, str], folders: list[str] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """rows (key, type, labels, path, row_guid) that match; edges (src_guid, dst_path) serve `ref:`."""
    test, refs = predicate(text, aliases, folders)
    out = rows.where(test)
    if refs and edges is None:
        return out.limit(0)  # nothing is known to refer to anything
    if refs:
        hit = reduce(lambda a, b: a | b, [(F.col("dst_path") == r) | F.col("dst_path").endswith("/" + r) for r in refs])
        out = out.join(edges.where(hit).select(F.col("src_guid").alias("row_guid")), "row_guid", "left_semi")
    return out


def browse(rows: DataFrame, *by: str, text: str = "", aliases: dict[str, str] | None = None, folders: list[str] | None = None, edges: DataFrame | None = None, display: str = "") -> DataFrame:
    """Counts of rows and of their badges; rows have boolean dirty, conflicted and error. text, aliases, folders and edges
    choose rows as in search, and display those whose display_name holds it, in any case."""
    if text or folders:
        rows = search(rows, text, aliases or {}, folders, edges)
    if display:
        rows = rows.where(F.contains(F.lower("display_name"), F.lower(F.lit(display))))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(b)).alias(f"n_{b}") for b in ("dirty", "conflicted", "error")])


def pick_targets(rows: DataFrame, types: list[str], group: str | None = None, text: str = "") -> DataFrame:
    """Candidates of a reference column: rows of the types, of the group's label, whose key has the words of `text`."""
    terms = [text, *[f"t:{t}" for t in types], *([f"l:{group}"] if group else [])]
    return search(rows, " ".join(terms), {})


def load_all(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """A row, a workbook or one of its tables by path, in order; sorting is for output."""
    return rows.where(in_folder(F.col("path"), path)).orderBy(*order)


def asset_state(rows: DataFrame, wanted: DataFrame, identity: str) -> DataFrame:
    """wanted (identity) with state: Resident, Missing for a tombstone (alive is false), Unknown."""
    j = wanted.join(rows.select(identity, F.col("alive").alias("_a")), identity, "left")
    return j.withColumn("state", F.when(F.col("_a"), "Resident").when(~F.col("_a"), "Missing").otherwise("Unknown")).drop("_a")
