"""Row identities: scan against what is known, rekeying, moves, and free names and places for new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.functions.cells import key_ref, valid_guid


def scan(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (row_no, table_id, raw_guid, key) against known (table_id, row_guid, key): row_no, status, row_guid, severity.

    A valid guid: Duplicated where it repeats or is known under another table, else Renamed or Retained. None: Recovered
    where exactly one known row has the key, Invalid where several do or the text is malformed, else PendingNew, which
    gets no guid here (see assign). An identity that several rows would recover is Invalid for all of them.
    """
    good = valid_guid(F.col("raw_guid"))
    repeats = rows.where(good).groupBy("raw_guid").agg(F.count("*").alias("_n"))
    by_guid = known.groupBy(F.col("row_guid").alias("raw_guid")).agg(F.count_distinct("table_id").alias("_tables"), F.min("table_id").alias("_table"), F.min("key").alias("_key"))
    by_key = known.groupBy("table_id", "key").agg(F.count("*").alias("_same"), F.min("row_guid").alias("_found"))
    j = rows.join(repeats, "raw_guid", "left").join(by_guid, "raw_guid", "left").join(by_key, ["table_id", "key"], "left")
    elsewhere = (F.col("_tables") > 1) | (F.col("_table") != F.col("table_id"))
    blank = F.coalesce(F.col("raw_guid"), F.lit("")) == ""
    status = (
        F.when(good & ((F.col("_n") > 1) | F.coalesce(elsewhere, F.lit(False))), "Duplicated")
        .when(good & F.col("_key").isNotNull() & ~F.col("_key").eqNullSafe(F.col("key")), "Renamed")
        .when(good, "Retained")
        .when(F.col("_same") == 1, "Recovered")
        .when((F.col("_same") > 1) | ~blank, "Invalid")
        .otherwise("PendingNew")
    )
    j = j.withColumn("status", status).withColumn("row_guid", F.when(F.col("status") == "Recovered", F.col("_found")).when(F.col("status").isin("Retained", "Renamed"), F.col("raw_guid")))
    shared = j.where("status = 'Recovered'").groupBy("table_id", "row_guid").agg(F.count("*").alias("_m")).where("_m > 1")
    j = j.join(shared, ["table_id", "row_guid"], "left").withColumn("status", F.when(F.col("_m").isNotNull(), "Invalid").otherwise(F.col("status")))
    severity = F.when(F.col("status").isin("Duplicated", "Invalid"), 3).when(F.col("status") == "Recovered", 1).otherwise(0)
    return j.select("row_no", "table_id", "status", F.when(F.col("status") != "Invalid", F.col("row_guid")).alias("row_guid"), severity.alias("severity"))


def removed(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """(table_id, row_guid, key, status): known rows that no scanned row stands for, as Removed. A row whose identity is Duplicated is not
    seen under it, so its known row counts as removed as well, like one whose text is Invalid."""
    seen = scanned.where(F.col("status").isin("Retained", "Renamed", "Recovered")).select("table_id", "row_guid").distinct()
    return known.select("table_id", "row_guid", "key").distinct().join(seen, ["table_id", "row_guid"], "left_anti").withColumn("status", F.lit("Removed"))


def repair(scanned: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_no, row_guid) to write back for the Recovered rows that were selected (row_no), and selections that are none."""
    recovered = scanned.where("status = 'Recovered'")
    wanted = selected.select("row_no").distinct()
    return recovered.join(wanted, "row_no", "left_semi").select("row_no", "row_guid"), wanted.join(recovered, "row_no", "left_anti").withColumn("code", F.lit("repair.not_recovered"))


def assignment_blockers(scanned: DataFrame) -> DataFrame:
    """(row_no, code) of scanned rows that forbid new identities: assign is for scans without any."""
    return scanned.where("severity >= 3").select("row_no", F.concat(F.lit("identity."), F.lower("status")).alias("code"))


def assign(scanned: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """PendingNew rows with a fresh random guid, written by checkpoint() before anything reads it twice. Guids that two
    rows drew or that reserved (row_guid) holds are drawn again."""
    pending = scanned.where("status = 'PendingNew'")
    while True:
        fresh = pending.withColumn("row_guid", F.replace(F.uuid(), F.lit("-"), F.lit(""))).checkpoint()
        hit = fresh.groupBy("row_guid").count().where("count > 1").select("row_guid")
        if reserved is not None:
            hit = hit.union(fresh.select("row_guid").join(reserved.select("row_guid").distinct(), "row_guid", "left_semi"))
        if hit.isEmpty():
            return fresh


def assign_identities(scanned: DataFrame, reserved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fresh rows, blockers): of assign, or none at all where the scan has blockers."""
    blockers = assignment_blockers(scanned)
    if blockers.isEmpty():
        return assign(scanned, reserved), blockers
    return scanned.limit(0), blockers


def changed_business(before: DataFrame, after: DataFrame) -> DataFrame:
    """(row_no) of rows whose business hash (row_no, hash) is another one after identities were written: there must be none."""
    j = before.select("row_no", F.col("hash").alias("_b")).join(after.select("row_no", F.col("hash").alias("_a")), "row_no", "full_outer")
    return j.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("row_no")


def rekey(old: DataFrame, new: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (key, ...) rewritten to the new key of the row they name: new_key and error.

    old, new: (row_guid, key) of one table before and after.
    """
    was = old.groupBy("key").agg(F.count("*").alias("_n"), F.min("row_guid").alias("row_guid"))
    now = new.groupBy(F.col("key").alias("new_key")).agg(F.count("*").alias("_m"), F.min("row_guid").alias("row_guid"))
    names = new.select("row_guid", F.col("key").alias("new_key")).join(now.select("new_key", "_m"), "new_key")
    moved = was.join(names, "row_guid", "left").select("key", "new_key", "_n", "_m")
    error = F.when(F.col("_n").isNull() | F.col("new_key").isNull(), "ref.absent").when(F.col("_n") > 1, "key.ambiguous").when(F.col("_m") > 1, "key.duplicate")
    return refs.join(moved, "key", "left").withColumn("error", error).withColumn("new_key", F.when(F.col("error").isNull(), F.col("new_key"))).drop("_n", "_m")


def move(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (key, new_key) with an error: no source, destination taken, or wanted twice. Rows that move away free their key."""
    staying = rows.select("key").join(moves.select("key"), "key", "left_anti").select(F.col("key").alias("new_key"), F.lit(True).alias("_taken"))
    wanted = moves.groupBy("new_key").agg(F.count("*").alias("_w"))
    j = moves.join(rows.select("key", F.lit(True).alias("_there")).dropDuplicates(["key"]), "key", "left").join(staying.distinct(), "new_key", "left").join(wanted, "new_key", "left")
    return j.select("key", "new_key", F.when(F.col("_there").isNull(), "move.no_source").when(F.col("_taken"), "move.taken").when(F.col("_w") > 1, "move.wanted_twice").alias("error"))


def move_rows(rows: DataFrame, moves: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, references, errors) after moves; with any error nothing moves.

    rows (table_id, row_guid, key, path, dirty); moves (path, new_path, new_key); edges (src_guid, property_path, token,
    dst_guid): incoming references. A destination is free if nobody stays there. A new path in another table is refused.
    References to a row whose key changes get its new token, and the rows that hold them are dirty like those that moved.
    """
    there = rows.select("path", "table_id", "row_guid", "key", F.lit(True).alias("_there"))
    j = moves.join(there, "path", "left")
    paths = rows.join(moves.select("path"), "path", "left_anti").select(F.col("path").alias("new_path"), F.lit(True).alias("_path")).distinct()
    moving = moves.join(rows.select("path", "row_guid"), "path").select("row_guid")
    keys = rows.join(moving, "row_guid", "left_anti").select("table_id", F.col("key").alias("new_key"), F.lit(True).alias("_key")).distinct()
    wanted = moves.groupBy("new_path").agg(F.count("*").alias("_w"))
    wanted_keys = j.groupBy("table_id", "new_key").agg(F.count("*").alias("_v"))
    j = j.join(paths, "new_path", "left").join(wanted, "new_path", "left").join(keys, ["table_id", "new_key"], "left").join(wanted_keys, ["table_id", "new_key"], "left")
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    error = (
        F.when(F.col("_there").isNull(), "move.no_source")
        .when(folder(F.col("path")) != folder(F.col("new_path")), "move.other_table")
        .when(F.col("_path"), "move.taken")
        .when(F.col("_w") > 1, "move.wanted_twice")
        .when(F.col("_key"), "move.key_taken")
        .when(F.col("_v") > 1, "move.key_wanted_twice")
    )
    j = j.withColumn("error", error)
    errors = j.where("error is not null").select("path", F.col("error").alias("code"))
    stop = errors.agg((F.count("*") > 0).alias("_stop"))
    done = j.select("row_guid", F.col("new_path").alias("_to"), F.col("new_key").alias("_as")).join(F.broadcast(stop), ~F.col("_stop")).drop("_stop")
    moved = rows.join(done, "row_guid", "left")
    renamed = moved.where("_to is not null and not (_as <=> key)").select(F.col("row_guid").alias("dst_guid"), key_ref(F.col("table_id"), F.col("_as")).alias("_token"))
    after = edges.join(renamed, "dst_guid", "left").withColumn("rewritten", F.col("_token").isNotNull()).withColumn("token", F.coalesce("_token", "token"))
    owners = after.where("rewritten").select(F.col("src_guid").alias("row_guid"), F.lit(True).alias("_owner")).distinct()
    out = moved.join(owners, "row_guid", "left").select(
        "table_id", "row_guid", F.coalesce("_as", "key").alias("key"), F.coalesce("_to", "path").alias("path"), (F.col("dirty") | F.col("_to").isNotNull() | F.col("_owner").isNotNull()).alias("dirty")
    )
    return out, after.select("src_guid", "property_path", "token", "dst_guid", "rewritten"), errors


def rename_rows(rows: DataFrame, names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As move_rows for names (path, new_key): the row stays in its table under the path of its new key."""
    moves = names.select("path", F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("new_key")).alias("new_path"), "new_key")
    return move_rows(rows, moves, edges)


def unique_keys(wanted: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """wanted (key, order) with free_key: the key if free, else the lowest free suffix _1, _2, ... in turn.

    The i-th row that needs a suffix takes the i-th free number. Taken numbers t1 < t2 < ... leave tj - j free ones up
    to tj, so the i-th free number is i plus how many j have tj - j < i: a join of the counts, without any list of numbers.
    """
    free = wanted.join(taken.select("key").distinct().withColumn("_t", F.lit(True)), "key", "left")
    free = rank_in(free, "key", order, "_turn").withColumn("_i", F.col("_turn") - F.when(F.col("_t"), 0).otherwise(1))
    used = taken.select(F.regexp_extract("key", r"^(.*)_([1-9]\d{0,8})$", 1).alias("stem"), F.regexp_extract("key", r"^(.*)_([1-9]\d{0,8})$", 2).try_cast("long").alias("n")).where("n is not null").distinct()
    used = rank_in(used, "stem", "n", "_j")
    # Rows and taken numbers are merged by rank: before the i-th row stand the rows before it and the taken numbers that it skips, those with
    # slack (n - j) below i. Both sequences are ranked by ranges, so a key that holds all rows is the work of many tasks.
    rows = free.select("key", order, "_turn", F.struct(F.col("_i").cast("long").alias("i"), F.lit(1).alias("row"), F.lit(0).cast("long").alias("n")).alias("_at"))
    nothing = [F.lit(None).cast(free.schema[order].dataType).alias(order), F.lit(None).cast("bigint").alias("_turn")]
    marks = used.select(F.col("stem").alias("key"), *nothing, F.struct((F.col("n") - F.col("_j") + 1).cast("long").alias("i"), F.lit(0).alias("row"), F.col("n").cast("long").alias("n")).alias("_at"))
    both = rank_in(rows.unionByName(marks), "key", "_at", "_rank").where("_turn is not null")
    number = F.col("_at.i") + F.col("_rank") - F.col("_turn")
    return both.select("key", order, F.when(F.col("_at.i") == 0, F.col("key")).otherwise(F.concat_ws("_", "key", number.cast("string"))).alias("free_key"))


#: Rows that one bucket of a rank holds on average.
BUCKET_ROWS = 10_000


def rank_in(rows: DataFrame, group: str, order: str, out: str, buckets: int | None = None) -> DataFrame:
    """rows with their rank from 1 within a group, by `order`, which must tell a group's rows apart.

    The values of order are cut into ranges at sampled bounds; each range of each group is ranked by itself and lifted
    by the sizes of the ranges before it, so a group that holds a third of all rows is ranked by many tasks.
    """
    if buckets is None:
        rows = rows.checkpoint()
        buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    if buckets == 1:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("bigint"))
    placed = rows.repartitionByRange(buckets, order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0).cast("bigint")).alias("_before"))
    j = placed.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return j.withColumn(out, F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) + F.col("_before")).select(*rows.columns, out)


def append_positions(new_rows: DataFrame, rows: DataFrame, table: str, row_number: str, identity: str) -> DataFrame:
    """new_rows with the next free row numbers of their table, in order of identity."""
    last = rows.groupBy(table).agg(F.max(row_number).alias("_last"))
    ranked = rank_in(new_rows, table, identity, "_turn")
    return ranked.join(last, table, "left").withColumn(row_number, F.coalesce("_last", F.lit(0)) + F.col("_turn")).drop("_last", "_turn")
