"""Change notices as streams: bursts, repeats, order and publication. Every transformation also runs on batch frames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rowledger.operators import changes
from rowledger.sources import workbooks
from rowledger.sources.pointers import create_once, delete, newest_pointer


def notices(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Notices that land as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def debounce(found: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """(path, began, n, fingerprint): one row per burst of a path, with its last fingerprint; `gap` of silence ends it."""
    if found.isStreaming:
        found = found.withWatermark("ts", late)
    window = F.session_window("ts", gap).alias("w")
    return found.groupBy("path", window).agg(F.count("*").alias("n"), F.max_by("fingerprint", F.struct("ts", "seq")).alias("fingerprint")).select("path", F.col("w.start").alias("began"), "n", "fingerprint")


def suppress_self(found: DataFrame, written: DataFrame) -> DataFrame:
    """Without notices of what we wrote ourselves; a deletion (no fingerprint) always stays."""
    return found.join(written.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def newest(found: DataFrame, late: str | None = None) -> DataFrame:
    """(path, seq, fingerprint) of the highest sequence per path, whatever the order of arrival.

    On a stream a path's state lives as long as the stream, unless `late` bounds it: then the newest notice of each path
    and window of that length is given, once the watermark has passed it, and the state goes.
    """
    best = [F.max("seq").alias("seq"), F.max_by("fingerprint", "seq").alias("fingerprint")]
    if found.isStreaming and late:
        return found.withWatermark("ts", late).groupBy("path", F.window("ts", late).alias("w")).agg(*best).select("path", "seq", "fingerprint")
    return found.groupBy("path").agg(*best)


def triggers(found: DataFrame, every: str, late: str = "0 seconds") -> DataFrame:
    """(at, flags): trigger flags of a publication interval, combined by bitwise or."""
    if found.isStreaming:
        found = found.withWatermark("ts", late)
    return found.groupBy(F.window("ts", every).alias("w")).agg(F.bit_or("flag").alias("flags")).select(F.col("w.start").alias("at"), "flags")


def drop_repeats(found: DataFrame, late: str) -> DataFrame:
    """Without notices whose path and fingerprint were seen within the watermark."""
    return found.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "fingerprint"]) if found.isStreaming else found.dropDuplicates(["path", "fingerprint"])


def publish(found: DataFrame, checkpoint: str, commit: Callable[[DataFrame, int], None]):  # noqa: ANN201
    """One serial publication per batch; commit gets the batch's number and must do nothing for one it has seen."""
    return found.writeStream.foreachBatch(lambda df, n: None if df.isEmpty() else commit(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_triggers(points: DataFrame) -> DataFrame:
    """(path, point, flags) of each publication that took place: all flags since the one before it, those of refused and of
    deferred points among them.

    points (path, point, flag, hold, ok): flag bits that came for the point, edits that begin (+1) or end (-1) a batch, and
    whether the publication passes. A point takes place if it passes, no batch is open, and there is a flag to drain; what
    a point does not drain is put back for the next one.
    """
    order = Window.partitionBy("path").orderBy("point")
    open_ = F.sum("hold").over(order.rowsBetween(Window.unboundedPreceding, 0))
    able = points.withColumn("_able", F.col("ok") & (open_ <= 0))
    before = F.coalesce(F.sum(F.col("_able").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = able.withColumn("_run", before).groupBy("path", "_run").agg(F.max("point").alias("point"), F.bit_or("flag").alias("flags"), F.max("_able").alias("_able"))
    return runs.where("_able and flags <> 0").select("path", "point", "flags")


def whole_snapshots(rows: DataFrame, *by: str) -> DataFrame:
    """(by, seq, size, got) of the snapshots of which rows (by, seq, size, row_no) hold every row from 1 to size; rows that come
    twice count once, and row 0 only says how many there are."""
    got = F.count_distinct(F.when(F.col("row_no") > 0, F.col("row_no")))
    return rows.where("seq is not null").groupBy(*by, "seq").agg(F.max("size").alias("size"), got.alias("got")).where("got >= size")


def publication_order(rows: DataFrame) -> DataFrame:
    """(path, seq, at, published) of every snapshot that rows (path, seq, size, row_no, at) complete: at is the point at which its last row
    is there, and it is published unless a higher one of its path is whole by then."""
    first = rows.groupBy("path", "seq", "row_no").agg(F.max("size").alias("size"), F.min("at").alias("at"))
    done = whole_snapshots(first, "path").join(first.groupBy("path", "seq").agg(F.max("at").alias("at")), ["path", "seq"])
    until = Window.partitionBy("path").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    return done.select("path", "seq", "at", (F.col("seq") == F.max("seq").over(until)).alias("published"))


@dataclass(frozen=True)
class Outcome:
    """What a publication point did: nothing (no flag or candidate), open (no snapshot newer than the published one is whole), held (a batch of edits is
    open), refused, unchanged or published; and the flags that it drained."""

    status: str
    seq: int | None = None
    version: int = 0
    flags: int = 0


@dataclass(frozen=True)
class Publication:
    """Where and how candidates are published. check gives a row per fault of a whole snapshot."""

    root: str
    path: str
    key: str
    values: list[str]
    deps: str
    check: Callable[[DataFrame], DataFrame]


def keep_candidates(batch: DataFrame, number: int, root: str) -> None:
    """Put a batch of the stream into the inbox, once: a batch that is run again writes the same folder anew."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
    rows = batch
    if "size" not in batch.columns:  # without it the batch holds whole snapshots
        rows = batch.withColumn("size", F.lit(-1).cast("long")).withColumn("row_no", F.lit(0).cast("long"))
    for name in ("flag", "hold"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(1 if name == "flag" else 0))
    rows.withColumn("flag", F.col("flag").cast("long")).withColumn("hold", F.col("hold").cast("long")).write.mode("overwrite").parquet(f"{root}/inbox/query={query}/batch={number}")


def publish_pending(spark: SparkSession, p: Publication) -> Outcome:
    """One serial publication point over all that is in the inbox.

    The newest whole snapshot above the published seq is checked, compared with the published entries and committed with its events under
    the next version, if there are any. Older snapshots, and pieces of them that come later, are dropped. A fault, an open
    batch of edits, or a snapshot that is not whole yet leaves inbox and version as they are, so flags and rows are there at the next point,
    together with what has come by then. What was drained is kept as a pointer of its own, so that an unchanged snapshot
    makes no version and is not looked at again. Two publishers cannot both commit: the slower one gets CommitConflict.
    """
    inbox = workbooks.inbox(spark, f"{p.root}/inbox")
    if inbox is None:
        return Outcome("nothing")
    now, log = workbooks.newest_version(spark, p.root), newest_pointer(spark, f"{p.root}/drained")
    # A version that was committed before its pointer of what it drained could be written says the same itself.
    notes = max([x for x in (now.notes if now else None, log["notes"] if log else None) if x and "seq" in x], key=lambda x: int(x["point"]), default={"seq": "", "drained": "{}", "point": "0"})
    published, drained, point = int(notes["seq"]) if notes["seq"] else None, json.loads(notes["drained"]), int(notes["point"])
    version = now.number if now else 0
    fresh = F.col("batch") > F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in drained.items() for x in kv]), F.col("query")), F.lit(-1)) if drained else F.lit(True)
    sums = inbox.where(fresh).agg(F.bit_or("flag").alias("flags"), F.sum("hold").alias("held")).first()
    flags, held = sums.flags or 0, sums.held or 0
    if not flags:
        return Outcome("nothing", version=version)
    if held > 0:
        return Outcome("held", version=version, flags=flags)
    above = inbox.where(F.col("seq") > published) if published is not None else inbox
    seq = newest(whole_snapshots(above).select(F.lit("").alias("path"), "seq", F.lit("").alias("fingerprint"))).first()
    if seq is None:
        return Outcome("open", version=version, flags=flags)
    seq = seq.seq
    rows = above.where(F.col("seq") == seq)
    rows = rows.where("row_no > 0").dropDuplicates(["row_no"]) if rows.where("size < 0").isEmpty() else rows.join(F.broadcast(rows.agg(F.max(F.struct("batch", "query")).alias("_last"))), F.struct("batch", "query") == F.col("_last")).drop("_last")
    rows = rows.drop("seq", "size", "row_no", "flag", "hold", "query", "batch").checkpoint()
    if not p.check(rows).isEmpty():
        return Outcome("refused", seq, version, flags)
    state = now.frames["entries"] if now else rows.limit(0).withColumn("state", F.lit("")).withColumn("generation", F.lit(0).cast("bigint"))
    entries, events = changes.commit_snapshot(state, rows, p.path, p.key, p.values, p.deps)
    events = events.checkpoint()
    done = {r.query: r.batch for r in inbox.groupBy("query").agg(F.max("batch").alias("batch")).collect()}  # a row per stream
    note = {"seq": str(seq), "drained": json.dumps(drained | done), "point": str(point + 1), "flags": str(flags)}
    changed = not events.isEmpty()
    if changed:
        mark = spark.createDataFrame([(seq, version + 1, flags)], "number long, version long, flags long")
        workbooks.commit_workbooks({"entries": entries, "events": events, "batch": mark}, p.root, version + 1, expect=version, writer=f"seq={seq}", notes=note)
    create_once(spark, f"{p.root}/drained/point={point + 1}.json", {"number": point + 1, "writer": "", "notes": note, "paths": {}})
    # Batches that hold nothing newer have nothing left to say.
    old = inbox.groupBy("query", "batch").agg(F.max("seq").alias("seq")).where(F.coalesce(F.col("seq") <= seq, F.lit(True))).collect()  # a row per kept batch
    delete(spark, *[f"{p.root}/inbox/query={r.query}/batch={r.batch}" for r in old])
    delete(spark, f"{p.root}/drained/point={point}.json")
    return Outcome("published" if changed else "unchanged", seq, version + changed, flags)


def publish_snapshots(found: DataFrame, checkpoint: str, root: str, path: str, key: str, values: list[str], deps: str, check: Callable[[DataFrame], DataFrame]):  # noqa: ANN201
    """Publish a stream of candidate rows at one serial point: (seq, size, row_no, flag, hold, table_id, row_guid, path, key, values, deps).

    A snapshot is the rows 1 to size of its seq, however many batches they come in; row 0 carries no data and may announce
    the size. flag (absent: 1) holds trigger bits, hold begins (+1) or ends (-1) a batch of edits, during which nothing is
    published; rows that only carry these have no seq. Without a size column a batch holds all rows of its snapshots. What
    an earlier run left is tried first, so that a refused snapshot is published once its fault is mended, without a new
    notice. See publish_pending.
    """
    spark, p = found.sparkSession, Publication(root, path, key, values, deps, check)
    publish_pending(spark, p)

    def commit(batch: DataFrame, number: int) -> None:
        keep_candidates(batch, number, root)
        publish_pending(batch.sparkSession, p)

    return found.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
