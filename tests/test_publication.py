"""Snapshots from a stream: order, wholeness, refusals, batches of edits; and commits of which one wins."""

import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rowledger.sources import pointers, workbooks
from rowledger.streaming import changes as stream

KIND = "seq long, size long, row_no long, flag int, hold int, table_id int, row_guid string, path string, key string, value string, deps string"


def piece(spark, seq, size, rows, flag=1):
    return spark.createDataFrame([(seq, size, n, flag, 0, 1, g, f"t/{k}", k, v, "") for n, g, k, v in rows], KIND)


def mark(spark, flag=0, hold=0, seq=None, size=None):
    return spark.createDataFrame([(seq, size, 0, flag, hold, *[None] * 6)], KIND)


class Shop:
    """A stream over a folder, run until what is there is taken."""

    def __init__(self, spark, tmp_path, check=None):
        self.spark, self.source, self.root, self.ck = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
        self.check = check or (lambda df: df.groupBy("key").count().where("count > 1"))
        self.schema = mark(spark).schema
        os.makedirs(self.source)

    def run(self, *frames):
        for f in frames:
            f.coalesce(1).write.mode("append").parquet(self.source)
        stream.publish_snapshots(stream.notices(self.spark, self.source, self.schema), self.ck, self.root, "path", "key", ["value"], "deps", self.check).awaitTermination()
        now = workbooks.newest_version(self.spark, self.root)
        return (now.number, now.frames["batch"].first().number, {r.row_guid: r.value for r in now.frames["entries"].where("state = 'Resident'").collect()}) if now else None


def test_an_older_snapshot_never_replaces_a_newer_one(spark, tmp_path):
    shop = Shop(spark, tmp_path)
    assert shop.run(piece(spark, 5, 1, [(1, "a", "k", "new")])) == (1, 5, {"a": "new"})
    assert shop.run(piece(spark, 3, 1, [(1, "a", "k", "old")])) == (1, 5, {"a": "new"})
    assert shop.run(piece(spark, 6, 1, [(1, "a", "k", "newest")])) == (2, 6, {"a": "newest"})


def test_a_snapshot_in_two_pieces_is_published_when_it_is_whole(spark, tmp_path):
    shop = Shop(spark, tmp_path)
    shop.run(piece(spark, 6, 2, [(1, "a", "k", "0"), (2, "b", "l", "0")]))
    assert shop.run(piece(spark, 7, 2, [(1, "a", "k", "1")])) == (1, 6, {"a": "0", "b": "0"})
    assert shop.run(piece(spark, 7, 2, [(1, "a", "k", "1")])) == (1, 6, {"a": "0", "b": "0"})  # sent again
    assert shop.run(piece(spark, 7, 2, [(2, "b", "l", "1")])) == (2, 7, {"a": "1", "b": "1"})
    kinds = {(r.row_guid, r.kind) for r in workbooks.current_workbooks(spark, shop.root)["events"].collect()}
    assert kinds == {("a", "PropertyChanged"), ("b", "PropertyChanged")}


def test_a_later_whole_snapshot_overtakes_an_open_one(spark, tmp_path):
    shop = Shop(spark, tmp_path)
    assert shop.run(piece(spark, 1, 2, [(1, "a", "k", "1")])) is None
    assert shop.run(piece(spark, 2, 1, [(1, "a", "k", "2")])) == (1, 2, {"a": "2"})
    assert shop.run(piece(spark, 1, 2, [(2, "b", "l", "1")])) == (1, 2, {"a": "2"})
    assert shop.run(mark(spark, flag=1, seq=3, size=0)) == (2, 3, {})  # an empty snapshot is whole when it is announced


def test_a_refused_snapshot_is_published_once_its_fault_is_mended(spark, tmp_path):
    good = []
    shop = Shop(spark, tmp_path, lambda df: df.where(F.lit(not good) & (F.col("value") == "bad")))
    shop.run(piece(spark, 1, 1, [(1, "a", "k", "1")]))
    assert shop.run(piece(spark, 2, 1, [(1, "a", "k", "bad")], flag=4)) == (1, 1, {"a": "1"})
    assert shop.run(mark(spark, flag=2)) == (1, 1, {"a": "1"})
    good.append(True)
    assert shop.run() == (2, 2, {"a": "bad"})  # no new notice
    assert workbooks.current_workbooks(spark, shop.root)["batch"].first().flags == 6  # all that was put back
    p = stream.Publication(shop.root, "path", "key", ["value"], "deps", shop.check)
    assert stream.publish_pending(spark, p).status == "nothing" and not os.listdir(f"{shop.root}/inbox/" + os.listdir(f"{shop.root}/inbox")[0])


def test_edits_in_a_batch_are_published_at_its_end(spark, tmp_path):
    shop = Shop(spark, tmp_path)
    assert shop.run(mark(spark, hold=1), mark(spark, hold=1), piece(spark, 1, 1, [(1, "a", "k", "1")])) is None
    assert shop.run(mark(spark, hold=-1), piece(spark, 2, 1, [(1, "a", "k", "2")])) is None
    assert shop.run(mark(spark, hold=-1)) == (1, 2, {"a": "2"})


def test_an_unchanged_snapshot_makes_no_version_and_is_done(spark, tmp_path):
    shop = Shop(spark, tmp_path)
    shop.run(piece(spark, 1, 1, [(1, "a", "k", "1")]))
    assert shop.run(piece(spark, 4, 1, [(1, "a", "k", "1")])) == (1, 1, {"a": "1"})
    assert shop.run(piece(spark, 3, 1, [(1, "a", "k", "x")])) == (1, 1, {"a": "1"})


def test_a_failure_before_the_commit_loses_nothing(spark, tmp_path, monkeypatch):
    shop = Shop(spark, tmp_path)
    real = workbooks.commit_workbooks
    monkeypatch.setattr(workbooks, "commit_workbooks", lambda *a, **b: 1 / 0)
    with pytest.raises(Exception, match="division"):
        shop.run(piece(spark, 1, 1, [(1, "a", "k", "1")]))
    monkeypatch.setattr(workbooks, "commit_workbooks", real)
    assert shop.run() == (1, 1, {"a": "1"})


def test_a_failure_behind_the_commit_publishes_once(spark, tmp_path, monkeypatch):
    shop = Shop(spark, tmp_path)
    monkeypatch.setattr(stream, "create_once", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        shop.run(piece(spark, 1, 1, [(1, "a", "k", "1")]))
    monkeypatch.undo()
    assert shop.run() == (1, 1, {"a": "1"})
    assert shop.run(piece(spark, 2, 1, [(1, "a", "k", "2")])) == (2, 2, {"a": "2"})


def test_drained_triggers(spark):
    rows = [("p", 1, 1, 0, True), ("p", 2, 2, 0, False), ("p", 3, 4, 0, True), ("p", 4, 8, 1, True), ("p", 5, 1, -1, True), ("p", 6, 0, 0, True), ("q", 1, 2, 0, False)]
    got = stream.drain_triggers(spark.createDataFrame(rows, "path string, point int, flag int, hold int, ok boolean")).collect()
    assert sorted(map(tuple, got)) == [("p", 1, 1), ("p", 3, 6), ("p", 5, 9)]


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    root, gate = str(tmp_path / "v"), threading.Barrier(2, timeout=60)
    workbooks.publish(spark.range(1), root, 1)
    real = workbooks._write_once

    def write(df, path, partition_by=None):
        out = real(df, path, partition_by)
        gate.wait()  # both have checked and written before either commits
        return out

    def commit(n):
        try:
            return workbooks.commit_workbooks({"": spark.range(n)}, root, 2, expect=1, writer=f"w{n}")
        except pointers.CommitConflict:
            return None

    workbooks._write_once = write
    try:
        with ThreadPoolExecutor(2) as pool:
            made = list(pool.map(commit, (10, 20)))
    finally:
        workbooks._write_once = real
    assert sum(m is not None for m in made) == 1
    won = 10 if made[0] else 20
    assert workbooks.current(spark, root).count() == won and len([f for f in os.listdir(f"{root}/data") if f.startswith("version=2")]) == 1
    assert workbooks.commit_workbooks({"": spark.range(5)}, root, 2, expect=1, writer=f"w{won}") == made[won == 20]  # its own, run again
    with pytest.raises(pointers.CommitConflict):
        workbooks.commit_workbooks({"": spark.range(5)}, root, 3, expect=1)
    with pytest.raises(pointers.CommitConflict):
        workbooks.commit_workbooks({"": spark.range(5)}, root, 2, expect=2, writer="other")


def test_pointers_elsewhere_than_on_a_local_disk(spark, tmp_path):
    """viewfs stands for a store with a name server: the way without hard links."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pointers.link./p", f"file://{tmp_path}")
    at = "viewfs://pointers/p/pointer/version=1.json"
    assert pointers.create_once(spark, at, {"number": 1}) and not pointers.create_once(spark, at, {"number": 2})
    assert pointers.newest_pointer(spark, "viewfs://pointers/p/pointer")["number"] == 1 and len([f for f in os.listdir(tmp_path / "pointer") if f[0] != "."]) == 1


KIND_RELEASE = "table_id int, row_guid string, key string, path string, field int, value string"


def release_rows(spark, n=400):
    return spark.createDataFrame([(1 + i % 2, f"{i * 7919 % 65536:04x}{i:028x}", f"k{i}", f"t/k{i}", f, str(i * f)) for i in range(n) for f in (1, 2)], KIND_RELEASE)


def test_an_unchanged_release_is_opened_by_its_tree_alone(spark, tmp_path):
    root = str(tmp_path / "r")
    workbooks.write_release(release_rows(spark), root, 1, "client", "h")
    assert workbooks.open_release(spark, root, "client", "h")[1] == [] and workbooks.open_release(spark, root, "client", "h", whole=True)[1] == []
    data = next(p for p in (tmp_path / "r/data/version=1/table_id=1").iterdir() if p.suffix == ".parquet")
    held, then = data.read_bytes(), data.stat()
    # Rows of another table under the same length and time: only a reader of the file can tell.
    other = next(p for p in (tmp_path / "r/data/version=1/table_id=2").iterdir() if p.suffix == ".parquet").read_bytes()
    data.write_bytes((other + b"\0" * len(held))[: len(held)])
    for crc in tmp_path.rglob("*.crc"):
        crc.unlink()
    os.utime(data, ns=(then.st_atime_ns, then.st_mtime_ns))
    assert workbooks.open_release(spark, root, "client", "h")[1] == []
    data.write_bytes(held)
    assert workbooks.open_release(spark, root, "client", "h")[1] == []  # another time, the same content


def test_a_changed_file_is_found_by_its_prefixes(spark, tmp_path, monkeypatch):
    from rowledger.operators import release

    monkeypatch.setattr(release, "LEAF_ROWS", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        root = str(tmp_path / "r")
        workbooks.write_release(release_rows(spark), root, 1, "client", "h")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [p for p in (tmp_path / "r/data/version=1/table_id=1").iterdir() if p.suffix == ".parquet"]
    assert len(files) > 2
    one = spark.read.parquet(str(files[0]))
    rows = one.withColumn("value", F.when(F.col("field") == 1, "x").otherwise(F.col("value"))).collect()
    want = {r.row_guid[:2] for r in rows}
    changed = spark.createDataFrame(rows, one.schema).coalesce(1)
    files[0].unlink()
    changed.write.parquet(str(tmp_path / "new"))
    next(p for p in (tmp_path / "new").iterdir() if p.suffix == ".parquet").rename(files[0].with_name("part-x.parquet"))
    bad = {(r.table_id, r.prefix[:2]) for r in workbooks.damaged_leaves(spark, root).collect()}
    assert bad == {(1, p) for p in want} and workbooks.open_release(spark, root, "client", "h")[1] == ["release.content_hash"]
    rest = spark.read.parquet(f"{root}/data/tree=1").count()
    assert len(workbooks.damaged_leaves(spark, root, whole=True).collect()) < rest


def test_a_release_with_an_unresolved_reference_leaves_no_manifest(spark, tmp_path):
    from rowledger import typed_queries as queries
    from rowledger.operators import release

    d, root = "/root/testdata/sf0.001", str(tmp_path / "r")
    rows, values = queries.shop(spark, d)
    # One customer that an order refers to is not indexable.
    one = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 9 <> 0").agg(F.min("o_custkey")).first()[0]
    most = rows.withColumn("indexable", ~((F.col("table_id") == 3) & (F.col("key") == f"{len(str(one))}:{one}")))
    records, edges, blockers = release.assemble(most, values, queries.SHOP, "client")
    with pytest.raises(ValueError, match="release.blockers"):
        workbooks.write_release(records, root, 1, "client", "01", edges, blockers=blockers)
    assert workbooks.open_release(spark, root, "client", "01") == (None, ["release.missing"]) and not os.path.exists(f"{root}/manifest")
    records, edges, blockers = release.assemble(rows.withColumn("indexable", F.lit(True)), values, queries.SHOP, "client")
    workbooks.write_release(records, root, 1, "client", "01", edges, blockers=blockers)
    found, codes = workbooks.open_release(spark, root, "client", "01")
    assert codes == [] and found.count() == records.count()
    lost = edges.limit(1).union(edges.limit(1).withColumn("dst_guid", F.lit("f" * 32)))
    with pytest.raises(ValueError, match="release.dangling"):
        workbooks.write_release(records, root, 2, "client", "01", lost)
    with pytest.raises(ValueError, match="release.no_schema"):
        workbooks.write_release(records, root, 2, "client", "00", edges)


def test_index_finds_what_validate_finds(spark):
    from rowledger.operators import release

    rows = spark.createDataFrame([(1, "g", "k1", "p", 1, "v"), (1, "g", "k2", "p", 2, "v"), (1, "h", "", "p", 1, "v"), (1, "h", None, "p", 1, "w"), (2, "i", "z", "p", 1, "v"), (2, "j", "z", "p", 1, "v"), (1, "", "q", "p", 1, "v")], KIND_RELEASE)
    edges = spark.createDataFrame([(1, "g"), (2, "g")], "dst_table int, dst_guid string")
    got = {r.code: r.n for r in release.index_faults(release.row_index(rows), edges).collect()}
    assert got == {"release.no_key": 1, "release.duplicate_identity": 1, "release.duplicate_field": 1, "release.duplicate_key": 1, "release.dangling": 1}


def test_a_release_of_nothing(spark, tmp_path):
    root = str(tmp_path / "r")
    workbooks.write_release(release_rows(spark).limit(0), root, 1, "client", "h")
    assert "release.corrupt" in workbooks.open_release(spark, root, "client", "h")[1]
