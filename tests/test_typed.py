"""Small cases of typed cells, keys, plans, releases, versions and streams."""

import pytest
from pyspark.sql import functions as F

from rowledger import typed_queries as queries
from rowledger.catalog import Catalog, Field, Table
from rowledger.functions import cells
from rowledger.operators import changes, graph, identity, intake, migration, release
from rowledger.registry import Format
from rowledger.sources import workbooks
from rowledger.streaming import changes as stream


def texts(spark, *x):
    return spark.createDataFrame([(v,) for v in x], "x string")


def test_plan_matches_and_casts_each_cell_once(spark):
    """Twenty cells a row: as many pattern matches as cells, whatever is selected of them."""
    rows = spark.createDataFrame([tuple(str(i) for i in range(20))], ", ".join(f"c{i} string" for i in range(20)))
    fields = {f"p{i}": (F.col(f"c{i}"), None, Field(i + 1, f"c{i}", "int64", min=0, max=9, default="3", required=i % 2 == 0)) for i in range(20)}
    parsed = cells.parse_columns(rows, fields)
    out = parsed.select(*[F.col(f"p{i}.{n}").alias(f"{n}{i}") for i in range(20) for n in ("state", "text", "error")], F.to_json("p3"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") <= 20 and plan.count("as bigint") <= 20
    assert out.first().state3 == "Value" and out.first().state12 == "Invalid" and out.first().error12 == "cell.max"


def test_cell_by_expression_and_by_columns_agree(spark):
    values = ["", None, "~", "%7e", " 5 ", "+5", "-1", "x", "44", "46", "9" * 30, "1.5"]
    rows = texts(spark, *values).withColumn("f", F.when(F.col("x") == "44", "A1").when(F.col("x") == "", "B1"))
    for field in (Field(1, "n", "int64", min=0, max=45, default="7"), Field(2, "s", required=True), Field(3, "d", "double"), Field(4, "b", "bool"), Field(5, "e", "string", enum=(("x", 1),), regex="^[x1~]")):
        one = rows.select(cells.parse_cell(F.col("x"), F.col("f"), field).alias("c")).collect()
        two = cells.parse_columns(rows, {"c": (F.col("x"), F.col("f"), field)}).collect()
        assert [tuple(r.c) for r in one] == [tuple(r.c)[:5] for r in two]


def test_double_texts(spark):
    want = {"1": "1", "1e9": "1000000000", "1e21": "1E+21", "1e15": "1E+15", "123456789012345.6": "123456789012345.6", "0.0001": "0.0001", "0.00001": "1E-05", "-2.50": "-2.5", "101e20": "1.01E+22", "2e-3": "0.002", "1e400": None, "NaN": None, "0.1": "0.1", "1.7976931348623157e308": "1.7976931348623157E+308"}
    got = texts(spark, *want).select("x", cells.canonicalize(F.col("x"), "double").alias("d")).collect()
    assert {r.x: r.d for r in got} == want


def test_unsigned_and_narrow_integers(spark):
    got = texts(spark, "18446744073709551615", "18446744073709551616", "4294967296", "-1", "2147483648").select(*[cells.canonicalize(F.col("x"), k).alias(k) for k in ("uint64", "uint32", "int32", "fixed32")]).collect()
    assert [tuple(r) for r in got] == [("18446744073709551615", None, None, None), (None,) * 4, ("4294967296", None, None, None), (None, None, "-1", None), ("2147483648", "2147483648", None, "2147483648")]


def test_keys_in_utf16_units(spark):
    parts = [("a|b", "\u6d93", "42"), ("\U0001f600", "", "x"), ("e\u0301", ":", "1:a")]
    rows = spark.createDataFrame(parts, "a string, b string, c string").select(cells.encode_key(F.col("a"), F.col("b"), F.col("c")).alias("k"))
    got = rows.select("k", cells.decode_key(F.col("k")).alias("p"), cells.key_ref(F.lit(3), F.col("k")).alias("t")).collect()
    assert [tuple(r.p) for r in got] == parts and got[1].k.startswith("2:") and got[1].t is None and got[0].t == "3:a%7Cb|%E6%B6%93|42"
    bad = texts(spark, "03:bad", "3:ab", "1:a|", "1:\U0001f600", "", "1:a1:b", "x").select(cells.decode_key(F.col("x")).alias("p")).collect()
    assert all(r.p is None for r in bad)


def test_map_parts_hold_both_separators(spark):
    m = spark.range(1).select(F.create_map(F.lit("a=b"), F.lit("1;2"), F.lit("c"), F.lit("=")).alias("m"))
    written = m.select(cells.write_join_map(F.col("m"), ";", "=").alias("w"))
    assert written.select(cells.parse_join_map(F.col("w"), ";", "=").alias("m")).first().m == {"a=b": "1;2", "c": "="}


def test_ten_steps_are_one_pass(spark):
    """The plan of a migration has as many shuffles and joins for ten steps as for one."""
    rows = spark.createDataFrame([("w", 5, f"r{i}", "f0", "Value", str(i)) for i in range(4)] + [("w", 5, "r9", "f0", "Invalid", None)], "workbook_id string, table_id int, row_guid string, field_path string, state string, text string")
    steps = [migration.Step(i + 1, f"s{i}", 5, f"f{i}", f"f{i + 1}", lambda x: F.concat(x, F.lit("+"))) for i in range(10)]
    one, ten = (migration.outcomes(rows, s)._jdf.queryExecution().executedPlan().toString() for s in (steps[:1], steps))
    assert one.count("Exchange") == ten.count("Exchange") and ten.count("Join") == 0
    got = {(r.row_guid, r.step): (r.outcome, r.value) for r in migration.outcomes(rows, steps).collect()}
    assert got["r2", "s9"] == ("Converted", "2" + "+" * 10) and got["r9", "s0"][0] == "Error" and ("r9", "s1") not in got
    after = migration.apply(rows.where("state = 'Value'"), migration.outcomes(rows.where("state = 'Value'"), steps))
    assert after.count() == 44 and migration.apply(after, migration.outcomes(after, steps)).exceptAll(after).isEmpty()


def test_steps_and_plans_are_checked():
    step = migration.Step(1, "a", 5, "x", "y", lambda c: c)
    old, new = {(5, "x")}, {(5, "x"), (5, "y")}
    assert migration.check_steps([step], old, new) == []
    bad = [migration.Step(0, "b", 5, "q", "x", None, overwrite=True), step, step]
    assert [c for c, _ in migration.check_steps(bad, old, new)] == ["step.number", "step.source", "step.target", "step.unregistered", "step.overwrite", "step.repeated"]
    assert migration.plan_hash([step], "o", "n") != migration.plan_hash([step], "o", "m") and len(migration.plan_hash([], "", "")) == 64


def test_plans_apply_once_and_only_if_intact(spark):
    books = spark.createDataFrame([("w", "old", [], 3), ("v", "new", ["a@1"], 1)], "workbook_id string, schema_hash string, markers array<string>, revision long")
    step = migration.Step(1, "a", 5, "x", "y", lambda c: c)
    states = migration.workbook_states(books, [step], "old", "new")
    found = spark.createDataFrame([("Converted",)], "outcome string")
    got = {r.workbook_id: (r.schema_hash, r.markers, r.revision) for r in migration.migrated_workbooks(books, states, found, [step], "new").collect()}
    assert got == {"w": ("new", ["a@1"], 4), "v": ("new", ["a@1"], 1)}
    bad = spark.createDataFrame([("Error",)], "outcome string")
    assert {r.revision for r in migration.migrated_workbooks(books, states, bad, [step], "new").collect()} == {3, 1}
    rows = spark.createDataFrame([("w", 5, "r", "x", "Value", "1")], "workbook_id string, table_id int, row_guid string, field_path string, state string, text string")
    plan = books.select("workbook_id", "revision")
    out, errors = migration.apply_checked(rows, migration.outcomes(rows, [step]), plan, plan, [step], states=states, intact=False)
    assert out.count() == 1 and {r.code for r in errors.collect()} == {"plan.hash"}


def test_release_refuses_what_is_not_whole(spark):
    kind = "table_id int, row_guid string, key string, path string, field int, value string"
    rows = spark.createDataFrame([(1, "g", "k1", "p", 1, "v"), (1, "g", "k2", "p", 2, "v"), (1, "", "k3", "p", 1, "v"), (1, "h", "", "p", 1, "v"), (1, "h", "", "p", 1, "w")], kind)
    edges = spark.createDataFrame([(1, "g"), (2, "g"), (1, "x")], "dst_table int, dst_guid string")
    got = {r.code: r.n for r in release.validate(rows, edges, "0000", spark.createDataFrame([(1,), (2,), (3,)], "severity int")).collect()}
    assert got == {"release.no_identity": 1, "release.no_key": 1, "release.duplicate_identity": 1, "release.duplicate_key": 0, "release.duplicate_field": 1, "release.dangling": 2, "release.no_schema": 1, "release.findings": 2}


def test_target_fields_below_structs():
    t = Table(1, "t", (Field(1, "a", targets=("server",)), Field(2, "a.b"), Field(3, "c"), Field(4, "c.d", targets=("client",))))
    assert [f for _, _, f, _ in release.target_fields(Catalog((t,)), "client")] == ["c", "c.d"]


def test_versions_are_never_overwritten(spark, tmp_path):
    root = str(tmp_path / "v")
    spark.range(9).write.parquet(f"{root}/data/version=1")  # an attempt that died before its pointer
    first = workbooks.publish(spark.range(3), root, 1)
    assert first != f"{root}/data/version=1" and workbooks.publish(spark.range(7), root, 1) == first and workbooks.current(spark, root).count() == 3
    assert spark.read.parquet(f"{root}/data/version=1").count() == 9
    workbooks.commit_workbooks({"a": spark.range(2), "b": spark.range(4)}, root, 2)
    assert {k: v.count() for k, v in workbooks.current_workbooks(spark, root).items()} == {"a": 2, "b": 4}


def test_source_info(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"1")
    (tmp_path / "b.xlsx").write_bytes(b"2")
    one = workbooks.source_info(spark, str(tmp_path / "*.xlsx")).first()
    (tmp_path / "b.xlsx").write_bytes(b"3")
    two = workbooks.source_info(spark, str(tmp_path / "*.xlsx")).first()
    assert (one.files, two.files) == (2, 2) and one.content_hash != two.content_hash


def test_identities_wait_for_blockers(spark):
    kind = "row_no int, table_id int, status string, row_guid string, severity int"
    good = spark.createDataFrame([(1, 1, "PendingNew", None, 0), (2, 1, "Retained", "x", 0)], kind)
    bad = good.union(spark.createDataFrame([(3, 1, "Invalid", None, 3)], kind))
    fresh, blockers = identity.assign_identities(good)
    assert fresh.count() == 1 and blockers.isEmpty()
    fresh, blockers = identity.assign_identities(bad)
    assert fresh.isEmpty() and [tuple(r) for r in blockers.collect()] == [(3, "identity.invalid")]
    before = spark.createDataFrame([(1, "a"), (2, "b")], "row_no int, hash string")
    after = spark.createDataFrame([(1, "a"), (2, "c")], "row_no int, hash string")
    assert [r.row_no for r in identity.changed_business(before, after).collect()] == [2]


def test_ranks_spread_over_ranges(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 7919 % 1000) for i in range(1000)], "g string, k int")
    got = identity.rank_in(rows, "g", "k", "r", buckets=7).collect()
    for g in "ab":
        mine = sorted((r.k, r.r) for r in got if r.g == g)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))


def test_moves_stop_at_any_error_and_names_swap(spark):
    rows = spark.createDataFrame([(3, "g1", "1:a", "w/t/a", False), (3, "g2", "1:b", "w/t/b", False), (6, "g3", "1:o", "w/o/o", False)], "table_id int, row_guid string, key string, path string, dirty boolean")
    edges = spark.createDataFrame([("g3", "p", "3:a", "g1"), ("g2", "q", "3:b", "g2")], "src_guid string, property_path string, token string, dst_guid string")
    swap = spark.createDataFrame([("w/t/a", "w/t/b", "1:b"), ("w/t/b", "w/t/a", "1:a")], "path string, new_path string, new_key string")
    out, refs, errors = identity.move_rows(rows, swap, edges)
    assert errors.isEmpty() and {r.row_guid: (r.key, r.path, r.dirty) for r in out.collect()} == {"g1": ("1:b", "w/t/b", True), "g2": ("1:a", "w/t/a", True), "g3": ("1:o", "w/o/o", True)}
    assert sorted((r.src_guid, r.token) for r in refs.collect()) == [("g2", "3:a"), ("g3", "3:b")]
    bad = swap.union(spark.createDataFrame([("w/t/q", "w/t/z", "1:z")], swap.schema))
    out, refs, errors = identity.move_rows(rows, bad, edges)
    assert [tuple(r) for r in errors.collect()] == [("w/t/q", "move.no_source")] and not any(r.dirty for r in out.collect()) and not any(r.rewritten for r in refs.collect())
    out, _, errors = identity.rename_rows(rows, spark.createDataFrame([("w/t/a", "1:c")], "path string, new_key string"), edges)
    assert errors.isEmpty() and {r.row_guid: r.path for r in out.collect()}["g1"] == "w/t/1:c"


def test_intake_unites_tables_and_formats(spark):
    table = Table(1, "s", (Field(1, "id", "int64", key_order=1), Field(2, "v", format="hash", legacy=("bare",))))
    formats = {"hash": Format(lambda x: F.when(x.startswith("#"), F.substr(x, F.lit(2))), lambda x: x), "bare": Format(lambda x: F.when(x.rlike("^[a-z]+$"), x), lambda x: x)}
    cell = lambda t: {"text": t, "formula": None}
    rows = [("w", "s", i, "", None, {"id": cell(str(i)), "v": cell(v)}) for i, v in enumerate(["#x", "y", "?", "~", ""])]
    parsed = intake.parse_tables(spark.createDataFrame(rows, workbooks.STAGING), Catalog((table,)), formats)
    got = {r.row_number: r for r in parsed.collect()}
    assert [(got[i]["values"][1].text, got[i]["values"][1].legacy, got[i].indexable) for i in range(5)] == [("x", False, True), ("y", True, True), (None, False, False), (None, False, True), (None, False, True)]
    assert [tuple(r)[4:] for r in intake.findings_of(parsed).collect()] == [("v", "cell.unparseable", 2)]
    assert intake.values_of(parsed).count() == 10 and "values" not in intake.rows_of(parsed).columns
    assert intake.concat_workbooks([spark.range(2).select("id"), spark.range(1).withColumn("x", F.lit(1))]).count() == 3


def test_deep_closures(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "src string, dst string")
    assert graph.dependencies(edges, texts(spark, "n3").toDF("node")).count() == 38


def candidates(spark, seq, rows):
    return spark.createDataFrame([(seq, 1, g, f"t/{k}", k, v, "") for g, k, v in rows], "seq long, table_id int, row_guid string, path string, key string, value string, deps string")


def test_stream_publishes_checked_versions(spark, tmp_path):
    """Validate, compare, commit, tell: a faulty batch keeps the old version, an unchanged one tells nothing."""
    source, root, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = candidates(spark, 1, []).schema
    faults = lambda df: df.groupBy("key").count().where("count > 1")

    def run(seq, rows):
        candidates(spark, seq, rows).coalesce(1).write.mode("append").parquet(source)
        stream.publish_snapshots(stream.notices(spark, source, schema), ck, root, "path", "key", ["value"], "deps", faults).awaitTermination()
        now = workbooks.current_workbooks(spark, root)
        return now["batch"].first().version, sorted((r.row_guid, r.kind) for r in now["events"].collect()), sorted((r.row_guid, r.state, r.generation) for r in now["entries"].collect())

    assert run(1, [("a", "k", "1"), ("b", "l", "2")]) == (1, [("a", "Added"), ("b", "Added")], [("a", "Resident", 1), ("b", "Resident", 1)])
    assert run(2, [("a", "m", "1")]) == (2, [("a", "Moved"), ("a", "Renamed"), ("b", "Removed")], [("a", "Resident", 1), ("b", "Missing", 1)])
    assert run(3, [("a", "m", "1"), ("c", "m", "2")])[0] == 2
    assert run(4, [("a", "m", "1")])[0] == 2
    assert run(5, [("a", "m", "1"), ("b", "l", "9")]) == (3, [("b", "Added")], [("a", "Resident", 1), ("b", "Resident", 1)])


@pytest.mark.parametrize("name", ["suppress", "newest", "triggers", "repeats"])
def test_notices_on_a_stream_as_on_a_batch(spark, tmp_path, name):
    rows = [(f"p{i % 3}", i * 3600 * 5, i, None if i % 7 == 0 else f"f{i % 4}", 1 << i % 3) for i in range(40)]
    batch = spark.createDataFrame(rows, "path string, s long, seq long, fingerprint string, flag int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source = str(tmp_path / "in")
    batch.repartition(3).write.parquet(source)
    written = spark.createDataFrame([("p0", "f1")], "path string, fingerprint string")
    steps = {
        "suppress": (lambda df: stream.suppress_self(df, written).select("path", "seq"), "append"),
        "newest": (lambda df: stream.newest(df), "complete"),
        "triggers": (lambda df: stream.triggers(df, "1 day", "100 days"), "complete"),
        "repeats": (lambda df: stream.drop_repeats(df, "1000 days").select("path", "fingerprint"), "append"),
    }
    f, mode = steps[name]
    out = f(stream.notices(spark, source, batch.schema)).writeStream.format("memory").queryName(f"n_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(map(tuple, spark.table(f"n_{name}").collect()), key=repr) == sorted(map(tuple, f(batch).collect()), key=repr)


def test_snapshot_of_nothing(spark):
    prev, _ = queries.snapshots(spark, "/root/testdata/sf0.001")
    entries, events = changes.commit_snapshot(prev.limit(0), prev.drop("state", "generation").limit(0), "path", "name", ["nation"], "seg")
    assert entries.isEmpty() and events.isEmpty()
