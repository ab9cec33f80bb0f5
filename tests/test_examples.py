"""Small cases by hand."""

import zipfile

import pytest
from pyspark.sql import functions as F

from rowledger.catalog import Field
from rowledger.functions import cells
from rowledger.operators import drafts, graph, identity, lookups, merge, migration, project, publication, release
from rowledger.registry import Extensions, random_guid, register_family
from rowledger.sources import workbooks
from rowledger.streaming import changes as stream


def test_cell_states(spark):
    rows = [("", None), ("", "A1"), ("5", "A1"), ("~", None), ("x", None), ("+07", None), (" 12 ", None), ("99", None)]
    f = Field(1, "n", "int32", default="7", max=50)
    got = spark.createDataFrame(rows, "text string, formula string").select(cells.parse_cell(F.col("text"), F.col("formula"), f).alias("c")).select("c.*").collect()
    assert [r.state for r in got] == ["Defaulted", "Invalid", "Value", "Null", "Invalid", "Value", "Value", "Invalid"]
    assert [r.text for r in got] == ["7", None, "5", None, None, "7", "12", None]
    assert got[2].raw_text == "=A1" and got[7].error == "cell.max" and got[1].error == "cell.formula_without_value"


def test_literal_tilde_and_types(spark):
    one = spark.range(1)
    c = cells.parse_cell(F.lit("%7e"), F.lit(None).cast("string"), Field(1, "s"))
    assert one.select(c.alias("c")).select("c.text").first()[0] == "~"
    kinds = {"uint64": ("18446744073709551615", "18446744073709551616"), "uint32": ("4294967295", "-1"), "int32": ("-2147483648", "1.5"), "bool": ("TRUE", "yes"), "double": ("1e3", "NaN")}
    for kind, (good, bad) in kinds.items():
        a, b = one.select(cells.canonicalize(F.lit(good), kind), cells.canonicalize(F.lit(bad), kind)).first()
        assert a is not None and b is None, kind


def test_delimited_round_trip(spark):
    values = [["a", "", ' b"c', "d,e", "f"], [], ["x"]]
    df = spark.createDataFrame([(v,) for v in values], "v array<string>").withColumn("t", cells.write_join_list(F.col("v"), ","))
    assert [r[0] for r in df.select(cells.parse_join_list(F.col("t"), ",", "string")).collect()] == values
    assert spark.range(1).select(cells.parse_join_list(F.lit('a,"b'), ",", "string")).first()[0] is None
    assert spark.range(1).select(cells.parse_join_map(F.lit("a=1;a=2"), ";", "=")).first()[0] is None


def test_reference_grammar(spark):
    tokens = ["3:a|b%20c", "03:a", "3:", "3:a||b", "3:a%", "3:%FF", "3:a+b", "3:a%2f", "2147483647:%c3%a9", "2147483648:a", "0:a", "1:%ff", "1:\u4e2d"]
    got = spark.createDataFrame([(x,) for x in tokens], "t string").select(cells.parse_ref(F.col("t")).alias("r")).collect()
    assert [r.r is not None for r in got] == [True, False, False, False, False, False, False, True, True, False, False, False, False]
    assert got[0].r.parts == ["a", "b c"]


def test_merge_laws(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, name string, n int")
    theirs = spark.createDataFrame([(1, "A", 1), (3, None, 4), (9, "z", 9)], "id int, name string, n int")
    rows = lambda df: sorted((r.id, r.name, r.n) for r in df.where("kept <> 'gone'").collect())
    same = merge.three_way_merge(base, theirs, base, "id", ["name", "n"])
    assert rows(same) == [(1, "A", 1), (3, None, 4), (9, "z", 9)] and same.where("conflict is not null").isEmpty()
    other = merge.three_way_merge(base, base, theirs, "id", ["name", "n"])
    assert rows(other) == [(1, "A", 1), (3, None, 4), (9, "z", 9)] and other.where("conflict is not null").isEmpty()
    mine = spark.createDataFrame([(1, "a", 8), (2, "b", 2), (3, None, 5)], "id int, name string, n int")
    got = {r.id: r for r in merge.three_way_merge(base, theirs, mine, "id", ["name", "n"]).collect()}
    assert (got[1].name, got[1].n, got[1].conflict) == ("A", 8, None)
    assert got[3].conflict == "Field" and got[3].conflicts == ["n"] and got[3].n == 4


def test_closures_end_on_cycles(spark):
    e = spark.createDataFrame([("a", "b", "CASCADE"), ("b", "c", "CASCADE"), ("c", "a", "CASCADE"), ("d", "a", "BLOCK"), ("e", "d", "SET_NULL")], "src string, dst string, policy string")
    node = spark.createDataFrame([("a",)], "node string")
    assert sorted(r.node for r in graph.dependencies(e, node).collect()) == ["a", "b", "c"]
    assert sorted(r.node for r in graph.dependents_changed(e, node).collect()) == ["a", "b", "c", "d", "e"]
    assert sorted(tuple(r) for r in graph.plan_delete(e, node).collect()) == [("a", "delete"), ("b", "delete"), ("c", "delete"), ("d", "block")]


def test_identity_precedence(spark):
    g = lambda n: f"{n:032x}"
    known = spark.createDataFrame([(1, g(1), "a"), (1, g(2), "b"), (2, g(3), "c")], "table_id int, row_guid string, key string")
    rows = spark.createDataFrame([(1, 1, g(1), "a"), (2, 1, g(2), "B"), (3, 1, g(3), "x"), (4, 1, "", "a"), (5, 1, "zz", "q"), (6, 1, None, "new")], "row_no int, table_id int, raw_guid string, key string")
    got = {r.row_no: r.status for r in identity.scan(rows, known).collect()}
    assert got == {1: "Retained", 2: "Renamed", 3: "Duplicated", 4: "Recovered", 5: "Invalid", 6: "PendingNew"}
    fresh = identity.assign(identity.scan(rows, known)).collect()
    assert len(fresh) == 1 and len(fresh[0].row_guid) == 32


def test_content_hash_ignores_order(spark):
    rows = [(1, f"{i:032x}", f"k{i}", f"t/k{i}", 1, str(i)) for i in range(50)]
    kind = "table_id int, row_guid string, key string, path string, field int, value string"
    h = [release.root_hash(release.content_hash(spark.createDataFrame(x, kind))).first()[0] for x in (rows, rows[::-1], rows[1:])]
    assert h[0] == h[1] != h[2]


def test_versions_publish_and_read(spark, tmp_path):
    root = str(tmp_path / "out")
    assert workbooks.current(spark, root) is None
    workbooks.publish(spark.range(3), root, 1)
    workbooks.publish(spark.range(5), root, 2)
    workbooks.publish(spark.range(5), root, 2)
    assert workbooks.current(spark, root).count() == 5


def test_workbook_reader(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    grid = [["Name", "Count", "g", "r"], ["id", "count", "__guid", "__rev"], ["string", "int32", "", ""], ["a", "1", "f" * 32, "3"], [], ["b"]]
    data = "".join(f'<row r="{i}">' + "".join(cell("ABCD"[j] + str(i), x) for j, x in enumerate(r) if x) + "</row>" for i, r in enumerate(grid, 1))
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Items" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{data}</sheetData></worksheet>")
    got = workbooks.read_workbooks(spark, str(tmp_path / "*.xlsx")).orderBy("row_number").collect()
    assert [(r.sheet, r.row_number, r.raw_guid, r.raw_revision) for r in got] == [("Items", 4, "f" * 32, "3"), ("Items", 6, None, None)]
    assert got[0].cells["count"].text == "1" and "count" not in got[1].cells


def test_stream_equals_batch(spark, tmp_path):
    rows = [("p", 0, 1, "x"), ("p", 60, 2, "y"), ("p", 4000, 3, "z"), ("q", 10, 4, "x"), ("s", 90000, 5, "end")]
    df = spark.createDataFrame(rows, "path string, at long, seq long, fingerprint string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = stream.notices(spark, str(tmp_path / "in"), df.schema)
    done = []
    stream.publish(stream.debounce(live, "10 minutes"), str(tmp_path / "cp"), lambda b, n: done.extend(tuple(r) for r in b.collect())).awaitTermination()
    want = [tuple(r) for r in stream.debounce(df, "10 minutes").collect()]
    assert sorted(done) == sorted(r for r in want if r[0] != "s") and len(want) == 4


def test_structs_by_position_and_name(spark):
    kinds = {"id": "int32", "note": "string"}
    texts = ["5", "5;a", ";a", "", "5;a;b", "x;a", '5;"a']
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(cells.parse_join_struct(F.col("t"), ";", kinds).alias("s")).withColumn("w", cells.write_join_struct(F.col("s"), ";", ["id", "note"])).collect()
    assert [r.w for r in got] == ["5", "5;a", ";a", "", None, None, None]
    named = ["id=5", "note=a;id=+5", "id=5;id=6", "other=1", "id=x", ""]
    got = spark.createDataFrame([(x,) for x in named], "t string").select(cells.parse_named_struct(F.col("t"), ";", "=", kinds).alias("s")).withColumn("w", cells.write_named_struct(F.col("s"), ";", "=", ["id", "note"])).collect()
    assert [r.w for r in got] == ["id=5", "id=5;note=a", None, None, None, ""]


def test_revision_overflow_keeps_the_row(spark):
    rows = spark.createDataFrame([(1, 4294967295, "a"), (2, 0, "b")], "id int, revision long, name string")
    edits = spark.createDataFrame([(1, "edit", "c"), (2, "edit", None)], "id int, kind string, name string")
    assert {tuple(r) for r in drafts.overlay(rows, edits, "id", ["name"]).collect()} == {(1, 4294967295, "a", False), (2, 1, None, True)}
    assert [tuple(r) for r in drafts.errors(rows, edits, "id").collect()] == [(1, "draft.revision_overflow")]


def test_child_sheets(spark):
    kind = "path string, sheet string, row_number int, raw_guid string, raw_revision string, cells map<string,struct<text:string,formula:string>>"
    cell = lambda **k: {("__" + n if n in ("parent_guid", "ordinal", "map_key") else n): (v, None) for n, v in k.items()}
    g = "a" * 32
    rows = [cell(parent_guid=g, ordinal="1", n="x"), cell(parent_guid=g, ordinal="2"), cell(parent_guid=g, ordinal="2"), cell(parent_guid=g, ordinal="0"), cell(parent_guid="zz", ordinal="1"), cell(parent_guid=g, map_key="k"), cell(n="no child")]
    staging = spark.createDataFrame([("p", "s", i, None, None, c) for i, c in enumerate(rows)], kind)
    kept, found = workbooks.child_rows(staging)
    assert [(r.parent_guid, r.ordinal, r.map_key, sorted(r.cells)) for r in kept.orderBy("row_number").collect()][:1] == [(g, 1, None, ["n"])] and kept.count() == 6
    assert sorted((r.row_number, r.code) for r in found.collect()) == [(1, "child.duplicate"), (2, "child.duplicate"), (3, "child.no_identity")]


def test_snapshots_load_or_say_why_not(spark, tmp_path):
    root = str(tmp_path / "s")
    assert workbooks.load_snapshot(spark, root, "w", "h") == (None, "snapshot.missing")
    workbooks.save_snapshot(spark.range(4), root, 1, "w", "h")
    found, code = workbooks.load_snapshot(spark, root, "w", "h")
    assert found.count() == 4 and code is None
    assert [workbooks.load_snapshot(spark, root, *x)[1] for x in (("v", "h"), ("w", "i"))] == ["snapshot.foreign"] * 2
    spark.range(3).write.mode("overwrite").parquet(f"{root}/data/version=1")
    assert workbooks.load_snapshot(spark, root, "w", "h")[1] == "snapshot.corrupt"


def test_releases_open_only_whole(spark, tmp_path):
    kind = "table_id int, row_guid string, key string, path string, field int, value string"
    rows = spark.createDataFrame([(1 + i % 2, f"{i:032x}", f"k{i}", f"t/k{i}", 1, str(i)) for i in range(20)], kind)
    root = str(tmp_path / "r")
    assert workbooks.open_release(spark, root, "client", "h") == (None, ["release.missing"])
    workbooks.write_release(rows, root, 1, "client", "h")
    found, codes = workbooks.open_release(spark, root, "client", "h")
    assert codes == [] and found.count() == 20
    assert workbooks.open_release(spark, root, "server", "i")[1] == ["release.target", "release.schema_hash"]
    with pytest.raises(ValueError, match="duplicate_key"):
        workbooks.write_release(rows.withColumn("key", F.lit("k")), root, 2, "client", "h")
    rows.limit(5).drop("table_id").write.mode("overwrite").parquet(f"{root}/data/version=1/table_id=1")
    assert "release.content_hash" in workbooks.open_release(spark, root, "client", "h")[1]


def test_registries_refuse_repeats(spark):
    known = Extensions()
    known.register_migration("x", 1, lambda c: F.concat(c, F.lit("!")))
    known.register_format("upper", F.upper, F.lower)
    assert spark.range(1).select(known.migration("x", 1)(F.lit("a")), known.formats["upper"].parse(F.lit("a"))).first()[:] == ("a!", "A")
    with pytest.raises(ValueError):
        known.register_migration("x", 1, lambda c: c)
    with pytest.raises(ValueError):
        known.register_format("upper", F.upper, F.lower)
    with pytest.raises(KeyError):
        known.migration("x", 2)
    with pytest.raises(ValueError):
        register_family(spark, "f", 1, spark.createDataFrame([("a", 1), ("a", 2)], "token string, value int"))
    assert spark.range(3).select(random_guid()).distinct().count() == 3


def test_headers_and_order(spark):
    head = {"schema_hash": "h", "target": "client", "format_version": 1}
    assert publication.header_findings(head, head, head, {"read"}) == []
    assert publication.header_findings(head, head, head | {"target": "x", "format_version": 2}, {"live"}, True, True) == ["target.mismatch", "format.mismatch", "source.unreadable", "source.live_in_release", "source.not_watchable"]
    events = spark.createDataFrame([("Renamed", 1), ("Added", 2), ("Removed", 3), ("Added", 1)], "kind string, id int")
    assert [tuple(r) for r in publication.order_events(events, "id").collect()] == [("Added", 1), ("Added", 2), ("Removed", 3), ("Renamed", 1)]
    found = spark.createDataFrame([("b", 1, "y"), ("a", 3, "x"), ("a", 1, "x"), ("a", 3, "x")], "code string, severity int, at string")
    assert [tuple(r) for r in project.order_diagnostics(found, "at").collect()] == [("a", 3, "x"), ("a", 1, "x"), ("b", 1, "y")]


def test_reports_keep_the_latest(spark, tmp_path):
    path = str(tmp_path / "reports")
    for code, op in ((1, "check"), (2, "convert"), (0, "check")):
        project.append_report(spark.createDataFrame([(code,)], "exit_code int"), path, op)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("operation", "exit_code").collect()) == [("check", 0), ("convert", 2)]


def test_copies_need_a_source(spark):
    rows = spark.createDataFrame([(1, "a", "t/a", "f" * 32, 4, "v")], "table_id int, key string, path string, row_guid string, revision int, value string")
    copies = spark.createDataFrame([("t/a", "t/b", "b"), ("t/x", "t/y", "y"), ("t/a", "t/a", "c")], "path string, new_path string, new_key string")
    out, errors = drafts.copy_rows(rows, copies, random_guid())
    got = {r.path: r for r in out.collect()}
    assert sorted(got) == ["t/a", "t/b"] and got["t/b"].value == "v" and got["t/b"].revision == 0 and got["t/b"].row_guid != "f" * 32
    assert sorted(tuple(r) for r in errors.collect()) == [("t/a", "create.path_taken"), ("t/y", "copy.no_source")]


def test_overwriting_needs_consent(spark):
    cells_ = spark.createDataFrame([("w", 1, "r", "a", "Value", "1"), ("w", 1, "r", "b", "Value", "2")], "workbook_id string, table_id int, row_guid string, field_path string, state string, text string")
    steps = [migration.Step(1, "s", 1, "a", "b", lambda c: F.concat(c, F.lit("0")), overwrite=True)]
    revisions = spark.createDataFrame([("w", 1)], "workbook_id string, revision int")
    kept, errors = migration.apply_checked(cells_, migration.outcomes(cells_, steps), revisions, revisions, steps)
    assert {r.text for r in kept.collect()} == {"1", "2"} and errors.first().code == "plan.data_loss_unconfirmed"
    done, errors = migration.apply_checked(cells_, migration.outcomes(cells_, steps), revisions, revisions, steps, confirmed=True)
    assert {r.text for r in done.collect()} == {"1", "10"} and errors.isEmpty()
    again, _ = migration.apply_checked(done, migration.outcomes(done, steps), revisions, revisions, steps, confirmed=True)
    assert {r.text for r in again.collect()} == {"1", "10"}


def test_affected_and_order(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert [r.node for r in graph.affected(e, seeds).collect()] == ["a"]
    assert sorted(r.node for r in graph.affected(e, seeds, graph.impact).collect()) == ["a", "b", "c"]
    rows = spark.createDataFrame([(2, "a"), (1, "b"), (1, "a")], "table_id int, row_guid string")
    assert [tuple(r) for r in lookups.order_identity(rows).collect()] == [(1, "a"), (1, "b"), (2, "a")]
