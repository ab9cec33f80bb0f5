"""Small cases of components, lint over nested types, ranks of hot keys, workbooks of any size, and rows made unfit by others."""

import io
import re
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from rowledger import queries, typed_queries
from rowledger.catalog import Catalog, Field, Table
from rowledger.functions import cells
from rowledger.operators import checks, graph, identity, intake, lint_graph, migration, references, schema, tasks
from rowledger.registry import Registry
from rowledger.sources import workbooks


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    real = graph._stars
    monkeypatch.setattr(graph, "_stars", lambda trees: rounds.append(1) or real(trees))
    node = lambda x: (x * 7919) % 1_000_003
    edges = spark.range(n).select(node(F.col("id")).alias("src"), node(F.col("id") + 1).alias("dst"))
    got = graph.components(edges)
    assert got.agg(F.count("*"), F.count_distinct("node"), F.count_distinct("root"), F.min("root")).first() == (n + 1, n + 1, 1, 0)
    assert len(rounds) <= 17  # log2 of the nodes


def test_components_of_odd_edges(spark):
    rows = [(5, 5), (1, 2), (2, 1), (3, 2), (3, 2), (None, 4), (9, None), (7, 8), (8, 6)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(rows, "src int, dst int")).collect()}
    assert got == {5: 5, 1: 1, 2: 1, 3: 1, 7: 6, 8: 6, 6: 6}
    assert graph.components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_components_whose_numbers_begin_again(spark, tmp_path):
    ids = [*range(4090, 4100), *range(1_000_003 + 4090, 1_000_003 + 4100), 1_003_520, 1_003_523, 1_003_523]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in queries.components(spark, str(tmp_path)).collect())
    number, least = (lambda i: i * 7919 % 1_000_003), {}
    for i in ids:
        least[i // 4096] = min(number(i), least.get(i // 4096, number(i)))
    assert got == sorted((number(i), least[i // 4096]) for i in ids)


TYPES = "type string, targets array<string>, live boolean"
FIELDS = "type string, field_id int, message string, targets array<string>, ref_table string"


def test_targets_follow_nested_and_recursive_structs(spark):
    types = spark.createDataFrame([("Hero", ["client", "server"], True), ("Boss", ["server"], True), ("Stats", ["client"], False), ("Item", ["server"], True)], TYPES)
    fields = spark.createDataFrame([
        ("Hero", 1, "Stats", None, None), ("Hero", 2, "Stats", ["client"], None), ("Hero", 3, None, ["server"], "Item"), ("Hero", 4, None, None, "Item"),
        ("Boss", 1, "Node", None, None), ("Node", 1, "Node", None, None), ("Node", 2, None, ["client"], None), ("Node", 3, None, ["server"], None), ("Node", 4, "Leaf", [], None), ("Leaf", 1, None, ["server"], None),
    ], FIELDS)
    got = {(r.type, r.field_id, r.rule): r.missing for r in lint_graph.lint_visibility(types, fields).collect()}
    assert got == {("Hero", 1, "struct.invisible"): "server", ("Hero", 4, "ref.invisible"): "client", ("Node", 2, "target.outside"): "client", ("Leaf", 1, "target.outside"): "server"}
    sets = {(r.type, tuple(r.targets)) for r in lint_graph.inherited_targets(types, fields).collect()}
    assert ("Leaf", ()) in sets and ("Stats", ("client",)) in sets and ("Stats", ("client", "server")) in sets and ("Node", ("server",)) in sets


def test_recursive_and_deep_structs(spark):
    kind = "type string, field_id int, shape string, message string, expand boolean"
    rows = [
        ("T", 1, "struct", "A", None), ("A", 1, "struct", "B", None), ("B", 1, "struct", "C", None), ("C", 1, "scalar", None, None), ("T", 2, "struct", "A", True), ("T", 3, "struct", "B", None), ("T", 4, "struct", "E", None), ("E", 1, "map", None, None),
        ("R", 1, "structs", "S", None), ("S", 1, "map", "R", None), ("S", 2, "scalar", None, None), ("Q", 1, "structs", "R", None), ("S", 3, "structs", "Z", None), ("Z", 1, "structs", "Z", None),
    ]
    got = {tuple(r) for r in lint_graph.lint_structs(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("R", 1, "struct.recursive"), ("S", 1, "struct.recursive"), ("Z", 1, "struct.recursive"), ("T", 1, "struct.layers"), ("T", 4, "struct.layers")}


@pytest.mark.parametrize("links,want", [([], []), ([(1, 2), (2, 3)], []), ([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (6, 1)], [(1, 2), (2, 1), (3, 4), (4, 3)]), ([(i, (i + 1) % 30) for i in range(30)] + [(40, 3), (5, 41)], [(i, (i + 1) % 30) for i in range(30)])])
def test_edges_on_cycles(spark, links, want):
    assert sorted(tuple(r) for r in lint_graph.cyclic_edges(spark.createDataFrame(links, "src int, dst int")).collect()) == sorted(want)


def test_ways_between_cycles_take_few_rounds(spark, monkeypatch):
    made, real, top = [], graph.written, 120
    monkeypatch.setattr(graph, "written", lambda df: made.append(1) or real(df))
    ladder = [(e, e + k) for e in range(0, top, 2) for k in (2, 3)] + [(e + 1, e) for e in range(2, top + 2, 2)]
    ends = [(0, 1), (1, 0), (top + 1, top + 2), (top + 2, top + 1)]
    got = sorted(tuple(r) for r in lint_graph.cyclic_edges(spark.createDataFrame(ladder + ends, "src int, dst int")).collect())
    assert got == ends
    assert len(made) < 30  # half the rungs, if each were trimmed at an end


def test_one_key_that_all_rows_want_is_ranked_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(identity, "BUCKET_ROWS", 300)
    n, used = 3_000, [1, 2, 5, 6, 7, 900, 901, 5_000]
    wanted = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("o"))
    taken = spark.createDataFrame([(f"k_{i}",) for i in used] + [("k",), ("k_x",), ("other_3",)], "key string")
    out = identity.unique_keys(wanted, taken, "o")
    free = [i for i in range(1, n + 20) if i not in used][:n]
    assert [r.free_key for r in out.orderBy("o").collect()] == [f"k_{i}" for i in free]
    plan = out._jdf.queryExecution().toString()
    assert "windowspecdefinition(key" in plan and all("_range" in x for x in plan.split("windowspecdefinition(key")[1:])


def workbook(rows, columns):
    """A workbook whose one sheet has so many rows of so many cells."""
    out = io.BytesIO()
    name = lambda c: chr(65 + c)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for n in range(1, rows + 4):
                text = lambda c, n=n: f"p{c}" if n < 4 else f"value {n} {c}"
                f.write(f'<row r="{n}">{"".join(f"""<c r="{name(c)}{n}" t="inlineStr"><is><t>{text(c)}</t></is></c>""" for c in range(columns))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def test_a_sheet_of_a_million_cells_takes_bounded_memory():
    data = workbook(50_000, 20)
    tracemalloc.start()
    n = cells_ = 0
    for row in workbooks.staging_rows("w", data):
        n, cells_ = n + 1, cells_ + len(row[5])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, cells_) == (50_000, 1_000_000) and peak < 4 << 20


def test_workbooks_are_unzipped_once_for_all_tables(spark, tmp_path):
    """Three tables read what one pass over the workbooks has dealt out."""
    (tmp_path / "a.xlsx").write_bytes(workbook(30, 3))
    staging = workbooks.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert staging.count() == 30
    seen = spark.sparkContext.accumulator(0)
    sheets = ("s", "t", "u")

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    every = staging.mapInArrow(passed, staging.schema)
    every = every.unionByName(every.limit(0)).select("path", F.explode(F.array(*map(F.lit, (*sheets, "retired")))).alias("sheet"), "row_number", "raw_guid", "raw_revision", "cells")
    catalog = Catalog((*[Table(i + 1, s, (Field(1, "p0", key_order=1), Field(2, "p1"))) for i, s in enumerate(sheets)], Table(9, "retired", (), retired=True)))
    dealt = intake.routed(every, catalog, str(tmp_path / "dealt"))
    assert seen.value == 30
    parsed = intake.parse_tables(dealt, catalog)
    assert parsed.count() == 90 and seen.value == 30 and parsed.where("indexable").count() == 90
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("PartitionFilters: [isnotnull(sheet") == 3


def test_rows_made_unfit_by_others_and_by_children(spark):
    cell = lambda t: {"text": t, "formula": None}
    rows = [("w", "s", i, g, None, {"id": cell(k), "c": cell(c), "x": cell(x), "y": cell(y)}) for i, g, k, c, x, y in [
        (1, "a" * 32, "1", "u", "", ""), (2, "a" * 32, "2", "v", "", ""), (3, None, "3", "u", "1", ""), (4, None, "3", "w", "", "1"), (5, None, "5", "z", "1", "~"), (6, None, "6", "q", "", ""), (7, None, "7", "r", "", "")]]
    table = Table(1, "s", (Field(1, "id", key_order=1), Field(2, "c", unique=True), Field(3, "x", oneof="o"), Field(4, "y", oneof="o")), validators=("fine", "absent"))
    rules = Registry()
    rules.add("fine", lambda: F.try_element_at("cells", F.lit("c")) != "q")
    children = spark.createDataFrame([("w", "s", 7, "child.duplicate"), ("w", "t", 1, "child.duplicate")], "path string, sheet string, row_number int, code string")
    catalog = Catalog((Table(1, "s", table.fields, validators=("fine",)),))
    parsed = intake.parse_tables(spark.createDataFrame(rows, workbooks.STAGING), catalog)
    got = {r.row_number: (r.indexable, sorted(f.code for f in r.findings)) for r in intake.with_indexable(parsed, catalog, rules, children).collect()}
    assert got == {1: (False, ["field.duplicate", "row.duplicate"]), 2: (False, ["row.duplicate"]), 3: (False, ["field.duplicate", "key.duplicate"]), 4: (False, ["key.duplicate"]), 5: (True, []), 6: (False, ["validator.fine"]), 7: (False, ["child.duplicate"])}
    strict = {r.row_number: r.indexable for r in intake.with_indexable(parsed, Catalog((table,)), rules).collect()}
    assert not any(strict.values())  # a rule that nobody registered


def test_texts_with_a_line_end_are_no_identities(spark):
    g = "a" * 32
    rows = spark.createDataFrame([(g,), (g + "\n",), ("1:" + g + "\n",), ("3:a\n",), ("client\n",), ("7\n",)], "x string")
    got = rows.select(cells.valid_guid(F.col("x")).alias("g"), cells.parse_identity(F.col("x")).alias("i"), cells.parse_ref(F.col("x")).alias("r"), cells.valid_target(F.col("x")).alias("t"), cells.parse_revision(F.col("x")).alias("n")).collect()
    assert [r.g for r in got] == [True] + [False] * 5 and not any(r.i or r.r or r.t or r.n for r in got[1:])


def test_transforms_that_change_their_mind_are_found(spark):
    rows = spark.createDataFrame([("w", 5, f"r{i}", "x", "Value", str(i)) for i in range(20)], "workbook_id string, table_id int, row_guid string, field_path string, state string, text string")
    steps = [migration.Step(1, "good", 5, "x", "y", lambda x: F.concat(x, F.lit("+"))), migration.Step(2, "bad", 5, "x", "z", lambda x: F.concat(x, F.uuid()))]
    found = migration.outcomes(rows, steps).checkpoint()
    assert {r.step for r in migration.undetermined(rows, found, steps).collect()} == {"bad"}
    assert migration.undetermined(rows, migration.outcomes(rows, steps[:1]).checkpoint(), steps[:1]).isEmpty()


def test_rows_of_four_cells_are_parsed_by_code_that_the_jvm_compiles(spark, tmp_path, capsys):
    made = spark.range(50).select(*[F.lit(i).cast(t).alias(c) for i, (c, t) in enumerate([("l_orderkey", "long"), ("l_partkey", "long"), ("l_suppkey", "long"), ("l_linenumber", "int"), ("l_quantity", "double")])])
    made.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        typed_queries.parsed_tables(spark, str(tmp_path)).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_ranges_are_shared_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tasks, "TASK_ROWS", 100)
    ranges = spark.range(3_000).select((F.col("id") % 50).alias("owner"), F.col("id").alias("first"), (F.col("id") + 60).alias("last"))
    out = schema.merge_reserved(ranges)
    assert "hashpartitioning(owner" in out._jdf.queryExecution().toString() and ", 30)" in out._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(i, i, 2_950 + i + 60) for i in range(50)]


def test_targets_are_shared_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tasks, "TASK_ROWS", 5)
    targets = spark.createDataFrame([(3, f"1:{i}", f"g{i}") for i in range(5)] + [(3, "1:1", "g1"), (3, "1:2", "other"), (3, "1:7", None)], "table_id int, key string, row_guid string")
    refs = spark.createDataFrame([("f", f"3:{i}") for i in (1, 2, 7, 8)], "field string, token string")
    out = references.resolve_tokens(refs, targets, spark.createDataFrame([("f", 3)], "field string, table_id int"))
    assert [(r.token, r.dst_guid, r.error) for r in out.orderBy("token").collect()] == [("3:1", "g1", None), ("3:2", None, "ref.ambiguous"), ("3:7", None, None), ("3:8", None, "ref.unresolved")]
    assert "hashpartitioning(_t" in (plan := out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().toString()) and "RepartitionByExpression" in plan


@pytest.mark.parametrize("sampled, hot", [(256, 16), (1, 2), (1, 3), (2, 2)])
def test_hot_texts_are_repeats_without_being_counted(spark, monkeypatch, sampled, hot):
    monkeypatch.setattr(checks, "SAMPLED", sampled)
    monkeypatch.setattr(checks, "HOT", hot)
    monkeypatch.setattr(tasks, "TASK_ROWS", 20)
    cell = lambda t: {"text": t, "formula": None}
    rows = [("w", "s", i, None, None, {"id": cell(str(i // 2 if i < 20 else i)), "c": cell("hot" if i % 3 == 0 else f"c{i}")}) for i in range(200)]
    catalog = Catalog((Table(1, "s", (Field(1, "id", key_order=1), Field(2, "c", unique=True))),))
    got = intake.with_indexable(intake.parse_tables(spark.createDataFrame(rows, workbooks.STAGING), catalog), catalog).collect()
    want = {i: [c for c, bad in (("field.duplicate", i % 3 == 0), ("key.duplicate", i < 20)) if bad] for i in range(200)}
    assert len(got) == 200 and {r.row_number: sorted(f.code for f in r.findings) for r in got} == want and all(r.indexable == (not want[r.row_number]) for r in got)


def test_repeats_are_found_in_generated_code(spark, capsys):
    """One field at other places in two tables; a search for it by a lambda kept whole passes out of generated code."""
    cell = lambda t: {"text": t, "formula": None}
    rows = [("w", s, i, None, None, {"id": cell(str(i)), "c": cell(c), "x": cell("1"), "y": cell("" if i < 3 else "1")}) for s, i, c in [("s", 1, "u"), ("s", 2, "u"), ("s", 3, "v"), ("t", 1, "u"), ("t", 2, "v"), ("t", 4, "v")]]
    key, c, x, y = Field(1, "id", key_order=1), Field(2, "c", unique=True), Field(3, "x", oneof="o"), Field(4, "y", oneof="o")
    catalog = Catalog((Table(1, "s", (key, c, x, y)), Table(2, "t", (y, x, c, key))))
    parsed = intake.parse_tables(spark.createDataFrame(rows, workbooks.STAGING), catalog).checkpoint()
    out = intake.with_indexable(parsed, catalog)
    got = {(r.sheet, r.row_number): (r.indexable, sorted(f.code for f in r.findings)) for r in out.collect()}
    assert got == {("s", 1): (False, ["field.duplicate"]), ("s", 2): (False, ["field.duplicate"]), ("s", 3): (False, ["oneof.o"]), ("t", 1): (True, []), ("t", 2): (False, ["field.duplicate"]), ("t", 4): (False, ["field.duplicate", "oneof.o"])}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        intake.with_indexable(parsed, catalog).explain()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    plan = capsys.readouterr().out
    assert "Generate explode" in plan
    assert all(re.search(r"\*\(\d+\) Generate explode", line) for line in plan.splitlines() if "Generate explode" in line)
    other = Catalog((Table(1, "s", (key, x, c, y)), Table(2, "t", (y, x, c, key))))
    with pytest.raises(Exception, match="is not where the catalog has it"):
        intake.with_indexable(parsed, other).collect()


def test_keys_across_workbooks_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(checks, "SAMPLED", 1)
    monkeypatch.setattr(tasks, "TASK_ROWS", 10)
    cell = lambda t: {"text": t, "formula": None}
    staging = spark.createDataFrame([(f"w{i % 2}", "s", i, None, None, {"id": cell("0" if i % 3 == 0 else str(i // 2 * 2 if i > 90 else i))}) for i in range(100)], workbooks.STAGING)
    books = spark.createDataFrame([("w0", "b0"), ("w1", "b1")], "path string, workbook_id string")
    catalog = Catalog((Table(1, "s", (Field(1, "id", key_order=1),)),))
    known = spark.createDataFrame([], "table_id int, row_guid string, key string")
    dealt, real = [], checks.shared_out
    monkeypatch.setattr(checks, "shared_out", lambda df, n, *by: dealt.append(n) or real(df, n, *by))
    got = intake.run_checks(books, staging, intake.parse_tables(staging, catalog).checkpoint(), known, catalog).collect()
    keys = ["0" if i % 3 == 0 else str(i // 2 * 2 if i > 90 else i) for i in range(100)]
    want = {f"b{w}": sum(keys.count(k) > 1 for k in keys[w::2]) for w in (0, 1)}
    assert {r.workbook_id: r.n for r in got if r.step == "keys"} == want and dealt == [100]
