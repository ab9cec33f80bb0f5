"""Registered queries over layouts, projects, publication and saves, beside those of queries.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.functions import cells
from rowledger.operators import checks, drafts, identity, layout, migration, project, publication, references, release, schema, search
from rowledger.queries import DRAFTS, MIGRATE, QUERIES, SQL, STEPS, draft_rows, guid, long_cells, notices, query, t
from rowledger.registry import Extensions, fixed_guid, register_family
from rowledger.streaming import changes as stream

__all__ = ["QUERIES", "SQL"]


def pick(key: Column, *texts: str | Column) -> Column:
    """The text whose number is key modulo how many there are."""
    return F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in texts]), (key % len(texts) + 1).cast("int"))


# --- layouts: every part is a column of some workbook

OBSERVED = """
WITH o AS (SELECT p_partkey % 20 AS workbook_id, p_size AS table_id, p_partkey AS position, CASE WHEN p_partkey % 5 <> 0 THEN 'f' || (p_partkey % 9) END AS field_path,
  CASE p_partkey % 3 WHEN 0 THEN 'p' || (p_partkey % 8) WHEN 1 THEN 'a' || (p_partkey % 8) ELSE 'x' || p_partkey END AS property_path, CASE WHEN p_partkey % 4 = 0 THEN 'p' || (p_partkey % 6) END AS alias FROM part),
f AS (SELECT DISTINCT p_size AS table_id, p_partkey % 6 AS n FROM part),
m AS (SELECT o.*, n, CASE WHEN o.field_path = 'f' || n THEN 1 WHEN o.property_path = 'p' || n THEN 2 WHEN o.property_path = 'a' || n OR o.alias = 'p' || n THEN 3 END AS rule FROM o JOIN f USING (table_id)),
b AS (SELECT * FROM m WHERE rule IS NOT NULL)
"""


def columns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, k = t(spark, d, "part"), F.col("p_partkey")
    n = lambda mark, m: F.concat(F.lit(mark), (k % m).cast("string"))
    observed = p.select((k % 20).alias("workbook_id"), F.col("p_size").alias("table_id"), k.alias("position"), F.when(k % 5 != 0, n("f", 9)).alias("field_path"), pick(k, n("p", 8), n("a", 8), F.concat(F.lit("x"), k.cast("string"))).alias("property_path"), F.when(k % 4 == 0, F.array(n("p", 6))).alias("aliases"))
    declared = p.select(F.col("p_size").alias("table_id"), n("f", 6).alias("field_path"), n("p", 6).alias("property_path"), F.array(n("a", 6)).alias("aliases")).distinct()
    return observed, declared


@query(OBSERVED + """SELECT workbook_id, table_id, 'f' || n AS field_path, arg_min(property_path, (rule, position)) AS column_path, arg_min(position, (rule, position)) AS position, min(rule) AS rule FROM b GROUP BY workbook_id, table_id, n""")
def bind_columns(spark: SparkSession, d: str) -> DataFrame:
    return layout.bind_columns(*columns(spark, d))


@query(OBSERVED + """
SELECT workbook_id, table_id, property_path AS path, 'column.unknown' AS code, 0 AS severity FROM o WHERE NOT EXISTS (FROM b WHERE b.position = o.position)
UNION ALL SELECT w.workbook_id, w.table_id, 'p' || n, 'column.missing', 2 FROM (SELECT DISTINCT workbook_id, table_id FROM o) w JOIN f USING (table_id) WHERE NOT EXISTS (FROM b WHERE b.workbook_id = w.workbook_id AND b.table_id = w.table_id AND b.n = f.n)""")
def binding_findings(spark: SparkSession, d: str) -> DataFrame:
    return layout.binding_findings(*columns(spark, d))


@query("""
WITH o AS (SELECT c_custkey AS workbook_id, c_nationkey AS table_id, c_custkey % 7 <> 0 AS meta, c_custkey % 5 = 0 AS stale, c_custkey % 3 = 0 AS keys, c_nationkey % 4 = 0 AS unknown, c_nationkey % 4 = 1 AS retired FROM customer)
SELECT workbook_id, table_id, 'metadata.missing' AS code, 2 AS severity FROM o WHERE NOT meta
UNION ALL SELECT workbook_id, table_id, 'sheet.unknown', 3 FROM o WHERE unknown
UNION ALL SELECT workbook_id, table_id, 'sheet.retired', 0 FROM o WHERE retired
UNION ALL SELECT workbook_id, table_id, 'metadata.stale', 2 FROM o WHERE meta AND stale AND NOT unknown AND NOT retired
UNION ALL SELECT workbook_id, table_id, 'keys.stale', 1 FROM o WHERE meta AND keys AND NOT unknown AND NOT retired
UNION ALL SELECT c_custkey, c_nationkey + 1, 'sheet.missing', 2 FROM customer WHERE c_custkey % 10 = 0""")
def layout_drift(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    observed = t(spark, d, "customer").select(k.alias("workbook_id"), F.col("c_nationkey").alias("table_id"), F.when(k % 5 == 0, "old").otherwise("now").alias("schema_hash"), (k % 7 != 0).alias("has_metadata"), F.when(k % 3 == 0, "old").otherwise("now").alias("key_hash"))
    declared = t(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("table_id"), F.lit("now").alias("schema_hash"), F.lit("now").alias("key_hash"), (F.col("n_nationkey") % 4 == 1).alias("retired"))
    wanted = observed.where("workbook_id % 10 = 0").select("workbook_id", F.explode(F.array("table_id", F.col("table_id") + 1)).alias("table_id"))
    return layout.layout_drift(observed, declared).union(layout.missing_sheets(observed, wanted))


@query("""
WITH o AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
s AS (SELECT DISTINCT k % 40 AS w, n FROM o WHERE k % 3 <> 0), c AS (SELECT DISTINCT k % 40 AS w, 'child' || n AS sheet, n FROM o WHERE k % 3 = 0)
SELECT k AS workbook_id, CAST(n AS BIGINT) AS table_id, '' AS sheet, 'metadata.invalid' AS code, 2 AS severity FROM o WHERE k % 7 <> 0 AND (k % 5 = 0 OR k % 6 = 0)
UNION ALL SELECT w, n, 'child' || n, 'child_sheet.missing', 2 FROM s WHERE n % 2 = 0 AND (w, 'child' || n) NOT IN (SELECT w, sheet FROM c)
UNION ALL SELECT w, n, sheet, 'child_sheet.orphan', 0 FROM c WHERE n % 2 = 0 AND (w, n) NOT IN (SELECT w, n FROM s)""")
def sheet_drift(spark: SparkSession, d: str) -> DataFrame:
    """Metadata that says something else, and child sheets of even tables in forty workbooks."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("bigint")
    c = t(spark, d, "customer")
    digits = F.substring(F.md5(k.cast("string").cast("binary")), 1, 16)
    observed = c.select(k.alias("workbook_id"), n.alias("table_id"), (k % 7 != 0).alias("has_metadata"), F.when(k % 5 == 0, "0x12").otherwise(digits).alias("meta_hash"), F.when(k % 6 == 0, n + 1).otherwise(n).alias("meta_table"))
    child = F.concat(F.lit("child"), n.cast("string"))
    sheets = c.select((k % 40).alias("workbook_id"), F.when(k % 3 != 0, n).alias("table_id"), F.when(k % 3 == 0, child).otherwise(F.lit("main")).alias("sheet"))
    children = t(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("bigint").alias("table_id"), F.concat(F.lit("child"), F.col("n_nationkey").cast("string")).alias("sheet"))
    bad = layout.metadata_drift(observed)
    return bad.select("workbook_id", "table_id", F.lit("").alias("sheet"), "code", "severity").union(layout.child_drift(sheets, children))


def moved_cells(spark: SparkSession, d: str, purge: bool) -> DataFrame:
    """Tables 0 to 9 of customers: `name` keeps its path, `bal` becomes `balance` by number, `seg` leaves; table 9 is not in the new schema."""
    c = t(spark, d, "customer")
    entries = F.array(*[F.struct(F.lit(p).alias("property_path"), F.col(v).cast("string").alias("text")) for p, v in (("name", "c_name"), ("bal", "c_nationkey"), ("seg", "c_mktsegment"))])
    rows = c.select((F.col("c_custkey") % 10).alias("table_id"), F.col("c_custkey").alias("row_guid"), F.explode(entries).alias("e")).select("table_id", "row_guid", "e.*")
    tables = rows.select("table_id").distinct()
    fields = lambda df, *fs: df.select("table_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field_path"), F.lit(p).alias("property_path")) for n, p in fs])).alias("f")).select("table_id", "f.*")
    return layout.project_to_schema(rows, fields(tables, ("1", "name"), ("2", "bal"), ("3", "seg")), fields(tables.where("table_id < 9"), ("7", "name"), ("2", "balance")), purge)


MOVED = """
SELECT c_custkey % 10 AS table_id, c_custkey AS row_guid, 'name' AS property_path, c_name AS text FROM customer
UNION ALL SELECT c_custkey % 10, c_custkey, CASE WHEN c_custkey % 10 < 9 THEN 'balance' ELSE 'bal' END, CAST(c_nationkey AS VARCHAR) FROM customer
"""


@query(MOVED + "UNION ALL SELECT c_custkey % 10, c_custkey, 'seg', c_mktsegment FROM customer")
def project_layout(spark: SparkSession, d: str) -> DataFrame:
    return moved_cells(spark, d, purge=False)


@query("SELECT * FROM (" + MOVED + ") WHERE table_id < 9")
def purge_layout(spark: SparkSession, d: str) -> DataFrame:
    return moved_cells(spark, d, purge=True)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN ' ' || l_partkey WHEN 1 THEN '+0' || l_partkey END AS text, CAST(l_partkey AS VARCHAR) AS patch FROM lineitem WHERE l_partkey % 4 IN (0, 1) AND l_suppkey % 9 <> 0""")
def normalize_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey").cast("string")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pick(F.col("l_partkey"), F.concat(F.lit(" "), k), F.concat(F.lit("+0"), k), k, F.concat(F.lit("x"), k)).alias("text"), F.when(F.col("l_suppkey") % 9 == 0, "A1").alias("formula"))
    return layout.normalize_plan(rows, cells.canonicalize(F.col("text"), "int64")).drop("formula")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_custkey % 4 <> 0 OR o_orderkey % 2 = 0 AS is_set FROM orders""")
def struct_columns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    nested = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.struct(F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("c"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("s")).alias("v"))
    flat = layout.flatten_struct(nested, "v", "o_orderkey", "o_custkey", "o_orderstatus")
    return layout.assemble_struct(flat, "v", "o_orderkey", "o_custkey", "o_orderstatus").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("v").isNotNull().alias("is_set"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 4 AS b, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END END AS v, c_nationkey FROM customer)
SELECT c_custkey, 'nation' AS property_path, CASE WHEN v IS NULL AND b = 0 THEN 'Missing' WHEN v IS NULL THEN 'Null' WHEN b = 2 AND v = c_nationkey THEN 'Defaulted' ELSE 'Value' END AS state, CAST(v AS VARCHAR) AS text FROM c""")
def capture_values(spark: SparkSession, d: str) -> DataFrame:
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    base = c.where("c_custkey % 4 <> 3").select("c_custkey", F.lit("nation").alias("property_path"), pick(k, "Missing", "Null", "Defaulted", "Value").alias("state"), F.when(k % 4 >= 2, F.col("c_nationkey").cast("string")).alias("text"))
    typed = c.withColumn("v", F.when(k % 3 != 0, F.col("c_nationkey") + F.when(k % 5 == 0, 1).otherwise(0)))
    return layout.capture_values(typed, base, "c_custkey", {"nation": F.col("v")})


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN concat(o_custkey, ';', o_orderkey % 3, '/"', o_orderstatus, ';"') END AS nested,
       CASE WHEN o_orderkey % 7 <> 0 THEN concat(o_custkey, ',a;', o_orderkey) END AS listed, CASE WHEN o_orderkey % 7 <> 0 THEN 2 END AS n FROM orders""")
def nested_structs(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    kinds = {"id": "int64", "place": {"row": "int32", "mark": "string"}}
    nested = F.concat(c, F.lit(" ; +"), (k % 3).cast("string"), F.lit('/"'), "o_orderstatus", F.lit(';"'), F.when(k % 5 == 0, "/3").otherwise(""))
    listed = F.concat(c, F.lit(",a;; "), k.cast("string"), F.when(k % 7 == 0, ";x").otherwise(""))
    item = {"id": "int64", "tag": "string"}
    rows = t(spark, d, "orders").withColumn("s", cells.parse_join_struct(nested, ";", kinds, "/")).withColumn("l", cells.parse_join_struct_list(listed, ";", ",", item))
    return rows.select("o_orderkey", cells.write_join_struct(F.col("s"), ";", kinds, "/").alias("nested"), cells.write_join_struct_list(F.col("l"), ";", ",", list(item)).alias("listed"), F.when(F.col("l").isNotNull(), F.size("l")).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_suppkey AS BIGINT) END AS number, CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS flag FROM lineitem""")
def typed_values(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("l_partkey") % 3 == 0, "x").otherwise(F.concat(F.lit(" +"), F.col("l_suppkey").cast("string")))
    flag = pick(F.col("l_suppkey"), " TRUE", "0", "yes")
    leaf = lambda c, kind: cells.typed_value(cells.canonicalize(c, kind), kind)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", leaf(text, "int64").alias("number"), leaf(flag, "bool").cast("int").alias("flag"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Value' WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Value' ELSE 'Missing' END ELSE 'Missing' END AS state,
       CASE WHEN c_custkey % 3 = 0 THEN '=A' || (c_custkey % 2) WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN '9' END AS text FROM customer""")
def comparable_raw(spark: SparkSession, d: str) -> DataFrame:
    """Every third cell is a formula; of the rest, missing on the raw side, every fifth gets another default, if even."""
    k = F.col("c_custkey")
    cell = lambda state, text: F.struct(state.alias("state"), text.alias("text"))
    formula = k % 3 == 0
    raw = cell(F.when(formula, "Value").otherwise("Missing"), F.when(formula, F.concat(F.lit("=A"), (k % 2).cast("string"))))
    value = cell(F.when(formula, "Value").otherwise("Defaulted"), F.when((k % 5 == 0) & (k % 2 == 0), "9").otherwise("7"))
    base = cell(F.when(formula, "Value").otherwise("Defaulted"), F.lit("7"))
    return t(spark, d, "customer").select("c_custkey", cells.comparable_raw(raw, raw, value, base).alias("c")).select("c_custkey", "c.*")


# --- projects


@query("""
WITH w AS (SELECT s_suppkey AS k, 'dir/W' || s_suppkey AS path, s_nationkey AS id FROM supplier)
SELECT path, id AS workbook_id, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY lower(path)) > 1 THEN 'workbook.duplicate' END AS code FROM w""")
def check_sources(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select(F.concat(F.lit("dir/W"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_nationkey").alias("workbook_id"))
    good, bad = project.check_sources(s.union(s.select(F.lower("path"), "workbook_id")))
    return good.withColumn("code", F.lit(None).cast("string")).union(bad.drop("severity"))


@query("""SELECT c_nationkey AS table_id, CASE WHEN c_nationkey % 5 = 0 THEN 'table.retired' ELSE 'table.unknown' END AS code, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 3 END AS severity, count(*) AS n FROM customer WHERE c_nationkey % 5 IN (0, 1) GROUP BY 1
UNION ALL SELECT c_nationkey, 'live', -1, count(*) FROM customer WHERE c_nationkey % 5 NOT IN (0, 1) GROUP BY 1""")
def live_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").withColumnRenamed("c_nationkey", "table_id")
    tables = t(spark, d, "nation").where("n_nationkey % 5 <> 1").select(F.col("n_nationkey").alias("table_id"), (F.col("n_nationkey") % 5 == 0).alias("retired"))
    live, found = project.drop_retired(rows, tables)
    return found.union(live.groupBy("table_id").agg(F.count("*").alias("n")).select("table_id", F.lit("live"), F.lit(-1), "n"))


@query("""
SELECT c_custkey, 'balance' AS code, 2 AS severity FROM customer WHERE c_nationkey < 12 AND c_acctbal < 0
UNION ALL SELECT c_custkey, 'validator.unregistered.lost', 2 FROM customer WHERE c_nationkey = 3
UNION ALL SELECT c_custkey, 'segment', 2 FROM customer WHERE c_nationkey IN (3, 20) AND c_mktsegment NOT LIKE '%U%'""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    known = Extensions()
    known.register_validator("balance", lambda: F.col("c_acctbal") >= 0)
    known.register_validator("segment", lambda: F.col("c_mktsegment").contains("U"))
    of = {n: ["balance"] for n in range(12)} | {20: ["segment"], 3: ["balance", "lost", "segment"]}
    return project.validate_rows(t(spark, d, "customer").withColumn("table_id", F.col("c_nationkey")), of, known.validators, "c_custkey")


@query("""
WITH l AS (SELECT 7 AS table_id, l_orderkey || '|' || l_linenumber AS key, l_suppkey AS workbook_id, l_partkey AS row_number FROM lineitem), g AS (SELECT key, count(*) AS n, count(DISTINCT workbook_id) AS workbooks FROM l GROUP BY 1 HAVING count(*) > 1)
SELECT l.*, n, workbooks FROM l JOIN g USING (key)""")
def duplicate_keys_across(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select(F.lit(7).alias("table_id"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key"), F.col("l_suppkey").alias("workbook_id"), F.col("l_partkey").alias("row_number"))
    return project.duplicate_keys_across(rows)


@query("""
SELECT s_suppkey AS workbook_id, count(DISTINCT l_linenumber) AS tables, count(l_orderkey) AS n_rows, CASE WHEN s_nationkey % 3 = 0 THEN 'old' ELSE 'now' END AS schema_hash, s_nationkey % 3 <> 0 AS current
FROM (SELECT s_suppkey, s_nationkey FROM supplier UNION ALL SELECT -1 - s_suppkey, s_nationkey FROM supplier) LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_nationkey""")
def workbook_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier has a workbook with its lines, and another one without rows."""
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("workbook_id"), F.col("l_linenumber").alias("table_id"))
    k = F.col("s_suppkey")
    books = t(spark, d, "supplier").select(F.explode(F.array(k, -1 - k)).alias("workbook_id"), F.when(F.col("s_nationkey") % 3 == 0, "old").otherwise("now").alias("schema_hash"))
    return project.workbook_summary(rows, books, "now")


@query("""SELECT 7 AS table_id, CAST(l_orderkey AS VARCHAR) AS row_guid, l_linenumber AS field, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_fields(spark: SparkSession, d: str) -> DataFrame:
    return project.duplicate_fields(t(spark, d, "lineitem").select(F.lit(7).alias("table_id"), F.col("l_orderkey").cast("string").alias("row_guid"), F.col("l_linenumber").alias("field")))


@query("""SELECT DISTINCT lower(p_brand) AS target FROM part UNION SELECT 'client' FROM part""")
def target_list(spark: SparkSession, d: str) -> DataFrame:
    return project.target_list(t(spark, d, "part").select(F.array(F.lit("client"), F.lower("p_brand")).alias("targets")))


FACTS = """
WITH f AS (SELECT CAST(l_suppkey AS VARCHAR) AS w, l_suppkey AS k, CAST(count_if(l_quantity < 2) AS BIGINT) AS unparseable, CAST(count_if(l_linenumber = 7 AND l_discount > 0.09) AS BIGINT) AS pending, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS hits, CAST(count_if(l_quantity > 49) AS BIGINT) AS errors FROM lineitem GROUP BY l_suppkey)
"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey")
    f = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") < 2).alias("unparseable"), F.count_if((F.col("l_linenumber") == 7) & (F.col("l_discount") > 0.09)).alias("pending"), F.count_if(F.col("l_returnflag") == "R").alias("legacy_hits"), F.count_if(F.col("l_quantity") > 49).alias("legacy_errors"))
    return f.select(k.cast("string").alias("workbook_id"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("revision"), pick(k, "now", "old", "other", "now").alias("schema_hash"), (k % 6 != 0).alias("mapping_complete"), (k % 8 != 0).alias("ownership_safe"), "unparseable", "pending", "legacy_hits", "legacy_errors")


@query(FACTS + """
SELECT w AS workbook_id, 'evidence.invalid' AS code, 3 AS severity FROM f WHERE k % 11 = 0
UNION ALL SELECT w, 'schema.outdated', 1 FROM f WHERE k % 4 = 1 UNION ALL SELECT w, 'schema.drift', 2 FROM f WHERE k % 4 = 2
UNION ALL SELECT w, 'mapping.invalid', 3 FROM f WHERE k % 6 = 0 UNION ALL SELECT w, 'ownership.conflict', 3 FROM f WHERE k % 8 = 0
UNION ALL SELECT w, 'data.unparseable', 2 FROM f WHERE unparseable > 0 UNION ALL SELECT w, 'migration.pending', 2 FROM f WHERE pending > 0
UNION ALL SELECT w, 'legacy.errors', 2 FROM f WHERE errors > 0 UNION ALL SELECT w, 'legacy.hits', 1 FROM f WHERE errors = 0 AND hits > 0
UNION ALL SELECT NULL, 'coverage.incomplete', 1 WHERE EXISTS (FROM f)""")
def fact_findings(spark: SparkSession, d: str) -> DataFrame:
    return project.fact_findings(facts(spark, d), "now", "old", complete=False)


@query(FACTS + """
SELECT 'f' || n AS format, n = 0 AS safe FROM range(4) x(n) WHERE EXISTS (FROM f)""")
def legacy_removal(spark: SparkSession, d: str) -> DataFrame:
    """Format f0 is proven; f1 has hits, f2 the revisions of all but one workbook, f3 evidence twice."""
    f = facts(spark, d).select("workbook_id", "revision")
    least = f.agg(F.min("workbook_id").alias("least")).where("least is not null")
    rows = least.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    evidence = rows.select(F.concat(F.lit("f"), F.least("i", F.lit(3)).cast("string")).alias("format"), F.lit("now").alias("schema_hash"), F.when(F.col("i") == 1, 5).otherwise(0).alias("hits"), F.lit(0).alias("errors"))
    seen = f.join(F.broadcast(least)).select(F.explode(F.array(*[F.lit(f"f{i}") for i in range(4)])).alias("format"), "workbook_id", "revision", "least").where("format <> 'f2' or workbook_id <> least").drop("least")
    return project.legacy_removal_proof(f, evidence, seen, "now", True)


@query("""
WITH d AS (SELECT o_orderstatus AS op, 2 AS severity FROM orders WHERE o_custkey % 10 = 0 UNION SELECT o_orderstatus, 1 FROM orders WHERE o_totalprice > 300000 UNION SELECT 'part', 3 FROM part GROUP BY p_name HAVING count(*) > 1)
SELECT op, max(severity) AS exit_code, CAST(0 AS BIGINT) AS infos, CAST(count_if(severity = 1) AS BIGINT) AS warnings, CAST(count_if(severity = 2) AS BIGINT) AS errors, CAST(count_if(severity = 3) AS BIGINT) AS blockers FROM d GROUP BY 1""")
def check_project(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").withColumn("op", F.col("o_orderstatus"))
    code = lambda df, c, n: df.select("op", F.lit(c).alias("code"), F.lit(n).alias("severity"))
    names = t(spark, d, "part").groupBy("p_name").count().where("count > 1").withColumn("op", F.lit("part"))
    return project.check_project([code(o.where("o_custkey % 10 = 0"), "ref.unresolved", 2), code(o.where("o_totalprice > 300000"), "row.large", 1), code(names, "key.duplicate", 3)], "op")


@query("""SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_reports(spark: SparkSession, d: str) -> DataFrame:
    return project.recent_reports(t(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"])


@query("""
SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN 'external.unregistered' END AS error, CASE WHEN n_regionkey <> 0 THEN n_nationkey END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def registered_family(spark: SparkSession, d: str) -> DataFrame:
    nation = t(spark, d, "nation")
    family = register_family(spark, "nation.names", 1, nation.where("n_regionkey <> 0").select(F.col("n_name").alias("token"), F.col("n_nationkey").alias("value")))
    rows = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lit("nation.names").alias("family"), F.col("n_name").alias("token"))
    return references.bind_external(rows, family).select("c_custkey", "error", "value")


# --- publication


@query("""
WITH s AS (SELECT s_nationkey AS k, count(*) AS n, min(s_suppkey) AS a, max(s_suppkey) AS b FROM supplier GROUP BY 1), n AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 3 <> 0),
j AS (SELECT coalesce(s.k, n.k) AS k, n.k IS NOT NULL AS want, s.k IS NOT NULL AS there, s.n FROM s FULL JOIN n ON s.k = n.k)
SELECT 't' || k AS target, 'target.missing' AS code FROM j WHERE want AND NOT there UNION ALL SELECT 't' || k, 'target.stale' FROM j WHERE NOT want UNION ALL SELECT 't' || k, 'target.duplicate' FROM j WHERE n > 1
UNION ALL SELECT DISTINCT 't' || s_nationkey, 'component.bytes' FROM supplier WHERE s_nationkey % 3 <> 0 AND s_suppkey % 4 = 0""")
def publication_gaps(spark: SparkSession, d: str) -> DataFrame:
    target = lambda c: F.concat(F.lit("t"), F.col(c).cast("string")).alias("target")
    now = F.lit("now")
    staged = t(spark, d, "supplier").select(target("s_nationkey"), now.alias("registry"), now.alias("codegen"), F.when(F.col("s_suppkey") % 4 == 0, "old").otherwise("now").alias("bytes"), now.alias("manifest"))
    return publication.publication_gaps(t(spark, d, "nation").where("n_nationkey % 3 <> 0").select(target("n_nationkey")), staged, "now")


@query(FACTS + """
SELECT NULL AS target, 'publish.compatibility' AS code UNION ALL SELECT NULL, 'publish.coverage' UNION ALL SELECT NULL, 'publish.workbooks_outdated' UNION ALL SELECT NULL, 'publish.history'
UNION ALL SELECT 't' || n_nationkey, 'publish.host_migration' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 't' || n_nationkey, 'target.missing' FROM nation WHERE n_regionkey = 2""")
def publication_gate(spark: SparkSession, d: str) -> DataFrame:
    nation = t(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("target"), "n_regionkey")
    found = project.fact_findings(facts(spark, d), "now", "old", complete=False).select("code", "severity", F.lit(None).cast("string").alias("target"))
    found = found.union(nation.where("n_regionkey <= 1").select(F.lit("target.removed"), F.lit(1), "target"))
    gaps = nation.where("n_regionkey = 2").select("target", F.lit("target.missing").alias("code"))
    return publication.publication_gate(gaps, found, nation.where("n_regionkey = 0"), history=False)


@query("""
WITH h AS (SELECT c_nationkey AS project, c_custkey AS k FROM customer),
e AS (SELECT DISTINCT c_nationkey AS project FROM customer WHERE c_custkey % 50 = 7 AND c_custkey % 3 <> 0),
r AS (SELECT project, 'h' || k AS schema_hash, 'r' || k AS revision, CASE WHEN k % 3 <> 0 THEN 0 ELSE 1 END AS b, k FROM h WHERE k % 3 <> 0 OR project NOT IN (FROM e))
SELECT project, CAST(row_number() OVER w AS INTEGER) AS sequence, revision, schema_hash, 'c' || k AS content_hash, lag(schema_hash) OVER w AS previous, NULL AS error FROM r WINDOW w AS (PARTITION BY project ORDER BY b, k)
UNION ALL SELECT c_nationkey, NULL, 'r' || c_custkey, NULL, NULL, NULL, 'revision.taken' FROM customer WHERE c_custkey % 50 = 7 AND c_custkey % 3 <> 0""")
def record_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Schemas of a project are its customers: two thirds published, all in the batch again, every fiftieth revision with another hash."""
    k = F.col("c_custkey")
    name = lambda mark: F.concat(F.lit(mark), k.cast("string"))
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("project"), k.alias("sequence"), name("r").alias("revision"), name("h").alias("schema_hash"), name("c").alias("content_hash"))
    history = c.where("sequence % 3 <> 0")
    other = history.where("sequence % 50 = 7").select("project", "sequence", "revision", F.concat("schema_hash", F.lit("x")).alias("schema_hash"), F.concat("content_hash", F.lit("x")).alias("content_hash"))
    out, errors = publication.record_schemas(history, c.union(other))
    none = lambda n: F.lit(None).cast("string").alias(n)
    return out.withColumn("error", none("error")).unionByName(errors.select("project", F.lit(None).cast("int").alias("sequence"), "revision", none("schema_hash"), none("content_hash"), none("previous"), F.col("code").alias("error")))


@query("""
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
r AS (SELECT o % 5 + 1 AS table_id, CASE WHEN o % 31 <> 0 THEN o || '|' || n || '|' || p END AS g, CASE WHEN p % 40 <> 0 THEN o || '|' || n ELSE '' END AS key, s % 9 = 0 AS twice, o, n, p, s FROM l)
SELECT table_id, g AS row_guid, 'row.pending' AS code FROM r WHERE g IS NULL
UNION ALL SELECT table_id, g, 'key.empty' FROM r WHERE g IS NOT NULL AND key = ''
UNION ALL SELECT table_id, g, 'field.duplicate' FROM r WHERE g IS NOT NULL AND twice
UNION ALL SELECT table_id, g, 'identity.duplicate' FROM r WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT table_id, min(g), 'key.duplicate' FROM r WHERE g IS NOT NULL AND key <> '' GROUP BY table_id, key HAVING count(*) > 1
UNION ALL SELECT table_id, g, 'table.unbound' FROM r WHERE g IS NOT NULL AND table_id = 5
UNION ALL SELECT DISTINCT table_id, g, 'ref.dangling' FROM r WHERE s % 7 = 0""")
def validate_snapshot(spark: SparkSession, d: str) -> DataFrame:
    o, table = F.col("l_orderkey"), F.col("l_orderkey") % 5 + 1
    whole = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey")
    rows = t(spark, d, "lineitem").select(
        table.alias("table_id"), F.when(o % 31 != 0, whole).alias("row_guid"), F.when(F.col("l_partkey") % 40 != 0, F.concat_ws("|", "l_orderkey", "l_linenumber")).otherwise("").alias("key"),
        F.when(F.col("l_suppkey") % 9 == 0, F.array(F.lit("1"), F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("fields"),
        F.array(F.struct(table.alias("table_id"), F.when(F.col("l_suppkey") % 7 == 0, "none").when(o % 31 != 0, whole).alias("row_guid"))).alias("deps"),
    )
    rows = rows.withColumn("deps", F.filter("deps", lambda x: x["row_guid"].isNotNull()))
    bound = t(spark, d, "region").where("r_regionkey < 4").select((F.col("r_regionkey") + 1).alias("table_id"))
    return publication.validate_snapshot(rows, bound)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Removed' ELSE 'Renamed' END AS kind, 'taken' AS source FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 4 = 0
UNION ALL SELECT NULL, NULL, 'refused' || CAST(count(*) AS VARCHAR) FROM customer""")
def switch_source(spark: SparkSession, d: str) -> DataFrame:
    """A sound candidate gives its changes; one with another schema leaves the rows as they are, without any event."""
    c = t(spark, d, "customer").select("c_custkey", F.lit("p").alias("path"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(0).alias("dep"))
    new = c.where("c_custkey % 9 <> 0").withColumn("name", F.when(F.col("c_custkey") % 4 == 0, F.concat("name", F.lit("2"))).otherwise(F.col("name")))
    head = {"schema_hash": "now", "target": "client", "format_version": 1}
    args = ("c_custkey", "path", "name", ["nation"], "dep")
    none = c.where("false")
    _, events = publication.switch_source(c, new, publication.header_findings(head, head, head, {"read"}), none, *args)
    kept, no = publication.switch_source(c, new, publication.header_findings(head, head, head | {"schema_hash": "old"}, {"read"}), none, *args)
    n = kept.agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("c_custkey"), F.lit(None).cast("string").alias("kind"), F.concat(F.lit("refused"), F.col("n").cast("string")).alias("source"))
    return events.withColumn("source", F.lit("taken")).union(n).union(no.withColumn("source", F.lit("event")))


@query(MIGRATE + """
, r AS (SELECT workbook_id, table_id, row_guid, 'size' AS field_path, CASE WHEN k % 9 = 0 THEN 'Missing' WHEN k % 8 = 0 THEN 'Defaulted' ELSE 'Value' END AS state, CASE WHEN k % 9 <> 0 THEN size END AS text FROM s
  UNION ALL SELECT workbook_id, table_id, row_guid, 'size_mm', 'Value', size || '0' FROM s WHERE k % 5 = 0),
n AS (SELECT workbook_id, table_id, row_guid, 'size_mm' AS field_path, 'Value' AS state, size || '0' AS text FROM s WHERE k % 5 <> 0 AND NOT (k % 9 = 0 OR k % 8 = 0)
  UNION ALL SELECT workbook_id, table_id, row_guid, 'size_um', 'Value', size || '0000' FROM s WHERE k % 5 = 0 OR NOT (k % 9 = 0 OR k % 8 = 0))
SELECT 'current' AS plan, * FROM r UNION ALL SELECT 'current', * FROM n UNION ALL SELECT 'stale', * FROM r UNION ALL SELECT 'stale', '3', NULL, NULL, NULL, 'plan.stale', NULL WHERE EXISTS (FROM s WHERE workbook_id = '3')""")
def apply_migration(spark: SparkSession, d: str) -> DataFrame:
    rows = long_cells(spark, d)
    found = migration.outcomes(rows, STEPS)
    planned = rows.groupBy("workbook_id").agg(F.lit(1).alias("revision"))
    later = planned.withColumn("revision", F.when(F.col("workbook_id") == "3", 2).otherwise(F.col("revision")))
    good, _ = migration.apply_checked(rows, found, planned, planned, STEPS)
    kept, errors = migration.apply_checked(rows, found, planned, later, STEPS)
    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    code = errors.select("workbook_id", none("int", "table_id"), none("string", "row_guid"), none("string", "field_path"), F.col("code").alias("state"), none("string", "text"))
    return good.withColumn("plan", F.lit("current")).union(kept.union(code).withColumn("plan", F.lit("stale")))


# --- edits and saves


@query("""
SELECT 3 AS table_id, md5('3:' || c_custkey) AS row_guid, CASE WHEN c_custkey % 11 = 0 THEN 'save.repeated' WHEN c_custkey % 7 <> 0 AND c_custkey % 5 = 0 THEN 'save.revision'
  WHEN c_custkey % 7 = 0 AND c_custkey % 5 = 0 THEN 'save.new_revision' WHEN c_custkey % 7 = 0 AND c_custkey % 3 = 0 THEN 'save.absent' WHEN c_custkey % 7 <> 0 AND c_custkey % 13 = 0 AND c_custkey % 3 <> 0 THEN 'save.deleted_by_others'
  WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 0 THEN 'save.owned_elsewhere' END AS code
FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 5 = 0 OR (c_custkey % 7 = 0 AND c_custkey % 3 = 0) OR (c_custkey % 7 <> 0 AND c_custkey % 13 = 0 AND c_custkey % 3 <> 0) OR (c_custkey % 7 = 0 AND c_custkey % 2 = 0)""")
def check_save(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("c_custkey"), t(spark, d, "customer")
    item = c.select(F.lit("w").alias("workbook_id"), F.lit(3).alias("table_id"), guid(3, k).alias("row_guid"), F.when(k % 5 == 0, 9).when(k % 7 == 0, 0).otherwise(k % 2).cast("long").alias("revision"), (k % 3 == 0).alias("deleted"), k.alias("k"))
    base = c.where("c_custkey % 7 <> 0").select(F.lit(3).alias("table_id"), guid(3, k).alias("row_guid"), (k % 2).alias("revision"))
    theirs = c.where("c_custkey % 13 <> 0").select(F.lit(3).alias("table_id"), guid(3, k).alias("row_guid"))
    other = c.where("c_custkey % 2 = 0").select(F.lit("v").alias("workbook_id"), F.lit(3).alias("table_id"), guid(3, k).alias("row_guid"))
    return drafts.check_save(item.union(item.where("k % 11 = 0")).drop("k"), base, theirs, other)


@query("""
WITH r AS (SELECT c_nationkey AS table_id, c_name AS key, 'w/' || c_custkey AS path, md5('3:' || c_custkey) AS row_guid, 4 AS revision FROM customer),
w AS (SELECT c_custkey AS k, c_nationkey AS table_id, c_name || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '+' END AS key, CASE WHEN c_custkey % 6 = 0 THEN 'w/' || c_custkey WHEN c_custkey % 5 = 0 THEN 'same' || c_custkey % 10 ELSE 'new/' || c_custkey END AS path FROM customer WHERE c_custkey % 2 = 0),
e AS (SELECT path, 'create.path_taken' AS code FROM w WHERE path IN (SELECT path FROM r) UNION SELECT path, 'create.key_taken' FROM w WHERE k % 4 = 0 UNION SELECT path, 'create.wanted_twice' FROM w GROUP BY path HAVING count(*) > 1)
SELECT *, NULL AS code FROM r UNION ALL SELECT table_id, key, path, md5(path), 0, NULL FROM w WHERE path NOT IN (SELECT path FROM e) UNION ALL SELECT NULL, NULL, path, NULL, NULL, code FROM e""".replace("'same' || c_custkey % 10", "'same' || (c_custkey % 10)"))
def create_rows(spark: SparkSession, d: str) -> DataFrame:
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    s = k.cast("string")
    rows = c.select(F.col("c_nationkey").alias("table_id"), F.col("c_name").alias("key"), F.concat(F.lit("w/"), s).alias("path"), guid(3, k).alias("row_guid"), F.lit(4).alias("revision"))
    path = F.when(k % 6 == 0, F.concat(F.lit("w/"), s)).when(k % 5 == 0, F.concat(F.lit("same"), (k % 10).cast("string"))).otherwise(F.concat(F.lit("new/"), s))
    wanted = c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("table_id"), F.concat("c_name", F.when(k % 4 == 0, "").otherwise("+")).alias("key"), path.alias("path"))
    out, errors = drafts.create_rows(rows, wanted, fixed_guid(F.col("path"))())
    return out.withColumn("code", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b,z' WHEN c_custkey % 3 = 1 THEN 'a' ELSE '' END AS labels, c_custkey % 3 = 0 OR c_custkey % 10 = 0 AS dirty FROM customer""")
def set_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    labels = lambda *x: F.array(*map(F.lit, x))
    rows = t(spark, d, "customer").select("c_custkey", F.when(k % 3 == 2, F.array().cast("array<string>")).otherwise(labels("a")).alias("labels"), (k % 10 == 0).alias("dirty"))
    wanted = rows.where("c_custkey % 3 <> 1").select("c_custkey", F.when(k % 3 == 0, labels("z", " ", "b", "z")).otherwise(labels("")).alias("labels"))
    return drafts.set_labels(rows, wanted.union(rows.where("c_custkey % 3 = 1").select("c_custkey", "labels")), "c_custkey").withColumn("labels", F.array_join("labels", ","))


@query("""
WITH r AS (SELECT 'w' || c_nationkey AS workbook_id, c_custkey AS k FROM customer)
SELECT workbook_id, k, CAST(workbook_id = 'w3' AS INTEGER) AS reused, NULL AS code FROM r WHERE workbook_id <> 'w3' OR k % 2 = 0
UNION ALL SELECT 'w3', -k, 0, NULL FROM r WHERE workbook_id = 'w3'
UNION ALL SELECT 'w5', k, NULL, c FROM r, (VALUES ('import.unsaved'), ('import.guid'), ('import.path'), ('import.key')) x(c) WHERE workbook_id = CASE c WHEN 'import.unsaved' THEN 'w5' ELSE 'w3' END""")
def import_workbook(spark: SparkSession, d: str) -> DataFrame:
    """w3 without its odd rows and with new ones is taken; w5 with unsaved edits and rows of w3 is refused."""
    k = F.col("k")
    rows = t(spark, d, "customer").select(F.concat(F.lit("w"), "c_nationkey").alias("workbook_id"), F.lit(3).alias("table_id"), F.col("c_custkey").alias("k"))
    full = lambda df: df.select("workbook_id", "table_id", k.cast("string").alias("key"), F.concat(F.lit("p/"), k.cast("string")).alias("path"), guid(3, k).alias("row_guid"), "k")
    resident = full(rows).withColumn("dirty", F.col("workbook_id") == "w5")
    third = rows.where("workbook_id = 'w3'")
    out, _ = drafts.import_into(resident, full(third.where("k % 2 = 0").union(third.withColumn("k", -k))), "w3")
    same, errors = drafts.import_into(resident, full(third.withColumn("workbook_id", F.lit("w5"))), "w5")
    keys = resident.select("row_guid", "k")
    bad = errors.join(keys, "row_guid").select(F.lit("w5").alias("workbook_id"), "k", F.lit(None).cast("int").alias("reused"), "code")
    lost = resident.select("row_guid").exceptAll(same.select("row_guid")).select(F.lit("lost"), F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit("lost"))
    return out.select("workbook_id", "k", F.col("reused").cast("int").alias("reused"), F.lit(None).cast("string").alias("code")).union(bad).union(lost)


@query(DRAFTS + """
, j AS (SELECT d.k, d.kind, CASE WHEN d.kind <> 'add' THEN r.name END AS n0, CASE WHEN d.kind <> 'delete' THEN d.name END AS n1, CASE WHEN d.kind <> 'add' THEN CAST(r.nation AS VARCHAR) END AS a0, CASE WHEN d.kind <> 'delete' THEN CAST(d.nation AS VARCHAR) END AS a1
  FROM d LEFT JOIN r USING (k) WHERE (d.k >= 0 AND d.kind <> 'add') OR (d.k < 0 AND d.kind = 'add'))
SELECT k AS c_custkey, kind, 'name' AS property, n0 AS before, n1 AS after FROM j WHERE n0 IS DISTINCT FROM n1 UNION ALL SELECT k, kind, 'nation', a0, a1 FROM j WHERE a0 IS DISTINCT FROM a1""")
def pending_changes(spark: SparkSession, d: str) -> DataFrame:
    return drafts.pending_changes(*draft_rows(spark, d), "c_custkey", ["name", "nation"])


@query("""
SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 100 = 0)""")
def save_scope(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer are linked; every third is dirty, every hundredth is picked."""
    o = t(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"), "o_orderkey")
    return drafts.save_scope(o.where("o_orderkey % 3 = 0").select(F.col("src").alias("node")), o, o.where("o_orderkey % 100 = 0").select(F.col("src").alias("node")))


@query("""
SELECT c_custkey AS row_no, md5('3:' || c_custkey) AS row_guid, NULL AS code FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, NULL, 'repair.not_recovered' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 6 <> 0""")
def repair_identities(spark: SparkSession, d: str) -> DataFrame:
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    rows = c.select(k.alias("row_no"), F.lit(3).alias("table_id"), F.when(k % 2 == 0, "").otherwise(guid(3, k)).alias("raw_guid"), k.cast("string").alias("key"))
    known = c.select(F.lit(3).alias("table_id"), guid(3, k).alias("row_guid"), k.cast("string").alias("key"))
    fixed, errors = identity.repair(identity.scan(rows, known), rows.where("row_no % 3 = 0"))
    return fixed.unionByName(errors, allowMissingColumns=True)


@query("""SELECT p_partkey FROM part WHERE p_size % 3 IN (0, 2) AND p_partkey % 4 = 1 AND lower(p_name) LIKE '%a%'""")
def pick_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("key"), (F.col("p_size") % 3).cast("string").alias("type"), F.array((F.col("p_partkey") % 4).cast("string")).alias("labels"), F.lit("p").alias("path"))
    return search.pick_targets(rows, ["0", "2"], "1", "A").select("p_partkey")


@query("""SELECT c_custkey, 'w3/' || c_mktsegment AS path FROM customer WHERE c_nationkey = 3""")
def load_all(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("w"), "c_nationkey", F.lit("/"), "c_mktsegment").alias("path"))
    return search.load_all(rows, "w3", ["path", "c_custkey"])


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 'Unknown' WHEN o_custkey % 5 = 0 THEN 'Missing' ELSE 'Resident' END AS state FROM orders""")
def asset_state(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").where("c_custkey % 7 <> 0").select(k.alias("o_custkey"), (k % 5 != 0).alias("alive"))
    return search.asset_state(rows, t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


# --- lint of catalogs: parts as declarations


@query("""
WITH x AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey // 2 END AS table_id, p_partkey AS k, 'n' || p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN 'embedded' WHEN 1 THEN NULL ELSE 'asset' END AS kind, p_partkey % 3 = 0 AS retired FROM part)
SELECT table_id, name, 'table.id' AS rule FROM x WHERE kind = 'asset' AND NOT retired AND coalesce(table_id <= 0, true)
UNION ALL SELECT table_id, name, 'table.kind' FROM x WHERE kind IS NULL
UNION ALL SELECT table_id, name, 'embedded.id_or_key' FROM x WHERE kind = 'embedded' AND (table_id IS NOT NULL OR k % 2 = 1)
UNION ALL SELECT table_id, name, 'retired.shape' FROM x WHERE retired AND NOT (coalesce(kind = 'asset', false) AND coalesce(table_id > 0, false))
UNION ALL SELECT table_id, min(name), 'table.duplicate' FROM x WHERE table_id > 0 GROUP BY 1 HAVING count(*) > 1""")
def lint_tables(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    table = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, -1).otherwise(F.floor(k / 2))
    rows = t(spark, d, "part").select(table.cast("long").alias("table_id"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.when(k % 5 == 0, "embedded").when(k % 5 != 1, "asset").alias("kind"), (k % 3 == 0).alias("retired"), (k % 2).alias("keys"))
    return schema.lint_tables(rows)


@query("""
WITH x AS (SELECT p_size AS table_id, p_partkey AS field_id, p_partkey AS k, ['scalar', 'struct', 'list', 'structs', 'map'][p_partkey % 5 + 1] AS shape FROM part)
SELECT table_id, field_id, 'expand.shape' AS rule FROM x WHERE k % 3 = 0 AND shape <> 'struct'
UNION ALL SELECT table_id, field_id, 'child_table.shape' FROM x WHERE k % 4 = 0 AND (shape <> 'structs' OR k % 6 < 5)
UNION ALL SELECT table_id, field_id, 'labels.shape' FROM x WHERE k % 7 = 0 AND NOT (shape = 'list' AND k % 2 = 0)
UNION ALL SELECT table_id, field_id, 'oneof.shape' FROM x WHERE k % 8 = 0 AND shape IN ('list', 'structs', 'map')
UNION ALL SELECT table_id, field_id, 'map.key' FROM x WHERE shape = 'map' AND k % 9 >= 3
UNION ALL SELECT table_id, field_id, 'ref.target' FROM x WHERE CASE WHEN k % 2 = 0 THEN (k % 3 = 0) = (k % 13 = 0) ELSE k % 3 = 0 OR k % 13 = 0 END
UNION ALL SELECT table_id, field_id, 'format.separators' FROM x WHERE k % 6 IN (1, 2, 3)
UNION ALL SELECT table_id, field_id, 'format.layers' FROM x WHERE k % 6 < 5 AND (shape = 'scalar' OR k % 6 = 4 OR (shape = 'list' AND k % 6 IN (0, 1)))
UNION ALL SELECT table_id, field_id, 'legacy.repeated' FROM x WHERE k % 10 = 0
UNION ALL SELECT table_id, field_id, 'legacy.canonical' FROM x WHERE k % 10 = 1""")
def lint_declarations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    texts = lambda *x: F.array(*map(F.lit, x))
    mod = k % 6
    separators = F.when(mod == 0, texts(";", ",")).when(mod == 1, texts(";", ";;")).when(mod == 2, texts("")).when(mod == 3, texts('"')).when(mod == 4, texts(";", ",", "/"))
    rows = t(spark, d, "part").select(
        F.col("p_size").alias("table_id"), k.alias("field_id"), pick(k, "scalar", "struct", "list", "structs", "map").alias("shape"), pick(k, "string", "int32").alias("type"), F.when(k % 9 == 0, "string").when(k % 9 == 1, "int64").when(k % 9 == 2, "bool").when(k % 9 < 6, "double").alias("map_key"),
        (k % 3 == 0).alias("expand"), (k % 4 == 0).alias("child_table"), (k % 7 == 0).alias("labels"), F.when(k % 8 == 0, "choice").alias("oneof"), separators.alias("separators"), F.lit("now").alias("format"),
        F.when(k % 10 == 0, texts("a", "b", "a")).when(k % 10 == 1, texts("now", "b")).alias("legacy"), F.when(k % 3 == 0, k).alias("ref_table"), F.when(k % 13 == 0, "g").alias("ref_group"), (k % 2 == 0).alias("is_ref"),
    )
    return schema.lint_declarations(rows)


@query("""
WITH a AS (SELECT c_custkey % 200 AS id, count(*) AS n, count_if(c_custkey % 3 <> 0 AND c_nationkey % 2 = 0) AS live FROM customer GROUP BY 1)
SELECT p_size AS table_id, p_partkey AS field_id, 'ref.unknown' AS rule FROM part LEFT JOIN a ON id = p_partkey % 250 WHERE p_partkey % 2 = 0 AND coalesce(live, 0) = 0
UNION ALL SELECT p_size, p_partkey, 'ref.ambiguous' FROM part JOIN a ON id = p_partkey % 250 WHERE p_partkey % 2 = 0 AND n > 1
UNION ALL SELECT p_size, p_partkey, 'ref.empty_group' FROM part WHERE p_partkey % 2 = 1 AND p_size NOT IN (SELECT n_nationkey FROM nation)""")
def lint_references(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    fields = t(spark, d, "part").select(F.col("p_size").alias("table_id"), k.alias("field_id"), F.when(k % 2 == 0, k % 250).alias("ref_table"), F.when(k % 2 == 1, F.col("p_size")).alias("ref_group"))
    tables = t(spark, d, "customer").select((F.col("c_custkey") % 200).alias("table_id"), F.when(F.col("c_nationkey") % 2 == 0, "asset").otherwise("embedded").alias("kind"), (F.col("c_custkey") % 3 == 0).alias("retired"))
    return schema.lint_references(fields, tables, t(spark, d, "nation").select(F.col("n_nationkey").alias("ref_group"), F.lit(1).alias("table_id")))


@query("""
WITH v AS (SELECT l_suppkey AS enum, l_partkey % 400 AS number FROM lineitem), r AS (SELECT s_suppkey AS enum, s_nationkey AS first, s_nationkey + 3 AS last FROM supplier)
SELECT enum, NULL AS number, 'enum.no_zero' AS rule FROM v GROUP BY 1 HAVING count_if(number = 0) = 0
UNION ALL SELECT enum, number, 'enum.duplicate' FROM v GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT enum, number, 'enum.reserved' FROM v JOIN r USING (enum) WHERE number BETWEEN first AND last""")
def lint_enums(spark: SparkSession, d: str) -> DataFrame:
    values = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("enum"), (F.col("l_partkey") % 400).alias("number"))
    return schema.lint_enums(values, t(spark, d, "supplier").select(F.col("s_suppkey").alias("enum"), F.col("s_nationkey").alias("first"), (F.col("s_nationkey") + 3).alias("last")))


# --- freshness, variants, repeated notices


@query("""
SELECT c_custkey AS target, CASE WHEN c_custkey % 7 = 0 THEN 'target' WHEN c_custkey % 5 = 0 THEN 'schema_hash' WHEN c_custkey % 3 = 0 THEN 'content_hash' END AS reason FROM customer""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("c_custkey"), t(spark, d, "customer")
    want = c.select(k.alias("target"), F.lit("now").alias("schema_hash"), F.col("c_name").alias("content_hash"))
    there = c.where("c_custkey % 7 <> 0").select(k.alias("target"), F.when(k % 5 == 0, "old").otherwise("now").alias("schema_hash"), F.when(k % 3 != 0, F.col("c_name")).alias("content_hash"))
    return release.freshness(there, want).select("target", "reason")


@query("""SELECT o_orderkey, CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderkey % 3 = 0 AS INTEGER) + CAST(o_orderkey % 5 = 0 AS INTEGER) > 1 AS clash FROM orders""")
def oneof_variants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", checks.check_oneof(*[F.when(k % n == 0, F.lit(True)) for n in (2, 3, 5)]).alias("clash"))


@query("""
WITH n AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, CASE WHEN event_id % 10 <> 0 THEN md5(event_type) END AS fingerprint FROM events)
SELECT path, seq, fingerprint FROM n WHERE fingerprint IS NULL OR NOT EXISTS (FROM events e WHERE e.event_id % 97 = 0 AND CAST(e.user_id AS VARCHAR) = n.path AND md5(e.event_type) = n.fingerprint)""")
def suppress_self(spark: SparkSession, d: str) -> DataFrame:
    found = notices(spark, d)
    return stream.suppress_self(found.withColumn("fingerprint", F.when(F.col("seq") % 10 != 0, F.col("fingerprint"))), found.where("seq % 97 = 0")).select("path", "seq", "fingerprint")


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS path, md5(event_type) AS fingerprint FROM events""")
def drop_repeats(spark: SparkSession, d: str) -> DataFrame:
    return stream.drop_repeats(notices(spark, d), "1 day").select("path", "fingerprint")


@query("""SELECT CAST(c_nationkey AS INTEGER) AS workbook_id, CAST(count_if(c_custkey % 29 = 0 OR c_custkey % 31 = 0) AS BIGINT) AS pending FROM customer GROUP BY 1""")
def pending_count(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select(F.col("c_nationkey").alias("workbook_id"), F.when(k % 29 != 0, F.when(k % 31 == 0, "zz").otherwise(guid(3, k))).alias("row_guid"))
    return project.pending_count(rows)


@query("""
WITH r AS (SELECT c_nationkey AS table_id, md5('3:' || c_custkey) AS g, c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN 4294967295 ELSE c_custkey % 3 END AS revision, c_name AS name FROM customer),
e AS (SELECT r.*, CASE WHEN k % 6 = 0 THEN 'delete' WHEN k % 4 = 0 THEN 'edit' ELSE 'add' END AS kind, CASE WHEN k % 6 <> 0 AND k % 4 <> 0 AND k % 10 <> 0 THEN md5('9:' || k) ELSE g END AS guid, CASE WHEN k % 50 = 7 THEN -1 ELSE table_id END AS tid FROM r WHERE k % 6 = 0 OR k % 4 = 0 OR k % 5 = 2 OR k % 10 = 0),
c AS (SELECT *, CASE WHEN tid = -1 THEN 'write.unknown_table' WHEN kind = 'add' AND guid = g THEN 'write.taken' WHEN kind <> 'delete' AND k % 9 = 1 THEN 'write.invalid_value' WHEN kind = 'edit' AND revision = 4294967295 THEN 'write.revision_overflow' END AS code FROM e),
n AS (SELECT c.*, CASE WHEN kind = 'add' THEN (SELECT max(k) FROM r WHERE r.table_id = c.tid) + row_number() OVER (PARTITION BY tid, kind ORDER BY guid) ELSE k END AS row_number FROM c WHERE code IS NULL)
SELECT tid AS table_id, guid AS row_guid, row_number, NULL AS property_path, NULL AS text, NULL AS code FROM n WHERE kind = 'delete'
UNION ALL SELECT tid, guid, row_number, 'name', CASE k % 3 WHEN 0 THEN '%7E' WHEN 1 THEN '~' ELSE name END, NULL FROM n WHERE kind <> 'delete'
UNION ALL SELECT tid, guid, row_number, '__rev', CASE WHEN kind = 'add' THEN '0' ELSE CAST(revision + 1 AS VARCHAR) END, NULL FROM n WHERE kind <> 'delete'
UNION ALL SELECT tid, guid, row_number, '__guid', guid, NULL FROM n WHERE kind = 'add'
UNION ALL SELECT tid, guid, NULL, NULL, NULL, code FROM c WHERE code IS NOT NULL""")
def write_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").alias("table_id"), guid(3, k).alias("row_guid"), k.alias("row_number"), F.when(k % 17 == 0, drafts.LAST_REVISION).otherwise(k % 3).alias("revision"))
    kind = F.when(k % 6 == 0, "delete").when(k % 4 == 0, "edit").otherwise("add")
    state = F.when(k % 9 == 1, "Invalid").when(k % 3 == 1, "Null").otherwise("Value")
    cell = F.struct(state.alias("state"), F.when(k % 3 == 0, "~").otherwise(F.col("c_name")).alias("text"))
    own = (kind == "add") & (k % 10 != 0)
    edits = c.where("c_custkey % 6 = 0 or c_custkey % 4 = 0 or c_custkey % 5 = 2 or c_custkey % 10 = 0").select(F.when(k % 50 == 7, -1).otherwise(F.col("c_nationkey")).alias("table_id"), F.when(own, guid(9, k)).otherwise(guid(3, k)).alias("row_guid"), kind.alias("kind"), F.create_map(F.lit("name"), cell).alias("cells"))
    patches, blockers = drafts.write_plan(rows, edits)
    return patches.withColumn("code", F.lit(None).cast("string")).unionByName(blockers, allowMissingColumns=True)
