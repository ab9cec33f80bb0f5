"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Each one applies operators to whole tables; edits, drafts and versions are derived from the tables by modulus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.catalog import Field, Table
from rowledger.functions import cells
from rowledger.operators import changes, checks, drafts, graph, identity, lookups, merge, migration, references, release, schema, search
from rowledger.streaming import changes as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def guid(table_id: int, key: Column) -> Column:
    """Identity of the fixtures only; real ones are random."""
    return F.md5(F.concat(F.lit(f"{table_id}:"), key.cast("string")).cast("binary"))


# --- cells

QUANTITY = Field(1, "quantity", "int64", default="7", min=2, max=45)
NOTE = Field(2, "note", "string", required=True)


def dirty(k: Column, text: Column) -> Column:
    return F.when(k % 13 == 0, "").when(k % 17 == 0, "~").when(k % 19 == 0, "x1").when(k % 23 == 0, "%7E").otherwise(text)


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 17 = 0 THEN '~' WHEN l_orderkey % 19 = 0 THEN 'x1' WHEN l_orderkey % 23 = 0 THEN '%7E'
       ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS x FROM lineitem),
p AS (SELECT *, CASE WHEN regexp_matches(x, '^\\s*[+-]?\\d+\\s*$') THEN TRY_CAST(x AS BIGINT) END AS n FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN x = '' THEN 'Defaulted' WHEN x = '~' THEN 'Null' WHEN n IS NULL OR n < 2 OR n > 45 THEN 'Invalid' ELSE 'Value' END AS state,
  CASE WHEN x = '' THEN '7' WHEN x <> '~' AND n BETWEEN 2 AND 45 THEN CAST(n AS VARCHAR) END AS text,
  CASE WHEN x IN ('', '~') THEN NULL WHEN n IS NULL THEN 'cell.unparseable' WHEN n < 2 THEN 'cell.min' WHEN n > 45 THEN 'cell.max' END AS error,
  CASE WHEN x = '' THEN 'Missing' WHEN x = '~' THEN 'Null' ELSE 'Value' END AS note_state,
  CASE WHEN x = '%7E' THEN '~' WHEN x NOT IN ('', '~') THEN x END AS note_text,
  CASE WHEN x IN ('', '~') THEN 'cell.required' END AS note_error
FROM p""".replace("\\\\", "\\"))
def parse_states(spark: SparkSession, d: str) -> DataFrame:
    x = dirty(F.col("l_orderkey"), F.col("l_quantity").cast("bigint").cast("string"))
    rows = t(spark, d, "lineitem").withColumn("x", x)
    rows = cells.parse_columns(rows, {"q": (F.col("x"), None, QUANTITY), "n": (F.col("x"), None, NOTE)})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q.state", "q.text", "q.error", F.col("n.state").alias("note_state"), F.col("n.text").alias("note_text"), F.col("n.error").alias("note_error"))


@query("""SELECT l_orderkey, l_linenumber, concat(length(CAST(l_orderkey AS VARCHAR)), ':', l_orderkey, '|', length(CAST(l_linenumber AS VARCHAR)), ':', l_linenumber) AS key FROM lineitem""")
def key_build(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cells.encode_key(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return checks.repeated(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1""")
def indexable_rows(spark: SparkSession, d: str) -> DataFrame:
    return checks.without_repeated(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT 'p_name' AS property_path, p_name AS text, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'p_partkey', CAST(p_partkey AS VARCHAR), count(*) FROM part GROUP BY 2 HAVING count(*) > 1""")
def duplicate_unique(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicate_unique(t(spark, d, "part"), ["p_name", "p_partkey"])


@query("""
WITH g AS (SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS x FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey, CAST(CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ',')) END AS INTEGER) AS n,
       CASE WHEN x = '' THEN '' ELSE list_reduce(list_transform(string_split(x, ','), lambda v: CAST(CAST(v AS INTEGER) AS VARCHAR)), lambda a, b: a || ',' || b) END AS written
FROM g""")
def join_list(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.sort_array(F.collect_list("l_linenumber")).cast("array<string>"), ",")
    lists = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(text.alias("x"))
    parsed = lists.withColumn("v", cells.parse_join_list(F.concat(F.lit(" "), F.col("x")), ",", "int32"))
    return parsed.select("o_orderkey", F.size("v").alias("n"), cells.write_join_list(F.col("v"), ",").alias("written"))


@query("""
SELECT event_id, user_id % 5 <> 0 AS sound,
       CASE WHEN user_id % 5 <> 0 THEN concat('a=', user_id, ';t="', event_type, ';x"') END AS written FROM events""")
def join_map(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    text = F.concat(F.lit('t="'), "event_type", F.lit(';x" ; a= '), user, F.when(F.col("user_id") % 5 == 0, ";t=2").otherwise(""))
    parsed = t(spark, d, "events").withColumn("m", cells.parse_join_map(text, ";", "="))
    return parsed.select("event_id", F.col("m").isNotNull().alias("sound"), cells.write_join_map(F.col("m"), ";", "=").alias("written"))


@query("""
WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN concat('#', o_custkey) WHEN 2 THEN 'none' ELSE concat('+', o_custkey) END AS x, o_custkey FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 2 THEN CAST(o_custkey AS VARCHAR) END AS value, o_orderkey % 4 = 1 AS legacy, CASE WHEN o_orderkey % 4 = 2 THEN 'cell.unparseable' END AS error FROM c""")
def legacy_window(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, c).when(k == 1, F.concat(F.lit("#"), c)).when(k == 2, "none").otherwise(F.concat(F.lit("+"), c))
    rows = t(spark, d, "orders").withColumn("x", x)
    read = cells.parse_with_legacy(cells.canonicalize(F.col("x"), "int64"), F.when(F.col("x").startswith("#"), cells.canonicalize(F.substring("x", 2, 100), "int64")))
    return rows.withColumn("r", read).select("o_orderkey", "r.*")


@query("""
SELECT c_custkey, concat('3:', c_custkey, '|', replace(replace(c_name, '#', '%23'), ' ', '%20'), '|', CASE WHEN c_custkey % 2 = 0 THEN 'a%2Fb~%2A' ELSE '%C3%A9' END) AS token,
       3 AS table_id, CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 2 = 0 THEN 'a/b~*' ELSE 'é' END AS last FROM customer""")
def ref_tokens(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("c_custkey") % 2 == 0, "a/b~*").otherwise("é")
    rows = t(spark, d, "customer").select("c_custkey", cells.encode_ref(3, F.col("c_custkey").cast("string"), F.col("c_name"), last).alias("token"))
    p = rows.withColumn("p", cells.parse_ref(F.col("token")))
    return p.select("c_custkey", "token", "p.table_id", F.get("p.parts", F.lit(0)).alias("k"), F.get("p.parts", F.lit(2)).alias("last"))


@query("""SELECT s_suppkey, list_aggregate(list_sort(list_distinct(list_filter([s_nationkey % 3, s_nationkey % 2, s_nationkey % 3]::VARCHAR[], lambda x: x <> '1'))), 'string_agg', ',') AS labels FROM supplier""")
def labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey")
    parts = F.transform(F.array(n % 3, n % 2, n % 3), lambda x: F.when(x == 1, " ").otherwise(x.cast("string")))
    made = cells.canonical_labels(parts)
    return t(spark, d, "supplier").select("s_suppkey", F.when(F.size(made) > 0, F.array_join(made, ",")).alias("labels"))


# --- references


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers without every tenth, every eleventh twice under another identity."""
    c = t(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("key"), guid(3, F.col("c_custkey")).alias("row_guid"))
    again = c.where("cast(key as bigint) % 11 = 0").select("key", F.md5(F.col("row_guid").cast("binary")).alias("row_guid"))
    return c.union(again)


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 AND o_custkey % 11 <> 0 THEN md5('3:' || o_custkey) END AS row_guid,
       CASE WHEN o_custkey % 10 = 0 THEN 'ref.unresolved' WHEN o_custkey % 11 = 0 THEN 'ref.ambiguous' END AS error FROM orders""")
def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"))
    return references.resolve(refs, customers(spark, d)).select("o_orderkey", "row_guid", "error")


@query("""
SELECT CASE WHEN o_custkey % 10 = 0 THEN 'ref.unresolved' ELSE 'ref.ambiguous' END AS code, CAST(0 AS BIGINT) AS infos, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS errors, count(*) AS blockers, 3 AS exit_code
FROM orders WHERE o_custkey % 10 = 0 OR o_custkey % 11 = 0 GROUP BY 1""")
def unresolved_refs(spark: SparkSession, d: str) -> DataFrame:
    found = checks.diagnostics(resolve_refs(spark, d), {c: (3, F.col("error") == c) for c in ("ref.unresolved", "ref.ambiguous")}, "o_orderkey")
    return checks.summarize(found, "code")


@query("""SELECT md5('6:' || o_orderkey) AS src_guid, md5('3:' || o_custkey) AS dst_guid FROM orders WHERE o_custkey % 10 = 0""")
def dangling(spark: SparkSession, d: str) -> DataFrame:
    edges = t(spark, d, "orders").select(guid(6, F.col("o_orderkey")).alias("src_guid"), F.lit(3).alias("dst_table"), guid(3, F.col("o_custkey")).alias("dst_guid"))
    records = t(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.lit(3).alias("table_id"), guid(3, F.col("c_custkey")).alias("row_guid"))
    return references.dangling(edges, records).select("src_guid", "dst_guid")


@query("""
SELECT md5('6:' || l_orderkey) AS parent_guid, count(*) AS n,
       string_agg(concat(l_linenumber, ':', l_partkey), ';' ORDER BY l_linenumber, l_partkey) AS items
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 9 <> 0 GROUP BY 1""")
def children_agg(spark: SparkSession, d: str) -> DataFrame:
    parents = t(spark, d, "orders").where("o_orderkey % 9 <> 0").select(guid(6, F.col("o_orderkey")).alias("row_guid"))
    lines = t(spark, d, "lineitem").select(guid(6, F.col("l_orderkey")).alias("parent_guid"), "l_linenumber", "l_partkey")
    made = references.aggregate_children(references.attach_children(parents, lines), "l_linenumber", "l_partkey")
    return made.select("parent_guid", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ";").alias("items"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%U%' THEN 'text of ' || o_orderpriority ELSE o_orderpriority END AS text, NOT o_orderpriority LIKE '%U%' AS missing FROM orders""")
def localize(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    texts = o.select(F.col("o_orderpriority").alias("text_key")).distinct().where("text_key like '%U%'").withColumn("text", F.concat(F.lit("text of "), "text_key"))
    return references.localize(o.select("o_orderkey", F.col("o_orderpriority").alias("text_key")), texts).select("o_orderkey", "text", "missing")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'external.family' WHEN c_custkey % 5 = 0 THEN 'external.empty' WHEN n_regionkey = 0 THEN 'external.unregistered' END AS error,
       CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND n_regionkey <> 0 THEN n_nationkey END AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def bind_external(spark: SparkSession, d: str) -> DataFrame:
    nation = t(spark, d, "nation")
    families = nation.where("n_regionkey <> 0").select(F.lit("nation").alias("family"), F.col("n_name").alias("token"), F.col("n_nationkey").alias("value"))
    rows = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "other").otherwise("nation").alias("family"), F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "n_name")).alias("token"))
    return references.bind_external(rows, families).select("c_custkey", "error", "value")


@query("""
SELECT c_custkey, CASE WHEN n_regionkey IN (2, 3) THEN 'external.round_trip' END AS error, c_nationkey AS value FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def external_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """Nations by name and by number; those of two regions are written as names that nothing or another nation has."""
    nation, n = t(spark, d, "nation"), F.col("n_nationkey")
    written = F.when(F.col("n_regionkey") == 2, F.lit("7?")).when(F.col("n_regionkey") == 3, (n + 1000).cast("string")).otherwise(F.col("n_name"))
    names = nation.select(F.lit("nation").alias("family"), F.explode(F.array("n_name", n.cast("string"))).alias("token"), n.alias("value"), written.alias("canonical"))
    other = nation.where("n_regionkey = 3").select(F.lit("nation"), (n + 1000).cast("string"), n + 1, F.lit("x"))
    rows = t(spark, d, "customer").select("c_custkey", F.lit("nation").alias("family"), F.col("c_nationkey").cast("string").alias("token"))
    return references.bind_external(rows, names.union(other)).select("c_custkey", "error", "value")


# --- versions


def base(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    return c.select("c_custkey", F.concat_ws("/", F.lit("customer"), "c_name").alias("path"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("dep"))


def edited(spark: SparkSession, d: str, edit: int, add: int, gone: int, mark: str, new: int) -> DataFrame:
    b = base(spark, d).where(f"c_custkey % {gone} <> 0")
    k = F.col("c_custkey")
    b = b.withColumn("bal", F.when(k % edit == 0, F.col("bal") + add).otherwise(F.col("bal"))).withColumn("name", F.when(k % 70 == 0, F.concat("name", F.lit(mark))).otherwise(F.col("name")))
    fresh = base(spark, d).where(f"c_custkey between 1 and {new}").withColumn("c_custkey", -k).withColumn("bal", F.col("bal") + add)
    return b.union(fresh)


def theirs(spark: SparkSession, d: str) -> DataFrame:
    return edited(spark, d, 7, 10, 11, "T", 5)


def mine(spark: SparkSession, d: str) -> DataFrame:
    return edited(spark, d, 5, 20, 13, "M", 20)


VERSIONS = """
WITH base AS (SELECT c_custkey, 'customer/' || c_name AS path, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg, c_nationkey AS dep FROM customer),
theirs AS (
  SELECT c_custkey, path, CASE WHEN c_custkey % 70 = 0 THEN name || 'T' ELSE name END AS name, CASE WHEN c_custkey % 7 = 0 THEN bal + 10 ELSE bal END AS bal, seg, dep FROM base WHERE c_custkey % 11 <> 0
  UNION ALL SELECT -c_custkey, path, name, bal + 10, seg, dep FROM base WHERE c_custkey BETWEEN 1 AND 5),
mine AS (
  SELECT c_custkey, path, CASE WHEN c_custkey % 70 = 0 THEN name || 'M' ELSE name END AS name, CASE WHEN c_custkey % 5 = 0 THEN bal + 20 ELSE bal END AS bal, seg, dep FROM base WHERE c_custkey % 13 <> 0
  UNION ALL SELECT -c_custkey, path, name, bal + 20, seg, dep FROM base WHERE c_custkey BETWEEN 1 AND 20)
"""


@query(VERSIONS + """
SELECT n.c_custkey, CASE WHEN p.c_custkey IS NULL THEN 'Added' WHEN p.name <> n.name THEN 'Renamed' WHEN p.bal = n.bal THEN 'Unchanged' ELSE 'Modified' END AS change_kind
FROM theirs n LEFT JOIN base p USING (c_custkey)""")
def change_kinds(spark: SparkSession, d: str) -> DataFrame:
    return changes.classify(base(spark, d), theirs(spark, d), "c_custkey", "name", ["bal", "seg", "dep"])


@query("""SELECT c_custkey, c_name AS name FROM customer WHERE c_custkey % 11 = 0""")
def removed_rows(spark: SparkSession, d: str) -> DataFrame:
    return changes.removed(base(spark, d), theirs(spark, d), "c_custkey").select("c_custkey", "name")


@query(VERSIONS + """
, j AS (SELECT coalesce(p.c_custkey, n.c_custkey) AS c_custkey, p.name AS pn, n.name AS nn, p.bal AS pb, n.bal AS nb FROM base p FULL JOIN theirs n ON p.c_custkey = n.c_custkey)
SELECT c_custkey, 'Added' AS kind FROM j WHERE pn IS NULL UNION ALL SELECT c_custkey, 'Removed' FROM j WHERE nn IS NULL
UNION ALL SELECT c_custkey, 'Renamed' FROM j WHERE pn <> nn UNION ALL SELECT c_custkey, 'PropertyChanged' FROM j WHERE pb <> nb""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return changes.snapshot_changes(base(spark, d), theirs(spark, d), "c_custkey", "path", "name", ["bal", "seg"], "dep")


@query(VERSIONS + """
, j AS (SELECT coalesce(p.c_custkey, n.c_custkey) AS c_custkey, p.name AS pn, n.name AS nn, p.bal AS pb, n.bal AS nb FROM theirs p FULL JOIN mine n ON p.c_custkey = n.c_custkey)
SELECT c_custkey, '' AS property, 'added' AS kind, pn AS before, nn AS after FROM j WHERE pn IS NULL
UNION ALL SELECT c_custkey, '', 'removed', pn, nn FROM j WHERE nn IS NULL
UNION ALL SELECT c_custkey, '$key', 'renamed', pn, nn FROM j WHERE pn <> nn
UNION ALL SELECT c_custkey, 'cents', 'modified', CAST(CAST(round(pb * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(nb * 100) AS BIGINT) AS VARCHAR) FROM j WHERE round(pb * 100) <> round(nb * 100)""")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    cents = lambda df: df.withColumn("cents", F.round(F.col("bal") * 100).cast("bigint"))
    return changes.diff_versions(cents(theirs(spark, d)), cents(mine(spark, d)), "c_custkey", "name", "path", ["cents", "seg"])


MERGE = VERSIONS + """
, j AS (
  SELECT coalesce(b.c_custkey, t.c_custkey, m.c_custkey) AS c_custkey, b.c_custkey AS bk, t.c_custkey AS tk, m.c_custkey AS mk,
         b.name AS bn, t.name AS tn, m.name AS mn, b.bal AS bb, t.bal AS tb, m.bal AS mb
  FROM base b FULL JOIN theirs t ON b.c_custkey = t.c_custkey FULL JOIN mine m ON coalesce(b.c_custkey, t.c_custkey) = m.c_custkey),
k AS (
  SELECT *, bk IS NOT NULL AND tk IS NOT NULL AND mk IS NOT NULL AS three,
    CASE WHEN bk IS NULL THEN CASE WHEN mk IS NULL THEN 'theirs' WHEN tk IS NULL OR (tn = mn AND tb = mb) THEN 'mine' ELSE 'theirs' END
         WHEN mk IS NULL THEN CASE WHEN tk IS NULL OR (tn = bn AND tb = bb) THEN 'gone' ELSE 'theirs' END
         WHEN tk IS NULL THEN CASE WHEN mn = bn AND mb = bb THEN 'gone' ELSE 'mine' END ELSE 'merged' END AS kept
  FROM j),
c AS (
  SELECT *, three AND mn <> bn AND tn <> bn AND mn <> tn AS cn, three AND mb <> bb AND tb <> bb AND mb <> tb AS cb FROM k),
x AS (
  SELECT *, CASE WHEN bk IS NULL AND tk IS NOT NULL AND mk IS NOT NULL AND (tn <> mn OR tb <> mb) THEN 'ConcurrentAdd'
       WHEN bk IS NOT NULL AND mk IS NULL AND tk IS NOT NULL AND (tn <> bn OR tb <> bb) THEN 'DeleteModify'
       WHEN bk IS NOT NULL AND tk IS NULL AND mk IS NOT NULL AND (mn <> bn OR mb <> bb) THEN 'DeleteModify'
       WHEN cn OR cb THEN 'Field' END AS conflict,
    CASE WHEN kept = 'mine' THEN mn WHEN kept = 'merged' AND mn <> bn AND tn = bn THEN mn WHEN kept <> 'gone' THEN tn END AS name,
    CASE WHEN kept = 'mine' THEN mb WHEN kept = 'merged' AND mb <> bb AND tb = bb THEN mb WHEN kept <> 'gone' THEN tb END AS bal
  FROM c)
"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.three_way_merge(base(spark, d), theirs(spark, d), mine(spark, d), "c_custkey", ["name", "bal"])


@query(MERGE + "SELECT c_custkey, kept, conflict, name, bal FROM x")
def merge_rows(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select("c_custkey", "kept", "conflict", "name", "bal")


@query(MERGE + "SELECT c_custkey, conflict, CASE WHEN cn AND cb THEN 'name,bal' WHEN cn THEN 'name' WHEN cb THEN 'bal' ELSE '' END AS fields FROM x WHERE conflict IS NOT NULL")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).where("conflict is not null").select("c_custkey", "conflict", F.array_join("conflicts", ",").alias("fields"))


@query(MERGE + """
, r AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'mine' WHEN 1 THEN 'base' WHEN 2 THEN 'theirs' END AS take FROM x)
SELECT c_custkey, CASE WHEN conflict IN ('ConcurrentAdd', 'DeleteModify') AND take IS NOT NULL THEN CASE WHEN (take = 'mine' AND mk IS NULL) OR (take = 'base' AND bk IS NULL) OR (take = 'theirs' AND tk IS NULL) THEN 'gone' ELSE take END ELSE kept END AS kept,
  CASE WHEN take IS NULL THEN conflict END AS conflict,
  CASE WHEN take IS NOT NULL AND (conflict IN ('ConcurrentAdd', 'DeleteModify') OR cn) THEN CASE take WHEN 'mine' THEN mn WHEN 'base' THEN bn ELSE tn END ELSE name END AS name,
  CASE WHEN take IS NOT NULL AND (conflict IN ('ConcurrentAdd', 'DeleteModify') OR cb) THEN CASE take WHEN 'mine' THEN mb WHEN 'base' THEN bb ELSE tb END ELSE bal END AS bal
FROM r""")
def merge_resolved(spark: SparkSession, d: str) -> DataFrame:
    m = merged(spark, d)
    k = F.col("c_custkey") % 4
    choices = m.select("c_custkey", F.when(k == 0, "mine").when(k == 1, "base").when(k == 2, "theirs").alias("take")).where("take is not null")
    return merge.resolve(m, choices, "c_custkey", ["name", "bal"])


# --- graphs: orders -> customers -> nations -> regions, and three edges back


def edges(spark: SparkSession, d: str) -> DataFrame:
    n, c, o = t(spark, d, "nation"), t(spark, d, "customer"), t(spark, d, "orders")
    to = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    out = n.select(to("n", F.col("n_nationkey")).alias("src"), to("r", F.col("n_regionkey")).alias("dst"), F.lit("BLOCK").alias("policy"))
    out = out.union(c.select(to("c", F.col("c_custkey")), to("n", F.col("c_nationkey")), F.lit("CASCADE")))
    policy = F.element_at(F.array(F.lit("CASCADE"), F.lit("SET_NULL"), F.lit("BLOCK")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    out = out.union(o.select(to("o", F.col("o_orderkey")), to("c", F.col("o_custkey")), policy))
    return out.union(t(spark, d, "region").where("r_regionkey < 3").select(to("r", F.col("r_regionkey")), to("c", F.col("r_regionkey") + 1), F.lit("SET_NULL")))


EDGES = """
e AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'BLOCK' AS policy FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'CASCADE' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'CASCADE' WHEN 1 THEN 'SET_NULL' ELSE 'BLOCK' END FROM orders
  UNION ALL SELECT 'r' || r_regionkey, 'c' || (r_regionkey + 1), 'SET_NULL' FROM region WHERE r_regionkey < 3)
"""


@query("WITH RECURSIVE " + EDGES + """, w AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT dst FROM w JOIN e ON src = node) SELECT node FROM w""")
def deps_closure(spark: SparkSession, d: str) -> DataFrame:
    roots = t(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.dependencies(edges(spark, d), roots)


@query("WITH RECURSIVE " + EDGES + """, w AS (SELECT src AS node FROM e WHERE dst IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 6 = 0) UNION SELECT src FROM w JOIN e ON dst = node) SELECT node FROM w""")
def dependents_changed(spark: SparkSession, d: str) -> DataFrame:
    seeds = t(spark, d, "nation").where("n_nationkey % 6 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.dependents_changed(edges(spark, d), seeds)


@query("WITH RECURSIVE " + EDGES + """
, w AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 20 = 0 UNION SELECT src FROM w JOIN e ON dst = node AND policy = 'CASCADE'),
o AS (SELECT src, max(policy = 'BLOCK') AS b FROM e WHERE dst IN (FROM w) AND src NOT IN (FROM w) AND policy <> 'CASCADE' GROUP BY 1)
SELECT node, 'delete' AS action FROM w UNION ALL SELECT src, CASE WHEN b THEN 'block' ELSE 'set_null' END FROM o""")
def delete_plan(spark: SparkSession, d: str) -> DataFrame:
    gone = t(spark, d, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.plan_delete(edges(spark, d), gone)


@query("WITH RECURSIVE " + EDGES + """, g AS (SELECT src, dst FROM e WHERE policy <> 'BLOCK' UNION SELECT dst, src FROM e WHERE policy <> 'BLOCK'), w AS (SELECT 'n3' AS node UNION SELECT dst FROM w JOIN g ON src = node) SELECT node FROM w""")
def impact(spark: SparkSession, d: str) -> DataFrame:
    seeds = t(spark, d, "nation").where("n_nationkey = 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.impact(edges(spark, d).where("policy <> 'BLOCK'"), seeds)


# --- identities and edits


@query("""
WITH c AS (SELECT c_custkey AS row_no, c_name AS key, CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 31 = 0 THEN 'zz' WHEN c_custkey % 37 = 0 THEN md5('3:' || (c_custkey + 1)) ELSE md5('3:' || c_custkey) END AS raw FROM customer),
s AS (
  SELECT row_no, raw, CASE WHEN raw NOT IN ('', 'zz') THEN CASE WHEN count(*) OVER (PARTITION BY raw) > 1 THEN 'Duplicated' WHEN row_no % 41 = 0 OR (row_no % 37 = 0 AND row_no < (SELECT max(c_custkey) FROM customer)) THEN 'Renamed' ELSE 'Retained' END
    WHEN row_no % 41 <> 0 THEN 'Recovered' WHEN raw = '' THEN 'PendingNew' ELSE 'Invalid' END AS status FROM c)
SELECT row_no, 3 AS table_id, status, CASE WHEN status IN ('Retained', 'Renamed') THEN raw WHEN status = 'Recovered' THEN md5('3:' || row_no) END AS row_guid,
  CASE WHEN status IN ('Duplicated', 'Invalid') THEN 3 WHEN status = 'Recovered' THEN 1 ELSE 0 END AS severity FROM s""")
def identity_scan(spark: SparkSession, d: str) -> DataFrame:
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    raw = F.when(k % 29 == 0, "").when(k % 31 == 0, "zz").when(k % 37 == 0, guid(3, k + 1)).otherwise(guid(3, k))
    rows = c.select(k.alias("row_no"), F.lit(3).alias("table_id"), raw.alias("raw_guid"), F.col("c_name").alias("key"))
    known = c.select(F.lit(3).alias("table_id"), guid(3, k).alias("row_guid"), F.when(k % 41 == 0, F.concat("c_name", F.lit("~old"))).otherwise(F.col("c_name")).alias("key"))
    return identity.scan(rows, known)


@query("""
SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL OR o_custkey % 8 = 0 THEN NULL ELSE c_name || '/' || c_nationkey END AS new_key, CASE WHEN c.c_custkey IS NULL OR o_custkey % 8 = 0 THEN 'ref.absent' END AS error
FROM orders LEFT JOIN customer c ON o_custkey = c_custkey""")
def rekey(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    old = c.select(guid(3, F.col("c_custkey")).alias("row_guid"), F.col("c_custkey").cast("string").alias("key"))
    new = c.where("c_custkey % 8 <> 0").select(guid(3, F.col("c_custkey")).alias("row_guid"), F.concat_ws("/", "c_name", F.col("c_nationkey").cast("string")).alias("key"))
    refs = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"))
    return identity.rekey(old, new, refs).select("o_orderkey", "new_key", "error")


@query("""
WITH m AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 1 ELSE -(c_custkey - c_custkey % 4) END AS new_key FROM customer WHERE c_custkey % 3 = 0),
w AS (SELECT new_key, count(*) AS n FROM m GROUP BY 1)
SELECT m.key, m.new_key, CASE WHEN m.new_key IN (SELECT c_custkey FROM customer) AND m.new_key NOT IN (SELECT key FROM m) THEN 'move.taken' WHEN w.n > 1 THEN 'move.wanted_twice' END AS error
FROM m JOIN w USING (new_key)""")
def move_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    k = F.col("key")
    moves = rows.where("key % 3 = 0").select("key", F.when(k % 6 == 0, k + 1).otherwise(-(k - k % 4)).alias("new_key"))
    return identity.move(rows, moves)


@query("""
WITH RECURSIVE w AS (SELECT p_partkey, p_name AS key, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_partkey, key, CASE WHEN i = 0 THEN key ELSE key || '_' || CASE WHEN i = 1 THEN 1 ELSE i + 1 END END AS free_key FROM w""")
def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    wanted = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("key"))
    taken = wanted.select(F.concat("key", F.lit("_2")).alias("key")).distinct()
    return identity.unique_keys(wanted, taken, "p_partkey").select("p_partkey", "key", "free_key")


@query("""
SELECT o_orderkey, o_orderstatus, (SELECT max(o_custkey) FROM orders b WHERE b.o_orderstatus = a.o_orderstatus) + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS row_number FROM orders a""")
def append_positions(spark: SparkSession, d: str) -> DataFrame:
    """Every order appended behind the rows of its table, which stand at the numbers of their customers."""
    o = t(spark, d, "orders")
    return identity.append_positions(o.select("o_orderkey", "o_orderstatus"), o.select("o_orderstatus", F.col("o_custkey").alias("row_number")), "o_orderstatus", "row_number", "o_orderkey")


# --- releases

ORDERS = Table(6, "orders", (Field(1, "o_orderkey", "int64", key_order=1), Field(2, "customer", "string", ref_table=3), Field(3, "o_orderstatus"), Field(4, "o_orderpriority", targets=("server",))))


def client_release(spark: SparkSession, d: str) -> DataFrame:
    refs = t(spark, d, "orders").withColumn("key", F.col("o_custkey").cast("string"))
    targets = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), guid(3, F.col("c_custkey")).alias("row_guid"))
    o = references.resolve(refs, targets).withColumnRenamed("row_guid", "customer")
    rows = o.select(guid(6, F.col("o_orderkey")).alias("row_guid"), cells.encode_key(F.col("o_orderkey").cast("string")).alias("key"), *[F.col(f.name) for f in ORDERS.fields])
    return release.build(rows, ORDERS, "client")


RELEASE = """
r AS (SELECT md5('6:' || o_orderkey) AS row_guid, length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey AS key, o_orderkey, md5('3:' || o_custkey) AS customer, o_orderstatus FROM orders),
records AS (
  SELECT 6 AS table_id, row_guid, key, 'orders/' || key AS path, 1 AS field, CAST(o_orderkey AS VARCHAR) AS value FROM r
  UNION ALL SELECT 6, row_guid, key, 'orders/' || key, 2, customer FROM r UNION ALL SELECT 6, row_guid, key, 'orders/' || key, 3, o_orderstatus FROM r)
"""


@query("WITH " + RELEASE + "SELECT * FROM records")
def release_client(spark: SparkSession, d: str) -> DataFrame:
    return client_release(spark, d)


@query("WITH " + RELEASE + """
, h AS (SELECT substr(row_guid, 1, 8) AS bucket, sha256(concat(length(CAST(table_id AS VARCHAR)), ':', table_id, ';', length(row_guid), ':', row_guid, ';', length(key), ':', key, ';', length(path), ':', path, ';', length(CAST(field AS VARCHAR)), ':', field, ';', length(value), ':', value, ';')) AS h FROM records),
b8 AS (SELECT bucket, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY 1),
b6 AS (SELECT substr(b8.bucket, 1, 6) AS bucket, sha256(string_agg(digest, '' ORDER BY b8.bucket)) AS digest FROM b8 GROUP BY 1),
b4 AS (SELECT substr(b6.bucket, 1, 4) AS bucket, sha256(string_agg(digest, '' ORDER BY b6.bucket)) AS digest FROM b6 GROUP BY 1),
b AS (SELECT substr(b4.bucket, 1, 2) AS bucket, sha256(string_agg(digest, '' ORDER BY b4.bucket)) AS digest FROM b4 GROUP BY 1)
SELECT sha256(string_agg(digest, '' ORDER BY bucket)) AS content_hash FROM b""")
def release_hash(spark: SparkSession, d: str) -> DataFrame:
    return release.root_hash(release.content_hash(client_release(spark, d)))


@query("""SELECT code, n FROM (VALUES ('release.no_identity', 0), ('release.duplicate_key', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1))), ('release.duplicate_field', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1))), ('release.no_key', 0), ('release.duplicate_identity', 0), ('release.dangling', (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey % 4 = 0)), ('release.no_schema', 0), ('release.findings', (SELECT count(*) FROM part WHERE p_size > 40))) x(code, n)""")
def release_checks(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber")
    records = lines.select(F.lit(7).alias("table_id"), F.concat_ws("|", key, "l_partkey").alias("row_guid"), key.alias("key"), F.lit(1).alias("field"))
    parts = t(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.lit(4), F.col("s_suppkey").cast("string"), F.col("s_suppkey").cast("string"), F.lit(1))
    edges = lines.select(F.lit(4).alias("dst_table"), F.col("l_suppkey").cast("string").alias("dst_guid"))
    findings = t(spark, d, "part").select(F.when(F.col("p_size") > 40, 2).otherwise(1).alias("severity"))
    return release.validate(records.union(parts), edges, "01ab", findings)


# --- migration and schemas


def long_cells(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select((F.col("p_partkey") % 10).cast("string").alias("workbook_id"), F.lit(5).alias("table_id"), F.col("p_partkey").cast("string").alias("row_guid"), F.col("p_size").cast("string").alias("size"), "p_brand", F.col("p_partkey").alias("k"))
    state = F.when(F.col("k") % 9 == 0, "Missing").when(F.col("k") % 8 == 0, "Defaulted").otherwise("Value")
    a = p.select(*migration.KEYS, F.lit("size").alias("field_path"), state.alias("state"), F.when(F.col("k") % 9 != 0, F.col("size")).alias("text"))
    b = p.where("k % 5 = 0").select(*migration.KEYS, F.lit("size_mm").alias("field_path"), F.lit("Value").alias("state"), F.concat("size", F.lit("0")).alias("text"))
    return a.union(b)


STEPS = [
    migration.Step(1, "to_mm", 5, "size", "size_mm", lambda x: F.concat(x, F.lit("0"))),
    migration.Step(2, "to_um", 5, "size_mm", "size_um", lambda x: F.concat(x, F.lit("000"))),
]
MIGRATE = """
WITH s AS (SELECT CAST(p_partkey % 10 AS VARCHAR) AS workbook_id, 5 AS table_id, CAST(p_partkey AS VARCHAR) AS row_guid, p_partkey AS k, CAST(p_size AS VARCHAR) AS size FROM part),
o AS (
  SELECT *, 'to_mm' AS step, CASE WHEN k % 9 = 0 OR k % 8 = 0 OR k % 5 = 0 THEN 'Skipped' ELSE 'Converted' END AS outcome FROM s
  UNION ALL SELECT *, 'to_um', 'Converted' FROM s WHERE k % 5 = 0 OR NOT (k % 9 = 0 OR k % 8 = 0))
"""


@query(MIGRATE + "SELECT step, outcome, count(*) AS n FROM o GROUP BY ALL")
def migrate_counts(spark: SparkSession, d: str) -> DataFrame:
    return migration.outcomes(long_cells(spark, d), STEPS).groupBy("step", "outcome").agg(F.count("*").alias("n"))


@query(MIGRATE + """
SELECT workbook_id, table_id, row_guid, 'size' AS field_path, CASE WHEN k % 9 = 0 THEN 'Missing' WHEN k % 8 = 0 THEN 'Defaulted' ELSE 'Value' END AS state, CASE WHEN k % 9 <> 0 THEN size END AS text FROM s
UNION ALL SELECT workbook_id, table_id, row_guid, 'size_mm', 'Value', size || '0' FROM s WHERE k % 5 = 0 OR NOT (k % 9 = 0 OR k % 8 = 0)
UNION ALL SELECT workbook_id, table_id, row_guid, 'size_um', 'Value', size || '0000' FROM s WHERE k % 5 = 0 OR NOT (k % 9 = 0 OR k % 8 = 0)""")
def migrate_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = long_cells(spark, d)
    return migration.apply(rows, migration.outcomes(rows, STEPS))


def catalog_fields(spark: SparkSession, d: str) -> DataFrame:
    """parts as the fields of many tables: table p_size, field p_partkey."""
    k = F.col("p_partkey")
    own = F.when(k % 6 == 0, F.array(F.lit("client"), F.lit("editor"))).when(k % 7 == 0, F.array(F.lit("client"), F.lit("client"))).when(k % 11 == 0, F.array(F.lit("Client"))).otherwise(F.array(F.lit("client"), F.lit("server")))
    return t(spark, d, "part").select(
        F.col("p_size").alias("table_id"), (k - 10).cast("int").alias("field_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.when(k % 4 == 0, "list").otherwise("scalar").alias("shape"),
        F.when(k % 10 == 0, (k % 3).cast("int")).alias("key_order"), own.alias("targets"), F.array(F.lit("client"), F.lit("server")).alias("table_targets"),
    )


@query("""
WITH f AS (SELECT p_size AS table_id, CAST(p_partkey - 10 AS INTEGER) AS field_id, p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN CAST(p_partkey % 3 AS INTEGER) END AS key_order FROM part)
SELECT table_id, field_id, 'field.id' AS rule FROM f WHERE field_id <= 0
UNION ALL SELECT table_id, field_id, 'key.shape' FROM f WHERE key_order IS NOT NULL AND k % 4 = 0
UNION ALL SELECT table_id, field_id, 'target.grammar' FROM f WHERE k % 6 <> 0 AND k % 7 <> 0 AND k % 11 = 0
UNION ALL SELECT table_id, field_id, 'target.repeated' FROM f WHERE k % 6 <> 0 AND k % 7 = 0
UNION ALL SELECT table_id, field_id, 'target.not_in_table' FROM f WHERE k % 6 = 0 OR (k % 7 <> 0 AND k % 11 = 0)
UNION ALL SELECT table_id, field_id, 'key.not_in_all_targets' FROM f WHERE key_order IS NOT NULL AND (k % 6 = 0 OR k % 7 = 0 OR k % 11 = 0)
UNION ALL SELECT table_id, min(field_id), 'key.order_repeated' FROM f WHERE key_order IS NOT NULL GROUP BY table_id, key_order HAVING count(*) > 1
UNION ALL SELECT table_id, NULL, 'table.no_key' FROM f GROUP BY table_id HAVING count(key_order) = 0""")
def lint_catalog(spark: SparkSession, d: str) -> DataFrame:
    return schema.lint_fields(catalog_fields(spark, d))


@query("""
WITH p AS (SELECT p_size AS table_id, p_partkey AS field_id, p_name AS name, p_type AS type FROM part WHERE p_partkey % 5 <> 0),
n AS (SELECT p_size AS table_id, p_partkey AS field_id, CASE WHEN p_partkey % 7 = 0 THEN p_name || '2' ELSE p_name END AS name, CASE WHEN p_partkey % 11 = 0 THEN 'OTHER' ELSE p_type END AS type, p_partkey % 2 = 0 AS required, p_partkey % 4 = 0 AS has_default, p_partkey % 9 = 0 AS reserved FROM part WHERE p_partkey % 8 <> 0),
j AS (SELECT coalesce(p.table_id, n.table_id) AS table_id, coalesce(p.field_id, n.field_id) AS field_id, p.name AS pn, n.name AS nn, p.type AS pt, n.type AS nt, required, has_default, coalesce(reserved, false) AS r, n.name IS NOT NULL AND NOT coalesce(reserved, false) AS live FROM p FULL JOIN n ON p.table_id = n.table_id AND p.field_id = n.field_id)
SELECT table_id, field_id, 'added' AS change, CASE WHEN required AND NOT has_default THEN 2 ELSE 0 END AS severity FROM j WHERE pn IS NULL AND live
UNION ALL SELECT table_id, field_id, 'removed', CASE WHEN r THEN 1 ELSE 3 END FROM j WHERE pn IS NOT NULL AND NOT live
UNION ALL SELECT table_id, field_id, 'renamed', 0 FROM j WHERE live AND pn <> nn
UNION ALL SELECT table_id, field_id, 'retyped', 3 FROM j WHERE live AND pt <> nt""")
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    f = t(spark, d, "part").select(F.col("p_size").alias("table_id"), F.col("p_partkey").alias("field_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    k = F.col("field_id")
    prev = f.where("field_id % 5 <> 0").withColumn("reserved", F.lit(False))
    now = f.where("field_id % 8 <> 0").withColumn("name", F.when(k % 7 == 0, F.concat("name", F.lit("2"))).otherwise(F.col("name"))).withColumn("type", F.when(k % 11 == 0, "OTHER").otherwise(F.col("type")))
    now = now.withColumn("required", k % 2 == 0).withColumn("has_default", k % 4 == 0).withColumn("reserved", k % 9 == 0)
    return schema.diff_fields(prev, now)


@query("""
WITH r AS (SELECT user_id AS project, CAST(event_id % 3 AS INTEGER) AS version, max(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END) AS severity, bool_or(event_type = 'view') AS viewed FROM events GROUP BY 1, 2),
o(operation, ceiling, needs) AS (VALUES ('check', 3, ''), ('convert', 1, ''), ('publish', 0, 'view'), ('review', 2, 'view'))
SELECT project, version, operation, NOT (severity > ceiling OR (needs <> '' AND NOT viewed)) AS allowed, CASE WHEN severity > ceiling THEN 'severity' WHEN needs <> '' AND NOT viewed THEN 'evidence' END AS reason FROM r CROSS JOIN o""")
def gate(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    kind = F.col("event_type")
    reports = e.select(F.col("user_id").alias("project"), (F.col("event_id") % 3).cast("int").alias("version"), F.when(kind == "click", 1).when(kind == "purchase", 2).otherwise(0).alias("severity"), kind.alias("evidence"))
    rules = spark.createDataFrame([("check", 3, ""), ("convert", 1, ""), ("publish", 0, "view"), ("review", 2, "view")], "operation string, ceiling int, needs string")
    return schema.gate(reports, rules)


@query("""
WITH r AS (SELECT l_suppkey AS owner, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) % 9 AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY owner ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM r),
i AS (SELECT *, sum(CASE WHEN a <= h + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY a, b) AS g FROM m)
SELECT owner, min(a) AS first, max(b) AS last FROM i GROUP BY owner, g""")
def merge_reserved(spark: SparkSession, d: str) -> DataFrame:
    return schema.merge_reserved(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("first"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint") % 9).alias("last")))


# --- search and reports


@query("""
SELECT p_partkey, p_name AS key FROM part WHERE lower(p_name) LIKE '%a%' AND lower(p_name) LIKE '%e%' AND p_size % 3 IN (0, 1) AND p_brand <> 'x' AND (p_partkey % 4 = 0 OR p_partkey % 4 = 1)
  AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 3)""")
def search_rows(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    rows = p.select("p_partkey", F.col("p_name").alias("key"), (F.col("p_size") % 3).cast("string").alias("type"), F.array((F.col("p_partkey") % 4).cast("string")).alias("labels"), F.concat_ws("/", F.lit("parts"), F.col("p_brand")).alias("path"), F.col("p_partkey").cast("string").alias("row_guid"))
    found = t(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("src_guid"), F.concat(F.lit("lines/"), F.col("l_linenumber").cast("string")).alias("dst_path"))
    return search.search(rows, "A e t:zero t:1 l:0 l:1 ref:3", {"zero": "0"}, ["parts"], found).select("p_partkey", "key")


@query("""
SELECT c_mktsegment AS table_name, count(*) AS n, CAST(count_if(c_custkey % 5 = 0) AS BIGINT) AS n_dirty, CAST(count_if(c_custkey % 35 = 0) AS BIGINT) AS n_conflicted, CAST(count_if(c_acctbal < 0) AS BIGINT) AS n_error
FROM customer WHERE contains(lower(c_name), '1') AND c_nationkey % 4 IN (1, 2) AND contains(CAST(c_acctbal AS VARCHAR), '7') GROUP BY 1""")
def browse_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose key holds a 1, with one of two labels, and whose display name holds a 7."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(F.col("c_mktsegment").alias("table_name"), F.col("c_name").alias("key"), F.lit("3").alias("type"), F.array((F.col("c_nationkey") % 4).cast("string")).alias("labels"), F.lit("w/t").alias("path"), F.col("c_acctbal").cast("string").alias("display_name"), (k % 5 == 0).alias("dirty"), (k % 35 == 0).alias("conflicted"), (F.col("c_acctbal") < 0).alias("error"))
    return search.browse(c, "table_name", text="1 l:1 l:2", display="7")


@query("""SELECT c_mktsegment AS table_name, count(*) AS n, CAST(count_if(c_custkey % 5 = 0) AS BIGINT) AS n_dirty, CAST(count_if(c_custkey % 35 = 0) AS BIGINT) AS n_conflicted, CAST(count_if(c_acctbal < 0) AS BIGINT) AS n_error FROM customer GROUP BY 1""")
def browse(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_mktsegment").alias("table_name"), (F.col("c_custkey") % 5 == 0).alias("dirty"), (F.col("c_custkey") % 35 == 0).alias("conflicted"), (F.col("c_acctbal") < 0).alias("error"))
    return search.browse(c, "table_name")


@query("""
SELECT CAST(l_suppkey % 10 AS INTEGER) AS workbook_id, count(*) AS n_rows, CAST(count_if(l_orderkey % 13 <> 0 AND l_orderkey % 17 <> 0 AND (l_orderkey % 19 = 0 OR l_orderkey % 23 = 0)) AS BIGINT) AS unparseable, CAST(count_if(l_orderkey % 29 = 0) AS BIGINT) AS pending FROM lineitem GROUP BY 1""")
def data_facts(spark: SparkSession, d: str) -> DataFrame:
    x = dirty(F.col("l_orderkey"), F.col("l_quantity").cast("bigint").cast("string"))
    rows = cells.parse_columns(t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", x.alias("x")), {"c": (F.col("x"), None, Field(1, "q", "int64"))})
    return rows.groupBy((F.col("l_suppkey") % 10).cast("int").alias("workbook_id")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("c.state") == "Invalid").alias("unparseable"), F.count_if(F.col("l_orderkey") % 29 == 0).alias("pending"))


@query("""
WITH d AS (
  SELECT o_orderstatus AS op, 1 AS severity FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderstatus, 2 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderstatus, 3 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0)
SELECT op, max(severity) AS exit_code, CAST(0 AS BIGINT) AS infos, CAST(count_if(severity = 1) AS BIGINT) AS warnings, CAST(count_if(severity = 2) AS BIGINT) AS errors, CAST(count_if(severity = 3) AS BIGINT) AS blockers FROM d GROUP BY 1""")
def report(spark: SparkSession, d: str) -> DataFrame:
    rules = {"row.large": (1, F.col("o_totalprice") > 200000), "row.fifth": (2, F.col("o_orderkey") % 5 == 0), "row.closed": (3, (F.col("op") == "F") & (F.col("o_orderkey") % 7 == 0))}
    return checks.summarize(checks.diagnostics(t(spark, d, "orders").withColumn("op", F.col("o_orderstatus")), rules, "op"), "op")


# --- streams, here over batch frames; tests run them on streams as well


def notices(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_id").alias("seq"), F.md5(F.col("event_type").cast("binary")).alias("fingerprint"), F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), (F.col("event_id") % 4 + 1).cast("int")).alias("flag"))


@query("""
WITH n AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, event_id AS seq, md5(event_type) AS fingerprint FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, seq) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM n),
w AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY ts, seq) AS k FROM g)
SELECT path, min(ts) AS began, count(*) AS n, arg_max(fingerprint, (ts, seq)) AS fingerprint FROM w GROUP BY path, k""")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return stream.debounce(notices(spark, d), "6 hours")


@query("""SELECT CAST(user_id AS VARCHAR) AS path, max(event_id) AS seq, md5(arg_max(event_type, event_id)) AS fingerprint FROM events GROUP BY 1""")
def newest(spark: SparkSession, d: str) -> DataFrame:
    return stream.newest(notices(spark, d))


@query("""SELECT date_trunc('hour', ts) AS at, CAST(bit_or(1 << CAST(event_id % 4 AS INTEGER)) AS INTEGER) AS flags FROM events GROUP BY 1""")
def triggers(spark: SparkSession, d: str) -> DataFrame:
    return stream.triggers(notices(spark, d), "1 hour")


@query("""
WITH n AS (
  SELECT user_id % 10 AS path, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS seq, event_id, event_id + CASE WHEN event_id % 5 = 0 THEN 1500 ELSE 0 END AS "at" FROM events),
s AS (SELECT *, count(*) OVER g AS size, row_number() OVER (g ORDER BY event_id) AS row_no FROM n WINDOW g AS (PARTITION BY path, seq)),
d AS (SELECT path, seq, max("at") AS "at" FROM s WHERE NOT (seq % 7 = 0 AND row_no = 2) GROUP BY path, seq HAVING count(*) = max(size))
SELECT path, CAST(seq AS BIGINT) AS seq, "at", seq = max(seq) OVER (PARTITION BY path ORDER BY "at" RANGE UNBOUNDED PRECEDING) AS published FROM d""")
def snapshot_order(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot a path and day, whose rows arrive late, not in order, or for some days never."""
    at = F.col("event_id") + F.when(F.col("event_id") % 5 == 0, 1500).otherwise(0)
    rows = t(spark, d, "events").select((F.col("user_id") % 10).alias("path"), F.datediff(F.to_date("ts"), F.lit("2020-01-01")).cast("long").alias("seq"), at.alias("at"), "event_id")
    of = Window.partitionBy("path", "seq")
    rows = rows.withColumn("size", F.count("*").over(of)).withColumn("row_no", F.row_number().over(of.orderBy("event_id")))
    return stream.publication_order(rows.where("not (seq % 7 = 0 and row_no = 2)"))


@query("""
WITH p AS (
  SELECT user_id AS path, event_id AS point, 1 << CAST(event_id % 4 AS INTEGER) AS flag, CASE row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 6 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS hold, event_id % 3 <> 0 AS ok FROM events),
a AS (SELECT *, ok AND sum(hold) OVER (PARTITION BY path ORDER BY point) <= 0 AS able FROM p),
r AS (SELECT *, coalesce(sum(CAST(able AS INTEGER)) OVER (PARTITION BY path ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a)
SELECT path, max(point) AS point, CAST(bit_or(flag) AS INTEGER) AS flags FROM r GROUP BY path, run HAVING bool_or(able)""")
def drained_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Publication points of which a third is refused, and batches of edits over every sixth to eighth."""
    n = F.row_number().over(Window.partitionBy("path").orderBy("point")) % 6
    points = notices(spark, d).select(F.col("path").cast("long").alias("path"), F.col("seq").alias("point"), "flag", (F.col("seq") % 3 != 0).alias("ok"))
    return stream.drain_triggers(points.withColumn("hold", F.when(n == 1, 1).when(n == 3, -1).otherwise(0)))


@query("""
WITH n AS (SELECT event_id * 7919 % 1000003 AS node, event_id // 4096 AS g FROM events)
SELECT node, min(node) OVER (PARTITION BY g) AS root FROM n""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Events linked to the one before, in chains of 4,096 whose nodes are numbered without order. The numbers begin again after 1,000,003
    events, so a node is a number and its event, as one bigint (ids of up to 42 bits)."""
    number = F.col("event_id") * 7919 % 1000003
    e = t(spark, d, "events").select(number.alias("number"), (number * (1 << 43) + F.col("event_id")).alias("at"), "event_id")
    before = F.lag("at").over(Window.partitionBy(F.floor(F.col("event_id") / 4096)).orderBy("event_id"))
    roots = graph.components(e.where("event_id is not null").select(F.coalesce(before, "at").alias("src"), F.col("at").alias("dst")))
    root = F.shiftright(F.col("root") + (1 << 42), 43)
    return e.select("number", F.col("at").alias("node")).join(roots, "node", "left").select(F.col("number").alias("node"), root.alias("root"))


# --- drafts and lookups


def draft_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers at revision key % 3, and drafts: additions under new keys, and by modulus deletions, edits and additions of what exists."""
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select("c_custkey", (k % 3).cast("bigint").alias("revision"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    kind = F.when(k % 13 == 0, "delete").when(k % 5 == 0, "edit").when(k % 17 == 0, "add")
    old = rows.select("c_custkey", kind.alias("kind"), F.when(k % 10 == 0, F.concat("name", F.lit("M"))).otherwise(F.col("name")).alias("name"), (F.col("nation") + 1).alias("nation")).where("kind is not null")
    new = rows.where("c_custkey % 7 = 0").select(-k - 1, F.when(k % 2 == 0, "add").otherwise("edit"), "name", "nation")
    return rows, old.union(new)


DRAFTS = """
WITH r AS (SELECT c_custkey AS k, c_custkey % 3 AS revision, c_name AS name, c_nationkey AS nation FROM customer),
d AS (
  SELECT k, CASE WHEN k % 13 = 0 THEN 'delete' WHEN k % 5 = 0 THEN 'edit' ELSE 'add' END AS kind, CASE WHEN k % 10 = 0 THEN name || 'M' ELSE name END AS name, nation + 1 AS nation
  FROM r WHERE k % 13 = 0 OR k % 5 = 0 OR k % 17 = 0
  UNION ALL SELECT -k - 1, CASE WHEN k % 2 = 0 THEN 'add' ELSE 'edit' END, name, nation FROM r WHERE k % 7 = 0)
"""


@query(DRAFTS + """
SELECT r.k AS c_custkey, CASE WHEN d.kind = 'edit' THEN r.revision + 1 ELSE r.revision END AS revision, CASE WHEN d.kind = 'edit' THEN d.name ELSE r.name END AS name,
       CASE WHEN d.kind = 'edit' THEN d.nation ELSE r.nation END AS nation, coalesce(d.kind = 'edit', false) AS dirty
FROM r LEFT JOIN d USING (k) WHERE d.kind IS DISTINCT FROM 'delete'
UNION ALL SELECT k, 0, name, nation, true FROM d WHERE k < 0 AND kind = 'add'""")
def draft_overlay(spark: SparkSession, d: str) -> DataFrame:
    return drafts.overlay(*draft_rows(spark, d), "c_custkey", ["name", "nation"])


@query(DRAFTS + """SELECT k AS c_custkey, CASE WHEN k >= 0 THEN 'draft.taken' ELSE 'draft.absent' END AS code FROM d WHERE (k >= 0 AND kind = 'add') OR (k < 0 AND kind = 'edit')""")
def draft_errors(spark: SparkSession, d: str) -> DataFrame:
    return drafts.errors(*draft_rows(spark, d), "c_custkey")


@query(DRAFTS + """
SELECT k AS c_custkey, CASE WHEN kind = 'add' THEN 'Added' WHEN kind = 'delete' THEN 'Deleted' WHEN k % 10 = 0 THEN 'Renamed' ELSE 'Modified' END AS change_kind
FROM d WHERE (k >= 0 AND kind <> 'add') OR (k < 0 AND kind = 'add')""")
def commit_kinds(spark: SparkSession, d: str) -> DataFrame:
    return drafts.commit_kinds(*draft_rows(spark, d), "c_custkey", "name", ["nation"])


@query("""SELECT CAST(c_nationkey AS INTEGER) AS workbook_id, md5('3:' || c_custkey) AS row_guid FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 = 0""")
def guid_owned_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("workbook_id"), guid(3, F.col("c_custkey")).alias("row_guid"))
    own = rows.withColumn("workbook_id", F.when(F.col("c_custkey") % 3 == 0, F.col("workbook_id") + 100).otherwise(F.col("workbook_id")))
    return drafts.owned_elsewhere(rows.drop("c_custkey"), own.drop("c_custkey"), rows.where("c_custkey % 4 = 0"))


@query("""
SELECT s_suppkey, 'server' AS target, 'removed' AS change, 1 AS severity FROM supplier WHERE s_nationkey % 2 = 0
UNION ALL SELECT s_suppkey, 'tools', 'added', 0 FROM supplier WHERE s_nationkey % 3 = 0""")
def target_changes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey")
    after = F.array_compact(F.array(F.lit("client"), F.when(n % 2 != 0, "server"), F.when(n % 3 == 0, "tools")))
    return drafts.target_changes(t(spark, d, "supplier").select("s_suppkey", F.array(F.lit("client"), F.lit("server")).alias("before"), after.alias("after")), "s_suppkey")


@query("""SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def patch_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return drafts.patch_conflicts(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN c_name END AS name, o_custkey % 10 <> 0 AS exists FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def lookup_rows(spark: SparkSession, d: str) -> DataFrame:
    live = t(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.lit(3).alias("table_id"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    wanted = t(spark, d, "orders").select("o_orderkey", F.lit(3).alias("table_id"), F.col("o_custkey").alias("key"))
    return lookups.lookup(live, wanted, "table_id", "key").select("o_orderkey", "name", "exists")


@query("""SELECT DISTINCT 'w' || c_nationkey AS path FROM customer UNION SELECT DISTINCT 'w' || c_nationkey || '/' || c_mktsegment FROM customer""")
def containers(spark: SparkSession, d: str) -> DataFrame:
    return lookups.containers(t(spark, d, "customer").select(F.concat(F.lit("w"), "c_nationkey", F.lit("/"), "c_mktsegment", F.lit("/"), "c_name").alias("path")))


@query("""SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total, 'Truncated' AS status FROM orders ORDER BY o_orderkey LIMIT 100""")
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    return lookups.table_rows(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100)


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1""")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return lookups.first_wins(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", ["l_linenumber", "l_partkey"])


@query("""SELECT md5('0:' || s_suppkey) AS row_guid, CAST(2 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS n FROM supplier JOIN customer ON s_suppkey = c_custkey""")
def guids_in_tables(spark: SparkSession, d: str) -> DataFrame:
    known = t(spark, d, "supplier").select(F.lit(4).alias("table_id"), guid(0, F.col("s_suppkey")).alias("row_guid"))
    return lookups.guids_in_tables(known.union(t(spark, d, "customer").select(F.lit(3), guid(0, F.col("c_custkey")))))


@query("""SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS deps FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1""")
def dependency_sets(spark: SparkSession, d: str) -> DataFrame:
    made = lookups.dependency_sets(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey")
    return made.select("l_orderkey", F.array_join(F.col("deps").cast("array<string>"), ",").alias("deps"))


@query("""
SELECT o_orderkey, o_orderkey % 5 <> 0 AS sound, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE concat(o_custkey, ';;', '"a;b"') END AS written,
       o_orderkey % 7 <> 0 AS named_sound, CASE WHEN o_orderkey % 7 <> 0 THEN concat('id=', o_custkey, ';tag=', o_orderstatus) END AS named FROM orders""")
def join_structs(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.concat(F.when(k % 5 == 0, "x").otherwise(c), F.when(k % 2 == 0, " ; ;").otherwise(';;"a;b"'))
    named = F.concat(F.lit("tag="), "o_orderstatus", F.lit("; id = +"), c, F.when(k % 7 == 0, ";other=1").otherwise(""))
    rows = t(spark, d, "orders").withColumn("s", cells.parse_join_struct(text, ";", {"id": "int64", "n": "int32", "note": "string"})).withColumn("m", cells.parse_named_struct(named, ";", "=", {"id": "int64", "tag": "string"}))
    return rows.select("o_orderkey", F.col("s").isNotNull().alias("sound"), cells.write_join_struct(F.col("s"), ";", ["id", "n", "note"]).alias("written"), F.col("m").isNotNull().alias("named_sound"), cells.write_named_struct(F.col("m"), ";", "=", ["id", "tag"]).alias("named"))
