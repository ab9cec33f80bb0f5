"""Registered queries over typed cells, references, releases, snapshots, schemas, moves and intake, beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.catalog import Catalog, Field, Table
from rowledger.functions import cells
from rowledger.operators import changes, drafts, identity, intake, lint_graph, migration, references, release, schema
from rowledger.project_queries import QUERIES, SQL
from rowledger.project_queries import pick
from rowledger.queries import dirty, guid, query, t
from rowledger.registry import Format, Registry

__all__ = ["QUERIES", "SQL"]


# --- cells


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, rtrim(CAST(o_orderkey AS VARCHAR), '0') AS d, o_totalprice FROM orders),
s AS (SELECT *, substr(d, 1, 1) || CASE WHEN length(d) > 1 THEN '.' || substr(d, 2) ELSE '' END AS m FROM o)
SELECT o_orderkey, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS plain, CASE WHEN o_orderkey = 0 THEN '0' ELSE m || 'E+' || (19 + length(k)) END AS large,
       CASE WHEN o_orderkey = 0 THEN '-0' ELSE '-' || m || 'E-' || lpad(CAST(13 - length(k) AS VARCHAR), 2, '0') END AS small, k || '00000' AS whole
FROM s""".replace("\\\\", "\\"))
def double_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    text = lambda x: cells.canonicalize(x, "double")
    o = t(spark, d, "orders")
    return o.select("o_orderkey", text(F.col("o_totalprice").cast("string")).alias("plain"), text(F.concat(k, F.lit("e20"))).alias("large"), text(F.concat(F.lit("-"), k, F.lit(".0E-12"))).alias("small"), text(F.concat(F.lit(" +"), k, F.lit("e5"))).alias("whole")).withColumn("whole", F.when(F.col("o_orderkey") == 0, "000000").otherwise(F.col("whole")))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '😀' ELSE c_name END AS n, c_custkey % 7 = 0 AS gone, c_custkey % 11 = 0 AS no_nation FROM customer)
SELECT c_custkey, CASE WHEN NOT gone AND NOT no_nation THEN concat(length(CAST(c_custkey AS VARCHAR)), ':', c_custkey, '|', length(n) + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END, ':', n, '|2:de') END AS key,
  CASE WHEN gone THEN 'key.missing' WHEN no_nation THEN 'key.null' END AS error, CASE WHEN gone THEN 'name' WHEN no_nation THEN 'lang' END AS field,
  CASE WHEN NOT gone AND NOT no_nation THEN n END AS name, CAST(CASE WHEN NOT gone AND NOT no_nation THEN 3 END AS INTEGER) AS parts, c_custkey % 5 <> 0 AND NOT gone AND NOT no_nation AS sound
FROM c""")
def row_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of parsed cells, their parts again, and whether a damaged key is refused (every fifth is cut short)."""
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, "").when(k % 3 == 0, F.concat("c_name", F.lit("😀"))).otherwise(F.col("c_name"))
    rows = t(spark, d, "customer").select("c_custkey", name.alias("n"), F.when(k % 11 == 0, "~").otherwise("").alias("l"))
    parsed = cells.parse_columns(rows, {"id": (k.cast("string"), None, Field(1, "id", "int64")), "name": (F.col("n"), None, Field(2, "name")), "lang": (F.col("l"), None, Field(3, "lang", default="de"))})
    made = parsed.withColumn("k", cells.build_key(("id", F.col("id")), ("name", F.col("name")), ("lang", F.col("lang")))).select("c_custkey", "k.*")
    cut = F.when(k % 5 == 0, F.substr("key", F.lit(1), F.length("key") - 1)).otherwise(F.col("key"))
    made = made.withColumn("p", cells.decode_key(F.col("key"))).withColumn("q", cells.decode_key(cut))
    return made.select("c_custkey", "key", "error", "field", F.get("p", F.lit(1)).alias("name"), F.when(F.col("p").isNotNull(), F.size("p")).alias("parts"), F.col("q").isNotNull().alias("sound"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 5 AS s, CAST(l_partkey AS VARCHAR) AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE s WHEN 0 THEN '<missing>' WHEN 1 THEN '<default:' || x || '>' WHEN 2 THEN '<null>' WHEN 3 THEN x ELSE '<invalid:' || x || '>' END AS shown,
       CASE s WHEN 0 THEN '' WHEN 2 THEN '~' WHEN 4 THEN NULL ELSE x END AS written, CASE WHEN l_orderkey % 3 = 0 THEN '=A' || x WHEN s = 0 THEN '' ELSE x END AS compared,
       CAST(CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN l_partkey WHEN 2 THEN NULL ELSE 4294967295 END AS BIGINT) AS revision,
       l_partkey % 3 <> 1 AND l_partkey % 5 <> 0 AS identity_sound, CAST(CASE WHEN l_partkey % 3 <> 1 AND l_partkey % 5 <> 0 THEN l_partkey END AS INTEGER) AS table_id, l_linenumber % 2 = 1 AS target_sound
FROM l""")
def cell_texts(spark: SparkSession, d: str) -> DataFrame:
    """Printed, written and compared texts, revisions, identities and target tags of every line."""
    k, x = F.col("l_partkey"), F.col("l_partkey").cast("string")
    state = pick(F.col("l_orderkey"), "Missing", "Defaulted", "Null", "Value", "Invalid")
    text = F.when(state.isin("Defaulted", "Value"), x)
    revision = cells.parse_revision(F.when(k % 4 == 1, x).when(k % 4 == 2, F.concat(F.lit("-"), x)).when(k % 4 == 3, "4294967295"))
    found = cells.parse_identity(F.concat(F.when(k % 3 == 0, F.concat(F.lit(" +"), x)).when(k % 3 == 1, F.concat(x, F.lit(".0"))).otherwise(x), F.lit(":"), F.when(k % 5 == 0, F.lit("0" * 32)).otherwise(guid(5, k))))
    rows = t(spark, d, "lineitem").withColumn("i", found)
    compared = cells.comparison_text(F.when(F.col("l_orderkey") % 5 != 0, x), F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("A"), x)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", cells.display_value(state, text, x).alias("shown"), cells.write_cell(state, text).alias("written"), compared.alias("compared"), revision.alias("revision"), F.col("i").isNotNull().alias("identity_sound"), F.col("i.table_id").alias("table_id"), cells.valid_target(pick(F.col("l_linenumber"), "Client", "web-2")).alias("target_sound"))


@query("""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('{"a":{"x":', user_id, ',"y":[3,1]},"t":"', event_type, '"}') END AS json,
       CASE WHEN event_id % 4 = 0 THEN concat('"a=b"=', user_id, ';"c;d"=2') ELSE concat('"a=b"=', user_id) END AS pairs FROM events""")
def canonical_texts(spark: SparkSession, d: str) -> DataFrame:
    """JSON with its keys sorted at every level, and maps whose keys and values hold either separator."""
    user = F.col("user_id").cast("string")
    text = F.concat(F.lit('{ "t" : "'), "event_type", F.lit('", "a": {"y":[3, 1],"x":'), user, F.lit("} }"))
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), text)).otherwise(text)
    m = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("c;d"), F.lit("2"), F.lit("a=b"), user)).otherwise(F.create_map(F.lit("a=b"), user))
    written = cells.write_join_map(m, ";", "=")
    return t(spark, d, "events").select("event_id", cells.canonical_json(text).alias("json"), F.when(F.map_contains_key(cells.parse_join_map(written, ";", "="), "a=b"), written).alias("pairs"))


@query("""
SELECT o_orderkey, sha256(concat('1:6', length(CAST(o_orderkey % 3 AS VARCHAR)), ':', o_orderkey % 3, '4:custf', length(CAST(o_custkey AS VARCHAR)) + 1, ':=', o_custkey, '6:statusv1:', o_orderstatus)) AS hash FROM orders""")
def business_hashes(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda text, formula: F.struct(text.alias("text"), formula.alias("formula"))
    none = F.lit(None).cast("string")
    row = F.create_map(F.lit("status"), cell(F.col("o_orderstatus"), none), F.lit("cust"), cell(F.lit("7"), F.col("o_custkey").cast("string")))
    return t(spark, d, "orders").select("o_orderkey", cells.business_hash(F.lit(6), F.col("o_orderkey") % 3, row).alias("hash"))


# --- references: orders name customers, and suppliers through a group

REFS = """
r AS (
  SELECT o_orderkey, o_custkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'x' WHEN o_orderkey % 17 = 0 THEN 'none' WHEN o_orderkey % 2 = 0 THEN 'buyer' ELSE 'party' END AS field,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '3|' || o_custkey WHEN o_orderkey % 5 = 0 THEN '4:' || o_custkey ELSE '3:' || o_custkey END AS token FROM orders),
s AS (SELECT r.*, CAST(CASE WHEN token LIKE '4:%' THEN 4 WHEN token LIKE '3:%' THEN 3 END AS INTEGER) AS tid FROM r),
e AS (SELECT *, CASE WHEN token IS NULL THEN NULL WHEN tid IS NULL THEN 'ref.malformed' WHEN field IN ('x', 'none') THEN 'ref.no_target' WHEN tid = 4 AND field = 'buyer' THEN 'ref.wrong_table'
  WHEN (tid = 3 AND k % 10 = 0) OR (tid = 4 AND k NOT IN (SELECT s_suppkey FROM supplier)) THEN 'ref.unresolved' WHEN tid = 3 AND k % 11 = 0 THEN 'ref.ambiguous' END AS error FROM s)
"""


def declared(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    fields = spark.createDataFrame([("buyer", "Customer", None), ("party", None, "parties"), ("x", None, "nobody"), ("none", "Region", None)], "field string, ref_table string, ref_group string")
    tables = spark.createDataFrame([(3, "Customer", "crm.Customer", "asset"), (4, "Supplier", "crm.Supplier", "asset"), (1, "Region", "geo.Region", "embedded")], "table_id int, name string, full_name string, kind string")
    return fields, tables, spark.createDataFrame([("parties", 3), ("parties", 4)], "ref_group string, table_id int")


def named(spark: SparkSession, d: str) -> DataFrame:
    """Customers without every tenth, every eleventh twice; suppliers."""
    row = lambda df, table, k: df.select(F.lit(table).alias("table_id"), cells.encode_key(k.cast("string")).alias("key"), guid(table, k).alias("row_guid"))
    c = t(spark, d, "customer").where("c_custkey % 10 <> 0")
    again = c.where("c_custkey % 11 = 0").select(F.lit(3), cells.encode_key(F.col("c_custkey").cast("string")), guid(30, F.col("c_custkey")))
    return row(c, 3, F.col("c_custkey")).union(again).union(row(t(spark, d, "supplier"), 4, F.col("s_suppkey")))


def token_refs(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    field = F.when(k % 13 == 0, "x").when(k % 17 == 0, "none").when(k % 2 == 0, "buyer").otherwise("party")
    token = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.concat(F.lit("3|"), c)).when(k % 5 == 0, F.concat(F.lit("4:"), c)).otherwise(F.concat(F.lit("3:"), c))
    return t(spark, d, "orders").select("o_orderkey", field.alias("field"), token.alias("token"))


@query("WITH " + REFS + """
SELECT o_orderkey, field, CASE WHEN token IS NOT NULL AND error IS NULL THEN tid END AS dst_table, CASE WHEN token IS NOT NULL AND error IS NULL THEN md5(tid || ':' || k) END AS dst_guid,
       CASE WHEN error IS NULL THEN token END AS canonical, error FROM e""")
def typed_refs(spark: SparkSession, d: str) -> DataFrame:
    found = references.resolve_tokens(token_refs(spark, d), named(spark, d), references.eligible_tables(*declared(spark)))
    return found.drop("token")


@query("""
WITH m AS (SELECT c_custkey AS k, c_custkey % 8 = 0 AS gone, c_custkey % 9 = 0 AS twice FROM customer)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 5 = 0 OR m.k IS NULL OR gone OR twice THEN token ELSE '3:n' || m.k || '%2F1' END AS new_token,
       CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 5 = 0 THEN NULL WHEN m.k IS NULL OR gone THEN 'ref.absent' WHEN twice THEN 'key.ambiguous' END AS error
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN '4:' ELSE '3:' END || o_custkey AS token FROM orders) o LEFT JOIN m ON o_custkey = m.k""")
def rewritten_refs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens after every customer got a new key; formulas and other tables' tokens stay."""
    k = F.col("c_custkey")
    moved = t(spark, d, "customer").where("c_custkey % 8 <> 0").select(F.lit(3).alias("table_id"), cells.encode_key(k.cast("string")).alias("key"), cells.encode_key(F.concat(F.lit("n"), k.cast("string"), F.lit("/1"))).alias("new_key"), F.when(k % 9 == 0, "key.ambiguous").alias("error"))
    o = F.col("o_orderkey")
    refs = t(spark, d, "orders").select("o_orderkey", F.concat(F.when(o % 5 == 0, "4:").otherwise("3:"), F.col("o_custkey").cast("string")).alias("token"), F.when(o % 6 == 0, "A1").alias("formula"))
    return references.rewrite_tokens(refs, moved).select("o_orderkey", "new_token", "error")


# --- releases of two tables, with references between them

CUSTOMERS = Table(3, "customers", (Field(1, "id", "int64", key_order=1), Field(2, "segment"), Field(3, "balance", "double", targets=("server",)), Field(4, "home"), Field(5, "home.nation", "int32", targets=("client",)), Field(6, "note.text"), Field(7, "note", targets=("server",))))
ORDERS = Table(6, "orders", (Field(1, "id", "int64", key_order=1), Field(2, "customer", ref_table=3), Field(3, "status")))
SERVER_ONLY = Table(8, "events", (Field(1, "id", "int64", key_order=1),), targets=("server",))
SHOP = Catalog((CUSTOMERS, ORDERS, SERVER_ONLY))


def shop(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows and values of customers (every tenth not indexable) and orders (every ninth without identity)."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    key = lambda k: cells.encode_key(k.cast("string")).alias("key")
    customers, orders = t(spark, d, "customer"), t(spark, d, "orders")
    own = F.when(o % 9 != 0, guid(6, o))
    rows = customers.select(F.lit(3).alias("table_id"), guid(3, c).alias("row_guid"), key(c), (c % 10 != 0).alias("indexable")).union(orders.select(F.lit(6), own, key(o), F.lit(True)))
    rows = rows.union(t(spark, d, "events").select(F.lit(8), guid(8, F.col("event_id")), key(F.col("event_id")), F.lit(True)))
    value = lambda name, text, state="Value": F.struct(F.lit(name).alias("property_path"), (F.lit(state) if isinstance(state, str) else state).alias("state"), text.cast("string").alias("text"))
    of_c = F.array(value("id", c), value("segment", F.col("c_mktsegment"), F.when(c % 4 == 0, "Null").otherwise("Value")), value("balance", F.col("c_nationkey")), value("home", F.lit("{}"), "Defaulted"), value("home.nation", F.col("c_nationkey")), value("note.text", F.lit("x")), value("note", F.lit("{}")))
    of_o = F.array(value("id", o), value("customer", F.concat(F.lit("3:"), F.col("o_custkey").cast("string"))), value("status", F.col("o_orderstatus")))
    values = customers.select(F.lit(3).alias("table_id"), guid(3, c).alias("row_guid"), F.explode(of_c).alias("v")).union(orders.select(F.lit(6), own, F.explode(of_o)))
    return rows, values.select("table_id", "row_guid", "v.*")


@query("""
WITH c AS (SELECT md5('3:' || c_custkey) AS g, length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey AS key, * FROM customer WHERE c_custkey % 10 <> 0),
o AS (SELECT md5('6:' || o_orderkey) AS g, length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey AS key, * FROM orders WHERE o_orderkey % 9 <> 0),
r AS (
  SELECT 3 AS table_id, g AS row_guid, key, 'customers/' || key AS path, 1 AS field, CAST(c_custkey AS VARCHAR) AS value FROM c UNION ALL SELECT 3, g, key, 'customers/' || key, 2, c_mktsegment FROM c WHERE c_custkey % 4 <> 0
  UNION ALL SELECT 3, g, key, 'customers/' || key, 4, '{}' FROM c UNION ALL SELECT 3, g, key, 'customers/' || key, 5, CAST(c_nationkey AS VARCHAR) FROM c
  UNION ALL SELECT 6, g, key, 'orders/' || key, 1, CAST(o_orderkey AS VARCHAR) FROM o UNION ALL SELECT 6, g, key, 'orders/' || key, 3, o_orderstatus FROM o
  UNION ALL SELECT 6, g, key, 'orders/' || key, 2, '3:' || md5('3:' || o_custkey) FROM o WHERE o_custkey % 10 <> 0)
SELECT 'record' AS part, table_id, row_guid, path, CAST(field AS VARCHAR) AS name, value FROM r
UNION ALL SELECT 'dependency', 6, g, NULL, '3', md5('3:' || o_custkey) FROM o WHERE o_custkey % 10 <> 0
UNION ALL SELECT 'blocker', 6, g, NULL, 'customer', 'ref.unresolved' FROM o WHERE o_custkey % 10 = 0""")
def release_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Records, dependencies and blockers of the client's release; its fields inside a server's struct stay out."""
    records, dependencies, blockers = release.assemble(*shop(spark, d), SHOP, "client")
    none = F.lit(None).cast("string")
    out = records.select(F.lit("record").alias("part"), "table_id", "row_guid", "path", F.col("field").cast("string").alias("name"), "value")
    out = out.union(dependencies.select(F.lit("dependency"), "table_id", "row_guid", none, F.col("dst_table").cast("string"), "dst_guid"))
    return out.union(blockers.select(F.lit("blocker"), "table_id", "row_guid", none, "property_path", "code"))


# --- snapshots

SNAPSHOTS = """
WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'Missing' ELSE 'Resident' END AS state, c_custkey % 4 + 1 AS generation, c_name AS name, c_nationkey AS nation, c_mktsegment AS seg FROM customer),
n AS (
  SELECT k, CASE WHEN k % 7 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN k % 5 = 0 THEN nation + 1 ELSE nation END AS nation, CASE WHEN k % 13 = 0 THEN 'other' ELSE seg END AS seg FROM p WHERE k % 4 <> 0
  UNION ALL SELECT -k - 1, name, nation, seg FROM p WHERE k % 3 = 0),
j AS (SELECT coalesce(p.k, n.k) AS k, state, generation, p.name AS pn, n.name AS nn, p.nation AS pa, n.nation AS na, p.seg AS ps, n.seg AS ns, n.k IS NOT NULL AS here, state = 'Resident' AND n.k IS NOT NULL AS bt FROM p FULL JOIN n ON p.k = n.k),
x AS (SELECT *, coalesce(bt, false) AS b, CASE WHEN state IS NULL THEN 1 WHEN coalesce(bt, false) AND ps <> ns THEN generation + 1 ELSE generation END AS g FROM j)
"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every sixth customer is a tombstone; the next version lacks every fourth, edits others and has new rows."""
    k = F.col("c_custkey")
    p = t(spark, d, "customer").select(F.lit(3).alias("table_id"), guid(3, k).alias("row_guid"), F.when(k % 6 == 0, "Missing").otherwise("Resident").alias("state"), (k % 4 + 1).alias("generation"), F.concat(F.lit("c/"), "c_name").alias("path"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), k.alias("k"))
    k = F.col("k")
    n = p.where("k % 4 <> 0").select("table_id", "row_guid", "path", F.when(k % 7 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), F.when(k % 5 == 0, F.col("nation") + 1).otherwise(F.col("nation")).alias("nation"), F.when(k % 13 == 0, "other").otherwise(F.col("seg")).alias("seg"))
    new = p.where("k % 3 = 0").select("table_id", guid(3, -k - 1).alias("row_guid"), "path", "name", "nation", "seg")
    return p.drop("k"), n.union(new)


def committed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    same_segment = F.col("p_seg").eqNullSafe(F.col("n_seg"))
    return changes.commit_snapshot(*snapshots(spark, d), "path", "name", ["nation", "seg"], "seg", same_segment)


@query(SNAPSHOTS + """
SELECT md5('3:' || k) AS row_guid, g AS generation, 'Removed' AS kind FROM x WHERE NOT here AND state = 'Resident'
UNION ALL SELECT md5('3:' || k), g, 'Added' FROM x WHERE here AND (state IS NULL OR state = 'Missing')
UNION ALL SELECT md5('3:' || k), g, 'Recreated' FROM x WHERE b AND ps <> ns
UNION ALL SELECT md5('3:' || k), g, 'Renamed' FROM x WHERE b AND ps = ns AND pn <> nn
UNION ALL SELECT md5('3:' || k), g, 'PropertyChanged' FROM x WHERE b AND ps = ns AND pa <> na""")
def snapshot_events(spark: SparkSession, d: str) -> DataFrame:
    return committed(spark, d)[1].select("row_guid", "generation", "kind")


@query(SNAPSHOTS + """
SELECT md5('3:' || k) AS row_guid, CASE WHEN here THEN 'Resident' ELSE 'Missing' END AS state, g AS generation, CASE WHEN here THEN nn ELSE pn END AS name, CASE WHEN here THEN na ELSE pa END AS nation FROM x""")
def snapshot_entries(spark: SparkSession, d: str) -> DataFrame:
    return committed(spark, d)[0].select("row_guid", "state", "generation", "name", "nation")


@query("""
WITH l AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN 'g:' || md5('6:' || o_orderkey) ELSE 'p:6:' || (o_orderkey % 50) END AS identity, o_orderkey % 50 AS row_number, 'k' || o_custkey AS key, o_orderstatus AS s, o_orderkey AS k FROM orders),
f AS (SELECT identity, arg_min(key, (row_number, key, s)) AS key, arg_min(s, (row_number, key, s)) AS s FROM l GROUP BY 1),
r AS (SELECT identity, arg_min(key, (row_number, key, s)) AS key, arg_min(s, (row_number, key, s)) AS s FROM (SELECT identity, row_number, key, CASE WHEN k % 4 = 0 THEN 'Z' ELSE s END AS s FROM l WHERE k % 7 <> 0) GROUP BY 1),
j AS (SELECT coalesce(f.identity, r.identity) AS identity, f.key AS pk, r.key AS nk, f.s AS ps, r.s AS ns FROM f FULL JOIN r ON f.identity = r.identity)
SELECT identity, '' AS property, 'added' AS kind, pk AS before, nk AS after FROM j WHERE pk IS NULL UNION ALL SELECT identity, '', 'removed', pk, nk FROM j WHERE nk IS NULL
UNION ALL SELECT identity, '$key', 'renamed', pk, nk FROM j WHERE pk <> nk UNION ALL SELECT identity, 'status', 'modified', ps, ns FROM j WHERE ps <> ns""")
def workbook_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows without identity pair by table and row number."""
    k = F.col("o_orderkey")
    left = t(spark, d, "orders").select(F.lit(6).alias("table_id"), F.when(k % 9 != 0, guid(6, k)).alias("row_guid"), (k % 50).alias("row_number"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key"), F.lit("s").alias("location"), F.col("o_orderstatus").alias("status"), k.alias("k"))
    right = left.where("k % 7 <> 0").withColumn("status", F.when(F.col("k") % 4 == 0, "Z").otherwise(F.col("status")))
    return changes.diff_workbooks(left.drop("k"), right.drop("k"), ["status"])


# --- schemas: parts as fields, their sizes as tables


@query("""
WITH p AS (SELECT CAST(c_custkey AS INTEGER) AS id, c_custkey AS k, 'n' || c_custkey AS fn, CASE WHEN c_custkey % 9 = 0 THEN 'retired' WHEN c_custkey % 8 = 0 THEN 'embedded' ELSE 'asset' END AS kind FROM customer WHERE c_custkey % 6 <> 0),
n AS (SELECT CAST(c_custkey AS INTEGER) AS id, c_custkey AS k, 'n' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END AS fn, CASE WHEN c_custkey % 10 = 0 THEN 'retired' WHEN c_custkey % 16 = 0 THEN 'embedded' ELSE 'asset' END AS kind, c_custkey % 4 = 0 AS rekeyed, c_custkey % 3 = 0 AS web FROM customer WHERE c_custkey % 5 <> 1),
j AS (SELECT p.kind AS was, n.kind AS now, p.fn AS pf, n.fn AS nf, coalesce(n.fn, p.fn) AS tab, coalesce(n.k, p.k) AS k, rekeyed, web FROM (SELECT *, CASE WHEN kind = 'embedded' THEN 'n:' || fn ELSE 't:' || id END AS i FROM p) p FULL JOIN (SELECT *, CASE WHEN kind = 'embedded' THEN 'n:' || fn ELSE 't:' || id END AS i FROM n) n ON p.i = n.i)
SELECT fn AS tab, 'table.kind' AS change, 3 AS severity FROM p JOIN n USING (fn) WHERE p.kind <> n.kind AND p.kind <> 'retired' AND n.kind <> 'retired'
UNION ALL SELECT tab, 'table.added', 0 FROM j WHERE was IS NULL AND now = 'asset'
UNION ALL SELECT tab, 'table.renamed', 0 FROM j WHERE was IN ('asset', 'retired') AND now IN ('asset', 'retired') AND NOT (was = 'retired' AND now = 'asset') AND pf <> nf
UNION ALL SELECT tab, 'table.retired', 1 FROM j WHERE was = 'asset' AND now = 'retired'
UNION ALL SELECT tab, 'table.tombstone_missing', 3 FROM j WHERE was IN ('asset', 'retired') AND now IS NULL
UNION ALL SELECT tab, 'table.reactivated', 3 FROM j WHERE was = 'retired' AND now = 'asset'
UNION ALL SELECT tab, 'table.key', CASE WHEN was = 'asset' AND k % 25 <> 24 AND EXISTS (FROM orders WHERE o_custkey = j.k) THEN 3 ELSE 0 END FROM j WHERE was = now AND was <> 'retired' AND rekeyed
UNION ALL SELECT tab, 'table.target.added', 0 FROM j WHERE was = now AND was <> 'retired' AND web
UNION ALL SELECT tab, 'table.target.removed', 1 FROM j WHERE was = now AND was <> 'retired' AND web""".replace(" AS tab,", " AS \"table\",").replace("SELECT tab,", "SELECT \"table\","))
def schema_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tables; those that orders name hold rows."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    name = F.concat(F.lit("n"), k.cast("string"))
    numbers = lambda *x: F.array(*map(F.lit, x))
    columns = lambda full, kind, keys, targets: [k.cast("int").alias("table_id"), full.alias("full_name"), F.lit("t").alias("name"), F.lit("s").alias("sheet"), kind.alias("kind"), keys.alias("keys"), targets.alias("targets")]
    prev = c.where("c_custkey % 6 <> 0").select(*columns(name, F.when(k % 9 == 0, "retired").when(k % 8 == 0, "embedded").otherwise("asset"), numbers(1, 2), numbers("client", "server")))
    now = c.where("c_custkey % 5 <> 1").select(*columns(F.when(k % 7 == 0, F.concat(name, F.lit("x"))).otherwise(name), F.when(k % 10 == 0, "retired").when(k % 16 == 0, "embedded").otherwise("asset"), F.when(k % 4 == 0, numbers(2, 1)).otherwise(numbers(1, 2)), F.when(k % 3 == 0, numbers("client", "web")).otherwise(numbers("client", "server"))))
    filled = t(spark, d, "orders").where("o_custkey % 25 <> 24").select(F.col("o_custkey").cast("int").alias("table_id")).distinct()
    return schema.diff_tables(prev, now, filled, True)


@query("""
WITH j AS (
  SELECT p_size AS table_id, CAST(p_partkey AS VARCHAR) AS field_path, p_partkey AS k, p_partkey % 5 <> 0 AS was, p_partkey % 8 <> 0 AND p_partkey % 9 <> 0 AS live, p_partkey % 8 <> 0 AND p_partkey % 9 = 0 AS reserved,
    CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'f0' END AS pf, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'f1' WHEN 2 THEN 'f2' ELSE 'f0' END AS nf FROM part),
b AS (SELECT *, was AND live AS bt, pf IS NOT NULL AND nf IS NOT NULL AND was AND live AS formats FROM j)
SELECT table_id, field_path, 'field.added' AS change, CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN 2 ELSE 0 END AS severity FROM b WHERE NOT was AND live
UNION ALL SELECT table_id, field_path, 'field.removed', CASE WHEN reserved THEN 1 ELSE 3 END FROM b WHERE was AND NOT live
UNION ALL SELECT table_id, field_path, 'field.renamed', 0 FROM b WHERE bt AND k % 13 = 0
UNION ALL SELECT table_id, field_path, 'field.changed', 3 FROM b WHERE bt AND k % 11 = 0
UNION ALL SELECT table_id, field_path, 'format.in_place', 3 FROM b WHERE bt AND pf IS DISTINCT FROM nf AND (pf IS NULL OR nf IS NULL OR k % 7 = 2)
UNION ALL SELECT table_id, field_path, 'format.migrating', 1 FROM b WHERE formats AND k % 7 = 1
UNION ALL SELECT table_id, field_path, 'format.legacy_added', 0 FROM b WHERE formats AND k % 3 = 0
UNION ALL SELECT table_id, field_path, 'format.legacy_removed', CASE WHEN k % 4 = 1 THEN 0 ELSE 3 END FROM b WHERE formats AND k % 10 = 1
UNION ALL SELECT table_id, field_path, 'field.target.added', 0 FROM b WHERE bt AND k % 17 = 0""")
def schema_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    p = t(spark, d, "part").select(F.col("p_size").alias("table_id"), k.cast("string").alias("field_path"), "p_name", "p_type", k.alias("k"))
    k = F.col("k")
    prev = p.where("k % 5 <> 0").select("table_id", "field_path", F.col("p_name").alias("name"), F.col("p_type").alias("signature"), F.when(k % 6 != 0, "f0").alias("format"), F.when(k % 10 == 1, texts("old")).alias("legacy"), texts("client").alias("targets"), F.lit(False).alias("reserved"))
    legacy = F.concat(F.when(k % 7 == 1, texts("f0")).otherwise(texts()), F.when(k % 3 == 0, texts("new")).otherwise(texts()))
    now = p.where("k % 8 <> 0").select(
        "table_id", "field_path", F.when(k % 13 == 0, "other").otherwise(F.col("p_name")).alias("name"), F.when(k % 11 == 0, "other").otherwise(F.col("p_type")).alias("signature"), F.when(k % 7 == 1, "f1").when(k % 7 == 2, "f2").when(k % 7 != 0, "f0").alias("format"), legacy.alias("legacy"),
        F.when(k % 17 == 0, texts("client", "web")).otherwise(texts("client")).alias("targets"), (k % 2 == 0).alias("required"), (k % 4 == 0).alias("has_default"), (k % 9 == 0).alias("reserved"),
    )
    return schema.diff_declared(prev, now, p.where("k % 4 = 1").select("table_id", "field_path"))


@query("""
WITH p AS (SELECT l_suppkey AS enum, l_partkey % 40 AS number, 'v' || (l_partkey % 40) AS name FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY ALL),
n AS (SELECT l_suppkey AS enum, l_partkey % 60 AS number, 'v' || (l_partkey % 60) || CASE WHEN l_partkey % 60 % 7 = 0 THEN 'x' ELSE '' END AS name FROM lineitem WHERE l_suppkey % 8 <> 0 AND l_partkey % 60 % 5 <> 0 GROUP BY ALL),
e AS (SELECT DISTINCT enum FROM p INTERSECT SELECT DISTINCT enum FROM n),
j AS (SELECT coalesce(p.enum, n.enum) AS enum, coalesce(p.number, n.number) AS number, p.name AS pn, n.name AS nn FROM p FULL JOIN n ON p.enum = n.enum AND p.number = n.number)
SELECT enum, number, 'value.added' AS change, 0 AS severity FROM j SEMI JOIN e USING (enum) WHERE pn IS NULL
UNION ALL SELECT enum, number, 'value.renamed', 0 FROM j SEMI JOIN e USING (enum) WHERE pn <> nn
UNION ALL SELECT enum, number, 'value.removed', CASE WHEN number BETWEEN 20 AND 30 AND enum % 2 = 0 THEN 1 ELSE 3 END FROM j SEMI JOIN e USING (enum) WHERE nn IS NULL""")
def schema_enums(spark: SparkSession, d: str) -> DataFrame:
    lines, k = t(spark, d, "lineitem"), F.col("l_partkey")
    values = lambda df, n, name: df.select(F.col("l_suppkey").alias("enum"), n.alias("number"), name.alias("name")).distinct()
    v = lambda n: F.concat(F.lit("v"), n.cast("string"))
    prev = values(lines.where("l_suppkey % 9 <> 0"), k % 40, v(k % 40))
    now = values(lines.where("l_suppkey % 8 <> 0 and l_partkey % 60 % 5 <> 0"), k % 60, F.concat(v(k % 60), F.when(k % 60 % 7 == 0, "x").otherwise("")))
    held = lines.where("l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("enum"), F.explode(F.array(F.lit(20), F.lit(25))).alias("first")).distinct().withColumn("last", F.col("first") + 5)
    return schema.diff_enums(prev, now, held)


@query("""
WITH r AS (SELECT user_id AS project, event_id % 3 AS version, min(event_id) % 5 <> 0 AS ok, min(event_id) % 4 <> 0 AS history, max(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END) AS severity, bool_or(event_id % 7 = 0) AS outdated, bool_or(event_id % 11 = 0) AS partial, bool_or(event_id % 2 = 0) AS most FROM events GROUP BY 1, 2),
o(operation, ceiling, history_needed, needs, bans) AS (VALUES ('schema_build', 3, false, '', ''), ('generate_dry_run', 99, false, '', ''), ('generate_apply', 3, true, 'fresh_plan', ''), ('import_check', 99, false, '', ''), ('save', 2, false, 'stable_source', ''), ('normalize', 3, false, 'fresh_plan', ''),
  ('convert', 2, true, 'migration', 'o'), ('publish', 2, true, 'migration', 'oc'), ('runtime_open', 2, false, 'runtime_identity', ''), ('destructive_apply', 3, true, 'fresh_plan', 'c'), ('purge', 3, true, 'fresh_plan', 'c'), ('rekey', 3, true, 'fresh_plan', 'c'), ('data_loss_migration', 3, true, 'fresh_plan', 'c')),
x AS (SELECT *, CASE WHEN NOT ok THEN CASE WHEN operation NOT IN ('generate_dry_run', 'import_check') THEN 'format' END WHEN operation IN ('generate_dry_run', 'import_check') THEN NULL WHEN history_needed AND NOT history THEN 'history' WHEN severity >= ceiling THEN 'severity'
  WHEN needs <> '' AND NOT most THEN 'evidence.' || needs WHEN bans LIKE 'o%' AND outdated THEN 'schema.outdated' WHEN bans LIKE '%c' AND partial THEN 'coverage.incomplete' END AS reason FROM r CROSS JOIN o)
SELECT project, version, operation, reason IS NULL AS allowed, severity, reason FROM x""")
def gated_operations(spark: SparkSession, d: str) -> DataFrame:
    """Users as projects: every report against the thirteen operations; some have all evidence, some none."""
    e = t(spark, d, "events").select(F.col("user_id").alias("project"), (F.col("event_id") % 3).alias("version"), "event_id", "event_type")
    i = F.col("event_id")
    reports = e.groupBy("project", "version").agg(F.min("event_id").alias("i")).select("project", "version", F.when(F.col("i") % 5 == 0, 2).otherwise(1).alias("format"), (F.col("i") % 4 != 0).alias("history"))
    code = F.when(i % 7 == 0, "schema.outdated").otherwise("other")
    severity = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    findings = e.select("project", "version", code.alias("code"), severity.alias("severity")).union(e.where("event_id % 11 = 0").select("project", "version", F.lit("coverage.incomplete"), F.lit(0)))
    flags = sorted({f for _, _, _, needs, _ in schema.OPERATIONS for f in needs})
    evidence = e.where("event_id % 2 = 0").select("project", "version", F.explode(F.array(*map(F.lit, flags))).alias("flag"))
    return schema.gate_operations(reports, findings, evidence)


# --- moves and children


@query("""
WITH m AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
SELECT 'row' AS part, md5('3:' || c_custkey) AS row_guid, CASE WHEN c_custkey % 3 = 0 THEN length('m' || c_custkey) || ':m' || c_custkey ELSE length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey END AS key,
       CASE WHEN c_custkey % 3 = 0 THEN 'w/t/m' || c_custkey ELSE 'w/t/' || c_custkey END AS path, c_custkey % 3 = 0 AS flag FROM customer
UNION ALL SELECT 'order', md5('6:' || o_orderkey), length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey, 'w/o/' || o_orderkey, o_custkey % 3 = 0 AND EXISTS (FROM m WHERE k = o_custkey) FROM orders
UNION ALL SELECT 'reference', md5('6:' || o_orderkey), CASE WHEN EXISTS (FROM m WHERE k = o_custkey) THEN '3:m' || o_custkey ELSE '3:' || o_custkey END, NULL, EXISTS (FROM m WHERE k = o_custkey) FROM orders""")
def moved_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every third customer gets a new path and key; orders that refer to it get its token and are dirty."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    key = lambda x: cells.encode_key(x.cast("string")).alias("key")
    customers, orders = t(spark, d, "customer"), t(spark, d, "orders")
    rows = customers.select(F.lit(3).alias("table_id"), guid(3, c).alias("row_guid"), key(c), F.concat(F.lit("w/t/"), c.cast("string")).alias("path"), F.lit(False).alias("dirty"))
    rows = rows.union(orders.select(F.lit(6), guid(6, o), key(o), F.concat(F.lit("w/o/"), o.cast("string")), F.lit(False)))
    name = F.concat(F.lit("m"), c.cast("string"))
    moves = customers.where("c_custkey % 3 = 0").select(F.concat(F.lit("w/t/"), c.cast("string")).alias("path"), F.concat(F.lit("w/t/"), name).alias("new_path"), cells.encode_key(name).alias("new_key"))
    edges = orders.select(guid(6, o).alias("src_guid"), F.lit("customer").alias("property_path"), F.concat(F.lit("3:"), F.col("o_custkey").cast("string")).alias("token"), guid(3, F.col("o_custkey")).alias("dst_guid"))
    out, refs, _ = identity.move_rows(rows, moves, edges)
    out = out.select(F.when(F.col("table_id") == 3, "row").otherwise("order").alias("part"), "row_guid", "key", "path", F.col("dirty").alias("flag"))
    return out.union(refs.select(F.lit("reference"), "src_guid", "token", F.lit(None).cast("string"), "rewritten"))


@query("""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'w/t/' || (c_custkey + 1) WHEN c_custkey % 7 = 0 THEN 'w/u/' || c_custkey WHEN c_custkey % 11 = 0 THEN 'w/t/same' ELSE 'w/t/n' || c_custkey END AS np FROM customer WHERE c_custkey % 2 = 0),
w AS (SELECT np, count(*) AS n FROM c GROUP BY 1)
SELECT 'w/t/' || k AS path, CASE WHEN np LIKE 'w/u/%' THEN 'move.other_table' WHEN k % 5 = 0 AND k + 1 IN (SELECT c_custkey FROM customer) THEN 'move.taken' WHEN n > 1 THEN 'move.wanted_twice' END AS code
FROM c JOIN w USING (np) WHERE np LIKE 'w/u/%' OR (k % 5 = 0 AND k + 1 IN (SELECT c_custkey FROM customer)) OR n > 1
UNION ALL SELECT 'w/t/' || (-1 - c_custkey), 'move.no_source' FROM customer WHERE c_custkey % 50 = 0""")
def move_errors(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    customers = t(spark, d, "customer")
    text = lambda x: F.concat(F.lit("w/t/"), x.cast("string"))
    rows = customers.select(F.lit(3).alias("table_id"), guid(3, c).alias("row_guid"), cells.encode_key(c.cast("string")).alias("key"), text(c).alias("path"), F.lit(False).alias("dirty"))
    to = F.when(c % 5 == 0, text(c + 1)).when(c % 7 == 0, F.concat(F.lit("w/u/"), c.cast("string"))).when(c % 11 == 0, "w/t/same").otherwise(text(F.concat(F.lit("n"), c.cast("string"))))
    moves = customers.where("c_custkey % 2 = 0").select(text(c).alias("path"), to.alias("new_path"), cells.encode_key(F.concat(F.lit("q"), c.cast("string"))).alias("new_key"))
    moves = moves.union(customers.where("c_custkey % 50 = 0").select(text(-1 - c), text(F.concat(F.lit("z"), c.cast("string"))), cells.encode_key(F.concat(F.lit("z"), c.cast("string")))))
    none = rows.select(F.col("row_guid").alias("src_guid"), F.lit("x").alias("property_path"), F.lit("").alias("token"), F.col("row_guid").alias("dst_guid"))
    return identity.move_rows(rows, moves, none)[2]


@query("""
WITH l AS (SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR) AS m, l_partkey AS p FROM lineitem),
u AS (SELECT k FROM (SELECT k, m, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY k HAVING max(n) = 1)
SELECT md5('6:' || k) AS parent_guid, count(*) AS n, string_agg(m || '=' || p, ';' ORDER BY m) AS items FROM l SEMI JOIN u USING (k) GROUP BY k""")
def child_maps(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select(guid(6, F.col("l_orderkey")).alias("parent_guid"), F.col("l_linenumber").cast("string").alias("map_key"), F.col("l_partkey").alias("part"), F.lit(None).cast("string").alias("error"))
    made = references.aggregate_child_maps(lines, "part")
    return made.select("parent_guid", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform(F.array_sort(F.map_keys("items")), lambda k: F.concat_ws("=", k, F.try_element_at("items", k)["part"].cast("string"))), ";").alias("items"))


# --- intake: lines as the rows of twenty workbooks

LINES = Table(7, "lines", (Field(1, "order", "int64", key_order=1), Field(2, "line", "int32", key_order=2), Field(3, "quantity", "int64", default="7", min=2, max=45, aliases=("amount",)), Field(4, "note", required=True, format="hash", legacy=("bare",))))
OTHER = Table(9, "other", (Field(1, "id", "int64", key_order=1),))
FORMATS = {"hash": Format(lambda x: F.when(x.startswith("#"), F.substr(x, F.lit(2))), lambda x: F.concat(F.lit("#"), x)), "bare": Format(lambda x: F.when(x.rlike("^[0-9x]+$"), x), lambda x: x)}
INTAKE = """
WITH c AS (SELECT 'w' || (l_suppkey % 20) AS path, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 17 = 0 THEN '~' WHEN l_orderkey % 19 = 0 THEN 'x1' WHEN l_orderkey % 23 = 0 THEN '%7E' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS x FROM lineitem),
q AS (SELECT *, CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(x AS BIGINT) END AS v, CASE WHEN p % 6 = 0 THEN '#' || x ELSE x END AS note FROM c),
f AS (SELECT *, CASE WHEN x IN ('', '~') THEN NULL WHEN v IS NULL THEN 'cell.unparseable' WHEN v < 2 THEN 'cell.min' WHEN v > 45 THEN 'cell.max' END AS qe,
  CASE WHEN note IN ('', '~') THEN 'cell.required' WHEN note LIKE '#%' OR regexp_matches(note, '^[0-9x]+$') THEN NULL ELSE 'cell.unparseable' END AS ne, p % 29 = 0 AS badrev, n = 4 AS nokey FROM q)
"""


def staging(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    x = dirty(k, F.col("l_quantity").cast("bigint").cast("string"))
    cell = lambda text: F.struct(text.cast("string").alias("text"), F.lit(None).cast("string").alias("formula"))
    pair = lambda name, text: F.struct((F.lit(name) if isinstance(name, str) else name).alias("key"), cell(text).alias("value"))
    entries = F.array(pair("order", k), pair("line", F.when(F.col("l_linenumber") == 4, "~").otherwise(F.col("l_linenumber").cast("string"))), pair(F.when(p % 2 == 0, "amount").otherwise("quantity"), x), pair("note", F.when(p % 6 == 0, F.concat(F.lit("#"), x)).otherwise(x)))
    rows = t(spark, d, "lineitem").select(F.concat(F.lit("w"), (F.col("l_suppkey") % 20).cast("string")).alias("path"), F.lit("lines").alias("sheet"), p.cast("int").alias("row_number"), F.when(p % 3 != 0, guid(7, F.concat_ws("|", k, "l_linenumber", p))).alias("raw_guid"), F.when(p % 29 == 0, "-1").alias("raw_revision"), F.map_from_entries(entries).alias("cells"))
    return rows


def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    incomplete = spark.createDataFrame([("w3", "lines")], "path string, sheet string")
    return intake.parse_tables(staging(spark, d), Catalog((LINES, OTHER)), FORMATS, incomplete)


@query(INTAKE + """
SELECT path, p AS row_number, CASE WHEN NOT nokey THEN concat(length(CAST(k AS VARCHAR)), ':', k, '|', length(CAST(n AS VARCHAR)), ':', n) END AS key,
       path <> 'w3' AND qe IS NULL AND ne IS NULL AND NOT badrev AND NOT nokey AS indexable, CAST(CASE WHEN badrev THEN NULL ELSE 0 END AS BIGINT) AS revision,
       CASE WHEN x = '' THEN '7' WHEN x <> '~' AND qe IS NULL THEN CAST(v AS VARCHAR) END AS quantity, concat_ws(',', 'quantity:' || qe, 'note:' || ne, CASE WHEN badrev THEN '__rev:row.revision' END, CASE WHEN nokey THEN 'line:key.null' END) AS findings
FROM f""")
def parsed_tables(spark: SparkSession, d: str) -> DataFrame:
    parsed = parsed_lines(spark, d)
    text = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["property_path"], x["code"])), ",")
    return parsed.select("path", F.col("row_number").cast("bigint").alias("row_number"), "key", "indexable", "revision", F.get("values", F.lit(2))["text"].alias("quantity"), text.alias("findings"))


@query(INTAKE + """
SELECT path AS workbook_id, path || '-1' AS revision, path NOT IN ('w3', 'w5') AS mapping_complete, CAST(count_if(qe IS NOT NULL) + count_if(ne = 'cell.unparseable') AS BIGINT) AS unparseable, CAST(count_if(p % 3 = 0) AS BIGINT) AS pending,
       CAST(count_if(ne IS NULL AND note NOT LIKE '#%') AS BIGINT) AS legacy_hits, CAST(count_if(qe IS NOT NULL) + count_if(ne IS NOT NULL) AS BIGINT) AS legacy_errors FROM f GROUP BY path""")
def intake_facts(spark: SparkSession, d: str) -> DataFrame:
    parsed = parsed_lines(spark, d)
    books = parsed.select("path").distinct().select("path", F.concat("path", F.lit("-1")).alias("revision"), F.lit("now").alias("schema_hash"))
    layout = parsed.where("path in ('w3', 'w5')").select("path", F.when(F.col("path") == "w3", "column.missing").otherwise("sheet.unknown").alias("code")).union(parsed.select("path", F.lit("column.unknown")))
    return intake.data_facts(parsed, layout, books)[0].drop("schema_hash")


# --- saves: customers as workbooks


@query("""
SELECT 'w' || c_custkey AS item, CASE WHEN c_custkey % 5 = 0 THEN 'save.source_gone' ELSE 'save.source_changed' END AS code FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 5 = 0 OR c_custkey % 3 = 0)
UNION ALL SELECT 'n' || c_custkey, 'save.conflict_open' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 4 = 0""")
def save_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks that changed or went since they were mounted, and rows to save whose conflict is open."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    book = F.concat(F.lit("w"), k.cast("string")).alias("workbook_id")
    items, mounted = c.where("c_custkey % 2 = 0").select(book), c.select(book, F.col("c_name").alias("fingerprint"))
    now = c.where("c_custkey % 5 <> 0").select(book, F.when(k % 3 == 0, "other").otherwise(F.col("c_name")).alias("fingerprint"))
    node = F.concat(F.lit("n"), k.cast("string")).alias("node")
    sources = drafts.source_blockers(items, mounted, now)
    conflicts = drafts.conflict_blockers(c.where("c_custkey % 7 = 0").select(node), c.where("c_custkey % 4 = 0").select(node))
    return sources.select(F.col("workbook_id").alias("item"), "code").union(conflicts)


# --- plans of migrations


@query("""
WITH w AS (SELECT c_custkey AS workbook_id, CASE c_custkey % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'new' WHEN 2 THEN 'old' ELSE 'other' END AS s, c_custkey % 3 = 0 AS marked, c_custkey % 5 AS revision FROM customer)
SELECT workbook_id, CASE WHEN s = 'old' THEN 'migrate' WHEN s = 'new' AND marked THEN 'done' ELSE 'blocked' END AS action, CASE WHEN s = 'other' THEN 'migration.schema' WHEN s = 'new' AND NOT marked THEN 'migration.markers' END AS code,
       s AS schema_hash, CASE WHEN marked THEN 'to_mm@1,to_um@2' ELSE '' END AS markers, revision FROM w""")
def migration_states(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks before a plan, and as they stay, since some of them block it."""
    k = F.col("c_custkey")
    steps = [migration.Step(1, "to_mm", 5, "size", "size_mm", lambda x: x), migration.Step(2, "to_um", 5, "size_mm", "size_um", lambda x: x, version=2)]
    marks = F.when(k % 3 == 0, F.array(F.lit("to_mm@1"), F.lit("to_um@2"))).otherwise(F.array().cast("array<string>"))
    books = t(spark, d, "customer").select(k.alias("workbook_id"), pick(k, "old", "new", "old", "other").alias("schema_hash"), marks.alias("markers"), (k % 5).alias("revision"))
    states = migration.workbook_states(books, steps, "old", "new")
    found = books.limit(0).select(F.lit("Converted").alias("outcome"))
    after = migration.migrated_workbooks(books, states, found, steps, "new")
    return states.join(after, "workbook_id").select("workbook_id", "action", "code", "schema_hash", F.array_join("markers", ",").alias("markers"), "revision")


# --- lint across declarations: customers are types, orders are fields

TARGETS = """
WITH RECURSIVE ty AS (
  SELECT c_custkey AS type, c_custkey % 2 = 0 AS live, CASE c_custkey % 4 WHEN 0 THEN ['client', 'server'] WHEN 1 THEN ['client'] WHEN 2 THEN ['server'] ELSE CAST([] AS VARCHAR[]) END AS targets FROM customer),
f AS (
  SELECT o_custkey AS type, o_orderkey AS field_id, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey * 7 + o_orderkey) % 1500 + 1 END AS message, CASE WHEN o_orderkey % 3 = 1 THEN (o_custkey + o_orderkey) % 1500 + 1 END AS ref_table,
    CASE o_orderkey % 7 WHEN 0 THEN ['client'] WHEN 1 THEN ['server'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS own FROM orders),
s AS (
  SELECT type, targets FROM ty WHERE live
  UNION SELECT f.message, coalesce(f.own, s.targets) FROM s JOIN f USING (type) WHERE f.message IS NOT NULL)
"""


def nested_types(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    k, o, c = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    types = t(spark, d, "customer").select(k.alias("type"), (k % 2 == 0).alias("live"), F.when(k % 4 == 0, texts("client", "server")).when(k % 4 == 1, texts("client")).when(k % 4 == 2, texts("server")).otherwise(texts()).alias("targets"))
    own = F.when(o % 7 == 0, texts("client")).when(o % 7 == 1, texts("server")).when(o % 7 == 2, texts())
    fields = t(spark, d, "orders").select(c.alias("type"), o.alias("field_id"), F.when(o % 3 == 0, (c * 7 + o) % 1500 + 1).alias("message"), F.when(o % 3 == 1, (c + o) % 1500 + 1).alias("ref_table"), own.alias("targets"))
    return types, fields


@query(TARGETS + """
, e AS (SELECT s.type, field_id, s.targets AS parent, own, coalesce(own, s.targets) AS shown, message, ref_table FROM s JOIN f USING (type)),
m AS (
  SELECT type, field_id, 'target.outside' AS rule, unnest(list_filter(own, lambda x: NOT list_contains(parent, x))) AS x FROM e WHERE own IS NOT NULL
  UNION ALL SELECT e.type, field_id, 'struct.invisible', unnest(list_filter(shown, lambda x: NOT list_contains(ty.targets, x))) FROM e JOIN ty ON ty.type = message
  UNION ALL SELECT e.type, field_id, 'ref.invisible', unnest(list_filter(shown, lambda x: NOT list_contains(ty.targets, x))) FROM e JOIN ty ON ty.type = ref_table)
SELECT type, field_id, rule, string_agg(DISTINCT x, ',' ORDER BY x) AS missing FROM m GROUP BY 1, 2, 3""")
def lint_visibility(spark: SparkSession, d: str) -> DataFrame:
    return lint_graph.lint_visibility(*nested_types(spark, d))


@query(TARGETS + "SELECT type, array_to_string(targets, ',') AS targets FROM s")
def inherited_targets(spark: SparkSession, d: str) -> DataFrame:
    return lint_graph.inherited_targets(*nested_types(spark, d)).select("type", F.array_join("targets", ",").alias("targets"))


@query("""
WITH RECURSIVE f AS (
  SELECT o_custkey AS type, o_orderkey AS field_id, ['struct', 'list', 'structs', 'scalar', 'map', 'scalar', 'struct', 'scalar', 'scalar', 'scalar', 'scalar', 'scalar', 'scalar'][o_orderkey % 13 + 1] AS shape,
    CASE WHEN o_orderkey % 13 IN (0, 2, 4, 6) THEN o_custkey + (o_orderkey // 13) % 40 - 4 END AS message, o_orderkey % 5 = 0 AS expand FROM orders),
g AS (SELECT DISTINCT type, message FROM f WHERE message IS NOT NULL),
r(a, b) AS (SELECT type, message FROM g UNION SELECT r.a, g.message FROM r JOIN g ON r.b = g.type),
bumpy AS (SELECT type FROM f WHERE shape IN ('list', 'structs', 'map') OR (shape = 'struct' AND message IN (SELECT type FROM f))),
steep AS (SELECT type FROM f WHERE shape IN ('structs', 'map') OR (shape = 'struct' AND message IN (SELECT type FROM bumpy)))
SELECT type, field_id, 'struct.recursive' AS rule FROM f WHERE message = type OR EXISTS (SELECT 1 FROM r WHERE a = f.message AND b = f.type)
UNION ALL SELECT type, field_id, 'struct.layers' FROM f WHERE shape = 'struct' AND NOT expand AND message IN (SELECT type FROM steep)""")
def lint_structs(spark: SparkSession, d: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    shape = pick(o, "struct", "list", "structs", "scalar", "map", "scalar", "struct", *["scalar"] * 6)
    message = F.when((o % 13).isin(0, 2, 4, 6), c + F.floor(o / 13) % 40 - 4)
    return lint_graph.lint_structs(t(spark, d, "orders").select(c.alias("type"), o.alias("field_id"), shape.alias("shape"), message.alias("message"), (o % 5 == 0).alias("expand")))


FIELDS = """
WITH f AS (
  SELECT p_partkey // 8 AS type, p_partkey % 8 AS field_id, p_name AS name, ['string', 'int32', 'bool', 'double', 'string'][p_partkey % 5 + 1] AS kind, ['scalar', 'scalar', 'list', 'structs', 'scalar', 'scalar', 'structs'][p_partkey % 7 + 1] AS shape,
    CASE WHEN p_partkey % 7 IN (3, 6) THEN p_partkey % 229 END AS message, CASE WHEN p_partkey % 17 = 0 THEN 'o' END AS oneof, p_size AS n, p_partkey AS k FROM part),
x AS (
  SELECT *, CASE WHEN k % 4 = 0 THEN ['bool', 'int', 'float', 'date'][n % 4 + 1] END AS result, CASE WHEN k % 3 <> 0 THEN k % 300 END AS symbols_type, CASE WHEN k % 7 IN (0, 3, 6) THEN n % 9 END AS weight_field, CASE WHEN k % 2 = 0 THEN n % 5 END AS condition_field FROM f)
"""


def declared_fields(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    return t(spark, d, "part").select(
        F.floor(k / 8).alias("type"), (k % 8).alias("field_id"), F.col("p_name").alias("name"), pick(k, "string", "int32", "bool", "double", "string").alias("kind"), pick(k, "scalar", "scalar", "list", "structs", "scalar", "scalar", "structs").alias("shape"),
        F.when((k % 7).isin(3, 6), k % 229).alias("message"), F.when(k % 17 == 0, "o").alias("oneof"), F.when(k % 4 == 0, pick(n, "bool", "int", "float", "date")).alias("result"), F.when(k % 3 != 0, k % 300).alias("symbols_type"),
        F.when((k % 7).isin(0, 3, 6), (n % 9).cast("long")).alias("weight_field"), F.when(k % 2 == 0, (n % 5).cast("long")).alias("condition_field"),
    )


@query(FIELDS + """
, ty AS (SELECT DISTINCT type FROM f)
SELECT type, field_id, 'expression.shape' AS rule, NULL AS symbol FROM x WHERE result IS NOT NULL AND (shape <> 'scalar' OR kind <> 'string')
UNION ALL SELECT type, field_id, 'expression.symbols', NULL FROM x WHERE result IS NOT NULL AND coalesce(symbols_type NOT IN (SELECT type FROM ty), true)
UNION ALL SELECT type, field_id, 'expression.result', NULL FROM x WHERE result = 'date'
UNION ALL SELECT x.type, x.field_id, 'expression.composite', s.name FROM x JOIN f s ON s.type = x.symbols_type WHERE x.result IS NOT NULL AND (s.shape <> 'scalar' OR s.message IS NOT NULL OR s.oneof IS NOT NULL)""")
def lint_expressions(spark: SparkSession, d: str) -> DataFrame:
    fields = declared_fields(spark, d)
    return lint_graph.lint_expressions(fields, fields.select("type").distinct())


@query(FIELDS + """
, w AS (SELECT *, shape = 'structs' AND message IS NOT NULL AS lists FROM x WHERE weight_field IS NOT NULL)
SELECT type, field_id, 'weighted.shape' AS rule FROM w WHERE NOT lists
UNION ALL SELECT type, field_id, 'weighted.weight' FROM w WHERE lists AND NOT EXISTS (SELECT 1 FROM x e WHERE e.type = w.message AND e.field_id = w.weight_field AND e.field_id > 0 AND e.shape = 'scalar' AND e.kind IN ('int32', 'double'))
UNION ALL SELECT type, field_id, 'weighted.condition' FROM w WHERE lists AND condition_field <> 0
  AND NOT EXISTS (SELECT 1 FROM x e WHERE e.type = w.message AND e.field_id = w.condition_field AND (e.result = 'bool' OR (e.shape = 'scalar' AND e.kind = 'bool')))""")
def lint_weights(spark: SparkSession, d: str) -> DataFrame:
    return lint_graph.lint_weights(declared_fields(spark, d))


@query("""
WITH w AS (
  SELECT p_partkey AS type, CAST(NULL AS BIGINT) AS field_id, 'validator' AS kind, unnest([p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE 'r' || p_size END]) AS name FROM part
  UNION SELECT p_size, p_partkey, 'codec', p_type FROM part WHERE p_partkey % 3 = 0)
SELECT DISTINCT * FROM w WHERE trim(name) <> '' AND (kind, name) NOT IN (SELECT 'validator', 'r' || n_nationkey FROM nation) AND (kind, name) NOT IN (SELECT 'codec', min(p_type) FROM part)""")
def lint_registrations(spark: SparkSession, d: str) -> DataFrame:
    p, k = t(spark, d, "part"), F.col("p_partkey")
    types = p.select(k.alias("type"), F.array("p_brand", F.when(k % 2 == 0, " ").otherwise(F.concat(F.lit("r"), "p_size"))).alias("validators"))
    fields = p.select(F.col("p_size").cast("long").alias("type"), k.alias("field_id"), F.when(k % 3 == 0, F.col("p_type")).alias("codec"))
    known = t(spark, d, "nation").select(F.lit("validator").alias("kind"), F.concat(F.lit("r"), "n_nationkey").alias("name")).union(p.agg(F.lit("codec"), F.min("p_type")))
    return lint_graph.lint_registrations(types, fields, known)


# --- cells of composite fields, formats both ways, and rows that repeat


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Missing' WHEN o_orderkey % 11 = 0 THEN 'Null' WHEN o_orderkey % 5 = 0 THEN 'Invalid' ELSE 'Value' END AS state,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN '[' || o_custkey || ',"' || o_orderstatus || '",null]' ELSE '{"a":{"x":' || o_orderkey || ',"y":[]},"b":"' || o_orderstatus || '"}' END AS text,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'cell.unparseable' END AS error FROM orders""")
def json_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lists and structs without a format, their members in any order and with white space."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    listed = F.concat(F.lit(" [ "), F.col("o_custkey").cast("string"), F.lit(' , "'), s, F.lit('" , null ]'))
    made = F.concat(F.lit('{ "b" : "'), s, F.lit('", "a": {"y": [ ], "x": '), k.cast("string"), F.lit("} }"))
    x = F.when(k % 7 == 0, "").when(k % 11 == 0, "~").when(k % 5 == 0, F.concat(F.lit("{"), s)).when(k % 2 == 0, listed).otherwise(made)
    rows = t(spark, d, "orders").select("o_orderkey", x.alias("x"))
    parsed = cells.parse_columns(rows, {"c": (F.col("x"), None, Field(1, "c", shape="structs"))})
    return parsed.select("o_orderkey", "c.state", "c.text", "c.error")


@query("""
WITH c AS (
  SELECT c_custkey, c_custkey % 7 = 0 AS none, CASE WHEN c_custkey % 3 = 0 THEN 'seg' || c_nationkey ELSE c_mktsegment END AS s, ['red', 'blue', '3', 'pink'][c_custkey % 4 + 1] AS e FROM customer)
SELECT c_custkey, CASE WHEN none THEN 'Missing' WHEN NOT regexp_matches(s, '^[A-Z]+$') THEN 'Invalid' ELSE 'Value' END AS segment, CASE WHEN NOT none AND NOT regexp_matches(s, '^[A-Z]+$') THEN 'cell.regex' END AS segment_error,
  CASE WHEN none THEN 'Missing' WHEN e = 'pink' THEN 'Invalid' ELSE 'Value' END AS colour, CASE WHEN NOT none AND e = 'pink' THEN 'cell.enum' END AS colour_error FROM c""")
def declared_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a field with a pattern, and of an enum by names and numbers."""
    k = F.col("c_custkey")
    segment = F.when(k % 7 == 0, "").when(k % 3 == 0, F.concat(F.lit("seg"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_mktsegment"))
    rows = t(spark, d, "customer").select(k, segment.alias("s"), F.when(k % 7 == 0, "").otherwise(pick(k, "red", "blue", "3", "pink")).alias("e"))
    parsed = cells.parse_columns(rows, {"a": (F.col("s"), None, Field(1, "s", regex="^[A-Z]+$")), "b": (F.col("e"), None, Field(2, "e", enum=(("red", 1), ("blue", 2), ("green", 3))))})
    return parsed.select("c_custkey", F.col("a.state").alias("segment"), F.col("a.error").alias("segment_error"), F.col("b.state").alias("colour"), F.col("b.error").alias("colour_error"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '~' WHEN 2 THEN NULL ELSE '#' || c_name END AS hashed, CASE c_custkey % 5 WHEN 2 THEN 'cell.unwritable' END AS hashed_error,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey || ';' || c_custkey END AS listed, CASE WHEN c_custkey % 4 = 0 THEN 'cell.unwritable' END AS listed_error FROM customer""")
def written_cells(spark: SparkSession, d: str) -> DataFrame:
    """Values written through the format that their field declares; what a format cannot write is an error."""
    k = F.col("c_custkey")
    json = F.when(k % 4 == 0, F.lit("no list")).otherwise(F.concat(F.lit('["'), F.col("c_nationkey").cast("string"), F.lit('","'), k.cast("string"), F.lit('"]')))
    rows = t(spark, d, "customer").select(k, pick(k, "Missing", "Null", "Invalid", "Value", "Defaulted").alias("state"), F.col("c_name").alias("name"), json.alias("json"))
    listed = Format(lambda x: F.to_json(cells.parse_join_list(x, ";", "string")), lambda x: cells.write_join_list(F.from_json(F.when(x.startswith("["), x), "array<string>"), ";"))
    out = cells.write_columns(rows, {"a": (F.col("state"), F.col("name"), Field(1, "a", format="hash")), "b": (F.lit("Value"), F.col("json"), Field(2, "b", format="list"))}, FORMATS | {"list": listed})
    return out.select("c_custkey", F.col("a.text").alias("hashed"), F.col("a.error").alias("hashed_error"), F.col("b.text").alias("listed"), F.col("b.error").alias("listed_error"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderkey % 9 AS m FROM orders)
SELECT k, CASE WHEN m NOT IN (1, 2) THEN 'b=' || c || ';k' || k || '=1' END AS plain, CASE WHEN m NOT IN (3, 4, 5) THEN CASE WHEN m = 6 THEN 'x=7' WHEN m = 7 THEN 'x=7,' || s ELSE 'x=' || c || ',' || s || ';y=1' END END AS structs,
  CASE WHEN m NOT IN (3, 5, 8) THEN CASE WHEN m = 7 THEN 'x=s:' || s ELSE 'x=n:' || c || ',s:' || s END END AS named FROM o""")
def named_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps of numbers, of structs by position, and of structs by name, read and written again; refused where they break a rule."""
    k, c, s = (F.col(x) for x in ("k", "c", "s"))
    m = k % 9
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderstatus").alias("s"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    plain = F.when(m == 1, text("k=1;k=", c)).when(m == 2, text("k=1;b")).otherwise(text("k", k, "=1; ;b=", c))
    structs = F.when(m == 3, text("x=a,", s)).when(m == 4, text("x=1,", s, ",3")).when(m == 5, text("x=1;x=2")).when(m == 6, text("x=7,")).when(m == 7, text("x= 7 ,", s)).otherwise(text("y=1;x=", c, ",", s))
    named = F.when(m == 3, text('x="n:a,s:', s, '"')).when(m == 5, text("x=q:1")).when(m == 7, text("x=s:", s)).when(m == 8, text("x=n:1,n:2")).otherwise(text('x="s:', s, ",n:", c, '"'))
    fields = {"n": "int64", "s": "string"}
    a = cells.parse_named_map(plain, ";", "=", "string", "int64")
    b = cells.parse_named_map(structs, ";", "=", value_kind=fields, field=",")
    e = cells.parse_named_map(named, ";", "=", value_kind=fields, field=",", name=":")
    rows = rows.select("k", a.alias("a"), b.alias("b"), e.alias("e"))
    return rows.select("k", cells.write_named_map(F.col("a"), ";", "=").alias("plain"), cells.write_named_map(F.col("b"), ";", "=", list(fields), ",").alias("structs"), cells.write_named_map(F.col("e"), ";", "=", list(fields), ",", ":").alias("named"))


@query("""
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS place FROM lineitem)
SELECT count(*) AS n, CAST(count_if(keys > 1) AS BIGINT) AS keys, CAST(count_if(codes > 1) AS BIGINT) AS codes, CAST(count_if(s % 5 = 0 AND n = 3) AS BIGINT) AS oneofs, CAST(count_if(n > 6) AS BIGINT) AS validators,
  CAST(count_if(keys = 1 AND codes = 1 AND NOT (s % 5 = 0 AND n = 3) AND n <= 6) AS BIGINT) AS indexable
FROM (SELECT *, count(*) OVER (PARTITION BY k, n) AS keys, count(*) OVER (PARTITION BY p, s) AS codes FROM r)""")
def indexable_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines by what makes them unfit: a key or a unique code that repeats, two variants of a group, a rule of their table."""
    cell = lambda text: F.struct(text.cast("string").alias("text"), F.lit(None).cast("string").alias("formula"))
    pair = lambda name, text: F.struct(F.lit(name).alias("key"), cell(text).alias("value"))
    left = F.when((F.col("l_suppkey") % 5 == 0) | (F.col("l_linenumber") != 3), "1")
    entries = F.array(pair("order", F.col("l_orderkey")), pair("line", F.col("l_linenumber")), pair("code", F.concat_ws("-", "l_partkey", "l_suppkey")), pair("left", left), pair("right", F.when(F.col("l_linenumber") == 3, "2")))
    rows = t(spark, d, "lineitem").select(F.lit("w").alias("path"), F.lit("lines").alias("sheet"), F.monotonically_increasing_id().alias("row_number"), F.lit(None).cast("string").alias("raw_guid"), F.lit(None).cast("string").alias("raw_revision"), F.map_from_entries(entries).alias("cells"))
    fields = (Field(1, "order", "int64", key_order=1), Field(2, "line", "int32", key_order=2), Field(3, "code", unique=True), Field(4, "left", oneof="side"), Field(5, "right", oneof="side"))
    rules = Registry()
    rules.add("short", lambda: F.try_element_at("cells", F.lit("line")).cast("int") <= 6)
    catalog = Catalog((Table(7, "lines", fields, validators=("short",)),))
    parsed = intake.with_indexable(intake.parse_tables(rows, catalog).checkpoint(), catalog, rules)
    has = lambda code: F.exists("findings", lambda f: f["code"] == code)
    return parsed.agg(F.count("*").alias("n"), *[F.count_if(has(c)).alias(name) for name, c in (("keys", "key.duplicate"), ("codes", "field.duplicate"), ("oneofs", "oneof.side"), ("validators", "validator.short"))], F.count_if("indexable").alias("indexable"))


@query("""
WITH k AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 37 = 0 THEN 2 WHEN c_custkey % 29 = 0 THEN 0 ELSE 1 END AS n FROM customer)
SELECT 3 AS table_id, md5('3:' || c) AS row_guid, CAST(c AS VARCHAR) AS key, 'Removed' AS status FROM k WHERE n <> 1""")
def removed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Known customers of which a scan sees none (every 29th) or two under one identity (every 37th)."""
    k = F.col("c_custkey")
    known = t(spark, d, "customer").select(F.lit(3).alias("table_id"), guid(3, k).alias("row_guid"), k.cast("string").alias("key"), k)
    seen = known.where("c_custkey % 29 <> 0 or c_custkey % 37 = 0").union(known.where("c_custkey % 37 = 0"))
    rows = seen.select(F.monotonically_increasing_id().alias("row_no"), "table_id", F.col("row_guid").alias("raw_guid"), "key")
    return identity.removed(identity.scan(rows, known), known)


@query("""
SELECT 'w' || (o_orderkey % 5) AS workbook_id, 6 AS table_id, CAST(o_orderkey AS VARCHAR) AS row_guid, CASE WHEN o_orderstatus = 'F' THEN 'Skipped' ELSE 'Converted' END AS outcome, o_orderstatus || '!' AS value, CAST(0 AS BIGINT) AS undetermined FROM orders""")
def checked_migration(spark: SparkSession, d: str) -> DataFrame:
    """A step that has nothing to do where a status is final, evaluated twice."""
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").select(F.concat(F.lit("w"), (k % 5).cast("string")).alias("workbook_id"), F.lit(6).alias("table_id"), k.cast("string").alias("row_guid"), F.lit("status").alias("field_path"), F.lit("Value").alias("state"), F.col("o_orderstatus").alias("text"))
    steps = [migration.Step(1, "mark", 6, "status", "marked", lambda x: F.concat(x, F.lit("!")), skips=lambda x: x == "F")]
    found = migration.outcomes(rows, steps).checkpoint()
    n = migration.undetermined(rows, found, steps).count()
    return found.select("workbook_id", "table_id", "row_guid", "outcome", "value", F.lit(n).cast("long").alias("undetermined"))


@query("""
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_custkey % 20 = 19 THEN 'b3' ELSE 'b' || (o_custkey % 20) END AS book, CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS id FROM orders WHERE o_custkey % 20 <> 3),
f AS (
  SELECT 'sources' AS step, 'b3' AS workbook_id, 'workbook.duplicate' AS code, 3 AS severity
  UNION ALL SELECT 'identities', book, 'identity.invalid', 3 FROM o WHERE k % 31 = 0
  UNION ALL SELECT 'cells', 'b' || (c_custkey % 20), 'key.missing', 2 FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT 'keys', book, 'key.duplicate', 2 FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM o) WHERE n > 1
  UNION ALL SELECT 'references', book, CASE WHEN k % 17 = 0 THEN 'ref.malformed' ELSE 'ref.unresolved' END, 3 FROM o WHERE k % 17 = 0 OR c % 10 = 0)
SELECT step, workbook_id, code, severity, count(*) AS n FROM f GROUP BY 1, 2, 3, 4""")
def project_checks(spark: SparkSession, d: str) -> DataFrame:
    """Customers and orders as the sheets of twenty workbooks, two of which have one identity."""
    c, o, k = F.col("c_custkey"), F.col("o_custkey"), F.col("o_orderkey")
    text = lambda x: x.cast("string")
    cell = lambda name, x: F.struct(F.lit(name).alias("key"), F.struct(x.alias("text"), F.lit(None).cast("string").alias("formula")).alias("value"))
    none = F.lit(None).cast("string").alias("raw_revision")
    at = lambda x: F.concat(F.lit("w"), text(x % 20)).alias("path")
    customers = t(spark, d, "customer").select(at(c), F.lit("customers").alias("sheet"), c.alias("row_number"), guid(3, c).alias("raw_guid"), none, F.map_from_entries(F.array(cell("id", F.when(c % 10 == 0, "").otherwise(text(c))))).alias("cells"))
    own = F.when(k % 31 == 0, "bad").when(k % 29 == 0, "").otherwise(guid(6, k))
    tokens = F.when(k % 17 == 0, "x").otherwise(F.concat(F.lit("3:"), text(o)))
    orders = t(spark, d, "orders").select(at(o), F.lit("orders"), k, own, none, F.map_from_entries(F.array(cell("id", text(F.when(k % 50 == 1, k - 1).otherwise(k))), cell("customer", tokens))))
    rows = customers.union(orders)
    catalog = Catalog((Table(3, "customers", (Field(1, "id", "int64", key_order=1),)), Table(6, "orders", (Field(1, "id", "int64", key_order=1), Field(2, "customer", ref_table=3)))))
    books = t(spark, d, "customer").select(at(c), F.concat(F.lit("b"), text(F.when(c % 20 == 19, 3).otherwise(c % 20))).alias("workbook_id")).distinct()
    known = t(spark, d, "customer").select(F.lit(3).alias("table_id"), guid(3, c).alias("row_guid"), cells.encode_key(text(c)).alias("key"))
    return intake.run_checks(books, rows, intake.parse_tables(rows, catalog).checkpoint(), known, catalog)
