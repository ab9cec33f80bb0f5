"""Small helpers that the operators share: tables, scratch space and distributed running sums."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one bucket of a running sum holds on average.
BUCKET_ROWS = 8_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of this machine only where the session names none and
    runs on it alone."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back, which cuts the lineage and survives lost executors."""
    return materialized(df, tag)[0]


def materialized(df: DataFrame, tag: str, keep: bool = False) -> tuple[DataFrame, str]:
    """As materialize, and the folder; `keep` leaves it when a scratch_scope around it ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more, in whatever store they lie."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Folders that are written inside go when the block ends: what is to stay has to be written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        discard(spark, *_SCOPES.pop())


def absent(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores behind it as make it no column, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by division by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def crc_mod4(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def order_hash(*cols: Column) -> Column:
    """A deterministic shuffle order that DuckDB can compute as well."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))


def bucket_count(rows: int, rows_per_bucket: int = BUCKET_ROWS) -> int:
    return max(1, min(1 << 26, -(-rows // rows_per_bucket)))


def running_start(df: DataFrame, group: str, order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Add the exclusive running sum of `value` within each group, in the order of (bucket of order[0], *order).

    order[0] is a hexadecimal hash, so its first digits deal every group, a hot one too, evenly over `buckets`
    buckets; bucket totals give the offsets, and only a bucket's rows are sorted in one task. `group` must not be null.
    """
    b, o, t = absent([*df.columns, out], "_b", "_o", "_t")
    df = df.withColumn(b, (F.conv(F.substring(order[0], 1, 12), 16, 10).cast("long") * F.lit(buckets) / F.lit(float(1 << 48))).cast("int"))
    totals = df.groupBy(group, b).agg(F.sum(value).alias(t))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, b, F.coalesce(F.sum(t).over(before), F.lit(0).cast("long")).alias(o))
    within = Window.partitionBy(group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, [group, b]).withColumn(out, (F.col(o) + F.coalesce(F.sum(value).over(within), F.lit(0).cast("long"))).cast("long")).drop(o, b)


#: A key with more than one row in so many is joined apart; there are fewer such keys than that.
HOT_SHARE = 1_000


def join_spread(rows: DataFrame, by: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """rows (read twice) with the columns of by, one row a key, left out where by has none; `count` is how many rows a key
    has, of `total` in all. Keys with more than total / HOT_SHARE rows, so fewer than HOT_SHARE keys, are sent to the
    rows; the others meet them by a shuffle, so no task gets the rows of a hot key."""
    most, key = total // HOT_SHARE, [key] if isinstance(key, str) else key
    hot, rest = by.where(F.col(count) > most).drop(count), by.where(F.col(count) <= most).drop(count)
    with_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key)
    return with_hot.unionByName(others)


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node that is reachable.

    Alternates large-star and small-star steps until the edges are stars, each node with one edge to a root that has none.
    Each round is written to the scratch folder, so that neither lineage nor any list of neighbours grows in memory, and
    the round before goes. The joins are plain ones between shuffled sides, whose skewed partitions Spark splits at run
    time, so a hub with very many edges is joined by several tasks.
    """
    spark = edges.sparkSession
    edges, path = materialized(edges.select("a", "b").where("a <> b").distinct(), tag)
    open_nodes = 1
    while open_nodes:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before = path
        edges, path = materialized(small, tag)
        discard(spark, before)
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        open_nodes = ends.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).limit(1).count()
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def shielded(df: DataFrame, *kept: str) -> DataFrame:
    """df with all columns but `kept` under names that begin with no underscore, so that helper columns never clash; the
    order of columns stays, and toDF gives the old names back."""
    return df.toDF(*[c if c in kept else f"c{i}" for i, c in enumerate(df.columns)])


def plus(schema: T.StructType, **columns: str) -> T.StructType:
    """schema with more columns (name=type in DDL), itself unchanged."""
    return T.StructType([*schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in columns.items())])
