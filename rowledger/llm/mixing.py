"""Mixing sources to target weights by weighted fair queueing.

Contract: one row per input row with doc_id, source, size (words), source_size, target (of its source), taken (words the
mix takes of the row, repeats counted). Sources in code point order, null last, weigh 1, 2, 3, repeating; targets stop
at `repeats` times the source's size and what is over goes to the others by weight. Null and empty texts have size 0 and
take 0. Rows with equal doc_id count each. Extra columns are ignored; an empty table gives an empty result.

Method. Every document is cut into packets of at most `packet` words, as a queue cuts long messages. Within its source
the documents stand in the order of a hash of doc_id, and a packet's virtual finish time is the source's words up to
its end, earlier passes included, divided by the source's target. All packets are range-sorted by that time and
truncated where the budget, the sum of all sizes, is used up; the packet there is cut. So each source comes within one
packet of its target. Running sums go by hash buckets within a source and by ranges over the whole, never by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.llm.common import bucket_count, materialize, order_hash, running_start, shielded

WORD = r"[^\x20\x09-\x0D]+"
#: Packets in one range of the global order, on average, as long as that makes at most RANGES ranges (the driver gets a
#: number of each). Past that a range grows: Spark sorts it with spill and the running sum streams over it.
RANGE_ROWS, RANGES = 20_000, 20_000


def source_targets(sizes: DataFrame, repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, rank, weight, source_size, target) for each source of sizes (source, size). One row per source.

    With level = budget less the capped sources' caps, over the other weights, a source is capped if its cap by weight
    is at most the level; sources in the order of that ratio make the capped ones a prefix.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1))
    by = by.withColumn("cap", F.lit(repeats) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    by = by.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # The level falls along the prefixes that leave it uncapped, so the first of them has the highest; ties in the ratio do not matter.
    by = by.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return by.select("source", "rank", "weight", "source_size", target.alias("target"))


def mix(docs: DataFrame, repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), packet: int = 64) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select("doc_id", "source", words.alias("size"), order_hash(F.col("doc_id")).alias("h")), "mix-sizes")
    targets = source_targets(sizes, repeats, weights)
    known = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows, budget = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    known = materialize(running_start(known, "rank", ["h", "doc_id", "size"], "size", "start", bucket_count(rows)), "mix-order")
    # Packets (rank, start: the document, p: position over all passes, n: words, v: virtual finish time).
    passes = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass")
    runs = known.where("size > 0").select("rank", "start", "size", "source_size", "target", passes).where(F.col("pass") * F.col("source_size") + F.col("start") < F.col("target"))
    cuts = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))).alias("k"))
    packets = cuts.select("rank", "start", (F.col("pass") * F.col("source_size") + F.col("start") + F.col("k")).alias("p"), F.least(F.lit(packet), F.col("size") - F.col("k")).alias("n"), "target").where("p < target")
    packets = packets.select("rank", "start", "p", "n", ((F.col("p") + F.col("n")) / F.col("target")).alias("v"))
    ranges = max(8, min(RANGES, budget // (packet * RANGE_ROWS)))
    placed = materialize(packets.repartitionByRange(ranges, "v", "rank", "p").withColumn("range", F.spark_partition_id()), "mix-packets")
    # The range in which the budget ends: one number for each range comes to the driver.
    used, last = 0, -1
    for r in placed.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():
        last = r["range"]
        if used + r["n"] >= budget:
            break
        used += r["n"]
    run = F.sum("n").over(Window.partitionBy("range").orderBy("v", "rank", "p").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where(F.col("range") == last).withColumn("e", F.lit(used) + run).where(F.col("e") - F.col("n") < budget)
    edge = edge.select("rank", "start", (F.col("n") - F.greatest(F.lit(0), F.col("e") - budget)).alias("n"))
    taken = placed.where(F.col("range") < last).select("rank", "start", "n").union(edge).groupBy("rank", "start").agg(F.sum("n").alias("taken"))
    some, none = known.where("size > 0"), known.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    some = some.join(taken, ["rank", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return some.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken", "start")


def resample(docs: DataFrame, repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), packet: int = 64) -> DataFrame:
    """docs with every row as often as the mix takes it, a part of a row rounded to the nearest whole one.

    Rows without a word, whose texts are null, empty or white space, have nothing to take and go. Rows that share
    doc_id, source and size (null equal to null) are taken equally often. Columns of any name are kept.
    """
    taken = mix(docs, repeats, weights, packet).where("size > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("t"), F.count("*").alias("rows"))
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.round(F.col("t") / (F.col("rows") * F.col("size"))).cast("int").alias("_n")).where("_n > 0")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    inner = shielded(docs, "doc_id", "source", "text")
    rows = inner.withColumn("_w", words).join(taken, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_w") == F.col("_z")))
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(inner.columns).toDF(*docs.columns)


#: The result over documents as DuckDB computes it; the same order of words, so the same takes.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk
  FROM sizes GROUP BY source),
weighed AS (SELECT *, (rk % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
chosen AS (SELECT max(level) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, rk, source_size, least(cap::DOUBLE, coalesce(c.level * weight, cap::DOUBLE)) AS target
  FROM levels CROSS JOIN chosen c),
placed AS (
  SELECT s.*, t.rk, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY rk ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
packets AS (
  SELECT rk, start, pass * source_size + start + k AS p, least(64, size - k) AS n, target
  FROM placed, generate_series(0, 2) a(pass), generate_series(0, size - 1, 64) b(k)
  WHERE size > 0),
summed AS (
  SELECT rk, start, n, sum(n) OVER (ORDER BY (p + n) / target, rk, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM packets WHERE p < target),
taken AS (
  SELECT rk, start, sum(n - greatest(0, e - b.budget))::BIGINT AS taken
  FROM summed, (SELECT sum(size) AS budget FROM sizes) b WHERE e - n < b.budget GROUP BY rk, start)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, CASE WHEN p.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.rk = t.rk AND p.start = t.start AND p.size > 0
"""
