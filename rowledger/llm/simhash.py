"""SimHash near-duplicates, candidates pruned by pigeonring chains.

Contract: one row per input row with doc_id, fingerprint and component_id, the smallest doc_id reachable over links of
at most `max_bits` differing bits. Null and empty texts have fingerprint zero and are linked like any other; a text of
fewer words than a shingle is hashed whole; repeated words and rows count; extra columns are ignored; an empty table
gives an empty result. Rows with a null doc_id are kept and take the smallest id of their component.

Method. Equal fingerprints collapse first. The 64 bits are cut into m ring segments and, as at most `max_bits` of them
can differ, m - max_bits segments are equal; each choice of so many segments is a join key, and m grows with the number
of fingerprints, so that a key stays selective. A pair that meets under a key must pass the pigeonring condition (from some segment on,
every chain of l segments differs in at most floor(l * max_bits / m) bits) before the full Hamming check. Keys that more
than `bucket_limit` fingerprints share are not paired: their fingerprints are linked exactly through all points within
half the distance, since two points lie within 2r of each other only if balls of radius r around them meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import connected_components, join_spread, materialize, plus, shielded

ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the XXH64 (seed 42) of all word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    lo, hi = starts[:n].tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(lo[i : i + (1 << 15)], hi[i : i + (1 << 15)], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([signed(fingerprint(t.as_py(), shingle)) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp long")


def scheme(n: int, max_bits: int, load: int = 8) -> tuple[int, int]:
    """(m, r): m segments of which r equal ones form a key, so that about `load` of n fingerprints share a key by chance."""
    for r in range(2, 64 - max_bits):
        m = max_bits + r
        if n <= load * 2 ** (64 * r // m) or comb(m, r) > 1000:
            return m, r
    return 64, 64 - max_bits


def segments(m: int) -> list[int]:
    """Masks of m ring segments of nearly equal length."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_passes(diff: Column, masks: list[int], max_bits: int, length: int) -> Column:
    """Pigeonring: some start from which each chain of l <= length segments stays within floor(l * max_bits / m)."""
    m = len(masks)
    d = [F.bit_count(diff.bitwiseAND(F.lit(signed(x)))) for x in masks]
    starts = []
    for i in range(m):
        total, fits = d[i], d[i] <= max_bits // m
        for k in range(1, length):
            total = total + d[(i + k) % m]
            fits = fits & (total <= (k + 1) * max_bits // m)
        starts.append(fits)
    out = starts[0]
    for s in starts[1:]:
        out = out | s
    return out


def near_links(fps: DataFrame, max_bits: int = 4, bucket_limit: int = 96, chain: int = 3) -> DataFrame:
    """Links (a, b), a < b, that connect exactly the pairs of distinct fingerprints (column fp) within max_bits."""
    fps = fps.select("fp")
    m, r = scheme(fps.count(), max_bits)
    masks = segments(m)
    keys = [sum(masks[i] for i in c) for c in combinations(range(m), r)]
    at = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("v")) for k, x in enumerate(keys)])
    keyed = fps.select("fp", F.inline(at))
    loads = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(loads, ["k", "v"]), "simhash-keys")
    few = shared.where(F.col("n") <= bucket_limit)
    pairs = few.select("k", "v", F.col("fp").alias("a")).join(few.select("k", "v", F.col("fp").alias("b")), ["k", "v"]).where("a < b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = pairs.where(chain_passes(diff, masks, max_bits, min(chain, m))).where(F.bit_count(diff) <= max_bits).select("a", "b")
    # Crowded keys: balls of radius max_bits / 2 meet. For an odd distance one ball is larger by one. Merge joins: Spark's
    # estimate leaves out that a fingerprint becomes thousands of points, and would send those through the driver.
    crowd = shared.where(F.col("n") > bucket_limit).select("fp").distinct()
    points = ball_points(crowd, max_bits // 2).withColumnRenamed("fp", "a")
    if max_bits % 2 == 0:
        least = points.groupBy("point").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        met = points.hint("merge").join(least, "point")
    else:
        wide = ball_points(crowd, max_bits // 2 + 1)
        met = wide.withColumnRenamed("fp", "b").hint("merge").join(points, "point")
    met = met.where("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).select("a", "b")
    return pairs.union(met).distinct()


def ball_points(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, point) for every 64-bit point within `radius` bits of fp."""
    out = fps.select("fp", F.col("fp").alias("point"))
    bits = F.array(*[F.lit(signed(1 << i)) for i in range(64)])
    last = fps.select("fp", F.col("fp").alias("point"), F.lit(64).alias("top"))
    for _ in range(radius):
        last = last.select("fp", "point", F.posexplode(F.slice(bits, F.lit(1), F.col("top"))).alias("top", "bit"))
        last = last.select("fp", F.col("point").bitwiseXOR(F.col("bit")).alias("point"), "top")
        out = out.union(last.select("fp", "point"))
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, bucket_limit: int = 96) -> DataFrame:
    prints = materialize(with_fingerprint(docs, shingle), "simhash-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = connected_components(near_links(classes, max_bits, bucket_limit), "simhash-links")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "simhash-named")
    rows, prints_in_all = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = materialize(join_spread(rooted, named, "root", "m", rows).select("fp", "n", "component_id"), "simhash-components")
    return join_spread(prints, classes, "fp", "n", prints_in_all).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def least_rows(tagged: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """Of the rows of each root the one with the least doc_id, and of several the first by text. tagged: columns and
    _set; roots: (node, root) of the sets that have another root than themselves."""
    classes = tagged.groupBy("_set").agg(F.min("doc_id").alias("_least"))
    classes = materialize(classes.join(roots, classes["_set"] == roots["node"], "left").select("_set", "_least", F.coalesce("root", "_set").alias("_root")), "near-classes")
    # The least id is part of the join's key, so that a root of many sets is spread over tasks.
    best = classes.groupBy(F.col("_root").alias("_of")).agg(F.min("_least").alias("_best"))
    first = classes.join(best, (F.col("_root") == F.col("_of")) & F.col("_least").eqNullSafe(F.col("_best"))).select(F.col("_set").alias("_s"), "_best", "_root")
    first = materialize(first, "near-first")
    kept = tagged.select("_set", *columns).join(first, (F.col("_set") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_best")))
    repeated = kept.groupBy("_root").count().where("count > 1").select("_root")
    once = kept.join(repeated, "_root", "left_anti").select(columns)
    order = ["text", *[c for c in columns if c not in ("text", "doc_id")]]
    one = kept.join(repeated, "_root", "left_semi").groupBy("_root").agg(F.min(F.struct("doc_id", *order)).alias("_r"))
    return once.union(one.select("_r.*").select(columns))


def with_print(docs: DataFrame, shingle: int) -> DataFrame:
    """docs with _set, the fingerprint as a signed long, all other columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([signed(fingerprint(t.as_py(), shingle)) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fps], names=[*b.schema.names, "_set"])

    return docs.mapInArrow(run, plus(docs.schema, _set="bigint"))


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, bucket_limit: int = 96) -> DataFrame:
    """One row of each group of near-duplicates: of the rows with its smallest doc_id, the first by text."""
    inner = shielded(docs, "doc_id", "text")
    tagged = materialize(with_print(inner, shingle), "simhash-docs")
    classes = materialize(tagged.select(F.col("_set").alias("fp")).distinct(), "simhash-classes")
    return least_rows(tagged, connected_components(near_links(classes, max_bits, bucket_limit), "simhash-links"), inner.columns).toDF(*docs.columns)
