"""Exact top-k search by distributed histogram selection.

Contract: for each query its k highest scores with query_id, rank, vec_id and score; fewer if there are fewer rows; ties go
to the smaller vec_id. A component x counts as floor(256 x), the score is the integer inner product. Vectors that are
null or empty, or hold a null or non-finite component, take no part; a shorter vector counts as padded with zeros. Rows
are told apart by vec_id: rows that share the query's id are not its candidates, other repeated rows count each.
Null ids take no part. Extra columns are ignored; an empty table gives an empty result.

Method. Queries go in blocks of bounded size, each sent to all tasks, and all rows are scored against a block by one
matrix product a batch. A level of selection counts scores in `bins` intervals, each task telling only the highest
ones that already hold what a query needs; the sums tell the interval of the k-th score, which the next level divides, until
an interval is one integer. A last scan keeps what is above that score, and of the rows on it each task's smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.llm.common import materialize

BLOCK, BINS, ROWS = 2_048, 1_024, 1_024


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """Integer components of a list column, as doubles, padded to dims."""
    offsets = column.offsets.to_numpy()
    values = np.floor(256.0 * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores (query, row), own: the pairs of a query and itself) in blocks of at most ROWS rows."""
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            part = b.slice(a, ROWS)
            rows, x = part.column(0).to_numpy(), whole(pa.concat_arrays([part.column(1)]), q.shape[1])
            s = (q @ x.T).astype(np.int64) if exact else q.astype(np.int64) @ x.T.astype(np.int64)
            yield rows, s, ids[:, None] == rows[None, :]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors and queries: vec_id, embedding. Each query row is ranked by itself, so a repeated one gives its k rows again."""
    rows, asked = valid(vectors), valid(queries)
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: F.pow(F.floor(F.lit(256.0) * x.cast("double")).cast("double"), 2.0)), F.lit(0.0), lambda a, x: a + x))
    most, dims = rows.agg(F.max(norm), F.max(F.size("embedding"))).first()
    n, most_asked, dims_asked = asked.agg(F.count("*"), F.max(norm), F.max(F.size("embedding"))).first()
    schema = "query_id long, vec_id long, score long"
    if not n or most is None:
        return vectors.sparkSession.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dims, reach = max(dims, dims_asked), int(most * most_asked) + 2
    exact = reach < 1 << 52
    levels = 1
    while BINS**levels < 2 * reach + 1:
        levels += 1
    blocks = -(-n // BLOCK)
    out = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()  # about BLOCK rows
        ids = mine.column(0).to_numpy()
        q = whole(mine.column(1).combine_chunks(), dims) if len(ids) else np.zeros((0, dims))
        low, need = np.full(len(ids), -reach, np.int64), np.full(len(ids), k, np.int64)
        few = np.zeros(len(ids), bool)
        for level in range(levels - 1, -1, -1):
            counts = rows.mapInArrow(histograms(ids, q, exact, low, need, BINS**level), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
            needs = F.array(*[F.lit(int(x)) for x in sorted(set(need.tolist()))])
            found = counts.withColumn("above", above).withColumn("before", F.col("above") - F.col("n"))
            found = found.where(F.col("before") < F.array_max(needs)).collect()  # the first few intervals of each query
            seen = np.zeros(len(ids), bool)
            for r in sorted(found, key=lambda r: (r["q"], -r["bin"])):
                if not seen[r["q"]] and r["above"] >= need[r["q"]]:
                    seen[r["q"]] = True
                    need[r["q"]] -= r["before"]
                    low[r["q"]] += r["bin"] * BINS**level
            few |= ~seen
            low[few], need[few] = -reach, k  # fewer rows than k: all of them are taken
        out.append(rows.mapInArrow(chosen(ids, q, exact, low, need, few), schema + ", q int").withColumn("block", F.lit(block)))
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    found = materialize(found, "topk-found") if blocks > 1 else found
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def histograms(ids: np.ndarray, q: np.ndarray, exact: bool, low: np.ndarray, need: np.ndarray, width: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(ids) * BINS, np.int64)
        base = np.arange(len(ids))[:, None] * BINS
        for _, s, own in scored(batches, ids, q, exact):
            at = (s - low[:, None]) // width
            inside = (at >= 0) & (at < BINS) & ~own
            counts += np.bincount((base + at)[inside], minlength=len(counts))
        counts = counts.reshape(len(ids), BINS)[:, ::-1]
        before = np.cumsum(counts, 1) - counts
        i, b = np.nonzero((counts > 0) & (before < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(BINS - 1 - b, pa.int32()), pa.array(counts[i, b], pa.int64())], names=["q", "bin", "n"])

    return run


def chosen(ids: np.ndarray, q: np.ndarray, exact: bool, low: np.ndarray, need: np.ndarray, few: np.ndarray):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s, own in scored(batches, ids, q, exact):
            take = (s > low[:, None]) & ~own
            take[few] = ~own[few]
            ties = (s == low[:, None]) & ~own & ~few[:, None]
            order = np.argsort(rows, kind="stable")
            ranked = ties[:, order]
            take[:, order] |= ranked & (np.cumsum(ranked, 1) <= need[:, None])
            i, j = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(rows[j], pa.int64()), pa.array(s[i, j], pa.int64()), pa.array(i, pa.int32())], names=["query_id", "vec_id", "score", "q"])

    return run
