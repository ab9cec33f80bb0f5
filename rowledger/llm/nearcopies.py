"""Near copies by the similarity of word shingles: banded minimum hashes propose pairs, exact set comparison decides.

Contract: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are near copies, and so
are chains of them; of each such group one row stays: of the rows with its smallest doc_id (null only if all are null)
the first by text. Words are as in `simhash`; a text of fewer words than a shingle is one shingle; null and empty texts
have the empty set and are copies of each other. All columns are kept; an empty table gives an empty result.

Method. Equal sets collapse first. A set's BANDS keys each hash BAND_ROWS minimum hashes of it; sets at similarity s share no
key with probability (1 - s^4)^28: 4e-7 at 0.8 and less above. The sets that share a key meet in one place, and of a group only
the links that join what is not joined yet are told. A pair is looked at in three steps: the pigeonring filter on the
SimHashes of the sets (from some segment on, every chain of CHAIN segments differs in at most its share of BITS bits), the
full Hamming check, and the comparison of the whole sets, so that no pair below the bound is linked. BITS is wide: sets of
FEW shingles or more at similarity 0.8 differ in 10 of 64 bits on average, in more than 24 with a probability of 4e-7 to
4e-6, by their sizes; smaller ones in more (four of five in common: 1.2e-4), so they skip the filter.

A crowded key, of more sets or shingles than a cell holds, is cut into cells by a hash of key and set, and each set is sent
to its own cell only: rows grow with the sets, never with their square. As each key deals anew, a few of them join all of
a group of copies. Crowded keys whose sets are not all joined by then hold texts that have some passages in common: there
prefixes propose the pairs. In an order of shingles from rare to frequent, two sets at 0.8 have their first common shingle
among the first fifth of each, and its places leave room for as many common ones as they need; both are exact bounds. Rare
ones come first, so what a crowd has in common stands outside of its prefixes. The order needs no exact counts: it goes by
those of ORDER_BUCKETS buckets of shingles, a table of fixed size.

The first bands link most copies; of the others only keys are looked at whose sets are not all connected by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import connected_components, materialize, plus, shielded
from rowledger.llm.simhash import least_rows, signed

SHINGLE, BANDS, BAND_ROWS = 5, 28, 4
#: Similarity as a fraction, so that the comparison is exact.
NEAR = (4, 5)
#: Bands of the first round, and what a cell holds: sets, and shingles of all of them, on average.
FIRST_BANDS, CELL_SETS, CELL_SHINGLES = 4, 1_024, 1 << 20
#: Crowded keys: buckets of the order of shingles, and what a cell of a prefix's shingle holds.
ORDER_BUCKETS, CELL_ROWS = 1 << 18, 4_096
#: Bytes of a shingle's hash that are kept for the comparison.
HASH_BYTES = 6
#: SimHash: bits that may differ, ring segments, and segments of a chain.
BITS, SEGMENTS, CHAIN = 24, 8, 4
#: Sets of fewer shingles skip the SimHash.
FEW = 8

_DRAW = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
XOR, TIMES = _DRAW[0], _DRAW[1] | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes (seed 42) of all word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    lo, hi = np.concatenate(([0], ends[:-1]))[:n].tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(lo, hi, strict=True)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2_048):
        x = (hashes[None, i : i + 2_048] ^ XOR) * TIMES
        np.minimum(least, (x ^ (x >> np.uint64(31))).min(1), out=least)
    return [signed(xxhash.xxh64_intdigest(r.tobytes(), i)) for i, r in enumerate(least.reshape(BANDS, BAND_ROWS))]


def with_set(docs: DataFrame) -> DataFrame:
    """docs with _set (a hash of the whole set, zero for the empty one), _size and _bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, bands = [], [], []
            for t in b.column("text"):
                h = shingle_set(t.as_py())
                ids.append(signed(xxhash.xxh64_intdigest(h.tobytes(), 42)) if len(h) else 0)
                sizes.append(len(h))
                bands.append(band_keys(h))
            more = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_set", "_size", "_bands"])

    return docs.mapInArrow(run, plus(docs.schema, _set="bigint", _size="bigint", _bands="array<bigint>"))


def set_print(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def hashes_of(texts: DataFrame) -> DataFrame:
    """(_set, hashes, print) of (_set, text): the first HASH_BYTES bytes of each shingle's hash, and the SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                short = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(short, pa.binary()), pa.array([signed(set_print(x)) for x in sets], pa.int64())], names=["_set", "hashes", "print"])

    return texts.select("_set", "text").mapInArrow(run, "_set long, hashes binary, print long")


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :HASH_BYTES] = raw
    return out.view("<u8").ravel()


def ring_passes(diff: np.ndarray) -> np.ndarray:
    """Pigeonring and Hamming check of differences of SimHashes."""
    step = 64 // SEGMENTS
    d = np.stack([np.bitwise_count(diff >> np.uint64(i * step) & np.uint64((1 << step) - 1)).astype(np.int64) for i in range(SEGMENTS)])
    fits, total = np.ones(d.shape, bool), np.zeros(d.shape, np.int64)
    for k in range(CHAIN):
        total = total + np.roll(d, -k, axis=0)
        fits &= total * SEGMENTS <= (k + 1) * BITS
    return fits.any(0) & (d.sum(0) <= BITS)


def fitting(sizes: np.ndarray, bits: np.ndarray, i: int) -> np.ndarray:
    """Which of the sets before i can be near it by size and SimHash."""
    fewer = np.minimum(sizes[:i], sizes[i])
    return (fewer * NEAR[1] >= np.maximum(sizes[:i], sizes[i]) * NEAR[0]) & ((fewer < FEW) | ring_passes(bits[:i] ^ bits[i]))


def near(common: int, a: int, b: int) -> bool:
    """Whether sets of a and b shingles with so many in common are near."""
    return common * NEAR[1] >= (a + b - common) * NEAR[0]


def joined(ids: list[int], roots: list[int], prints: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (a, b) of one group that join sets not joined yet."""
    n, up = len(ids), {}

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    sizes = np.array([len(x) for x in sets])
    bits = np.array(prints, np.int64).astype(np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(code))))
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in range(1, n):
        mine = find(roots[i])
        some = [j for j in np.flatnonzero(fitting(sizes, bits, i)).tolist() if find(roots[j]) != mine]
        if not some:
            continue
        codes = code[at[i] : at[i + 1]]
        if len(some) > 4:
            common = np.bincount(np.concatenate([posting[first[c] : first[c + 1]] for c in codes.tolist()]), minlength=n)[some]
        else:
            common = [len(np.intersect1d(codes, code[at[j] : at[j + 1]], assume_unique=True)) for j in some]
        for j, k in zip(some, common, strict=True):
            if near(int(k), int(sizes[i]), int(sizes[j])):
                x, y = find(roots[i]), find(roots[j])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def told(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def grouped(batches: Iterator[pa.RecordBatch], names: int) -> Iterator[list[list]]:
    """The columns behind the first `names` of each run of rows that are equal in those."""
    now, held = None, []
    for b in batches:
        group = list(zip(*(b.column(i).to_pylist() for i in range(names)), strict=True))
        rest = [b.column(i).to_pylist() for i in range(names, b.num_columns)]
        for i, name in enumerate(group):
            if name != now:
                if held:
                    yield list(map(list, zip(*held, strict=True)))
                now, held = name, []
            held.append(tuple(c[i] for c in rest))
    if held:
        yield list(map(list, zip(*held, strict=True)))


def cells() -> Column:
    """Cells of a key with n sets of total shingles."""
    return F.greatest(F.ceil(F.col("n") / CELL_SETS), F.ceil(F.col("total") / CELL_SHINGLES)).cast("int")


def linked(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the sets of each key, or of each cell of a crowded one; rows (key, _set, root, n, total)."""
    dealt = rows.select("key", F.pmod(F.xxhash64("_set", "key"), cells()).alias("cell"), "_set", "root")
    full = dealt.join(sets, "_set").select("key", "cell", "_set", "root", "print", "hashes")
    full = full.repartition("key", "cell").sortWithinPartitions("key", "cell", "_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, roots, prints, hashes in grouped(batches, 2):
            if len(ids) > 1 and (links := joined(ids, roots, prints, [unpacked(h) for h in hashes])):
                yield told(links)

    return full.mapInArrow(run, "a long, b long").distinct()


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets (hashes) fall in each of ORDER_BUCKETS buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ORDER_BUCKETS, np.int64)
        for b in batches:
            for h in b.column(0):
                counts += np.bincount((unpacked(h.as_buffer()) % np.uint64(ORDER_BUCKETS)).astype(np.int64), minlength=ORDER_BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    found = sets.select("hashes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ORDER_BUCKETS rows
    out = np.zeros(ORDER_BUCKETS, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def prefixes(crowd: DataFrame, counts: np.ndarray) -> DataFrame:
    """(shingle, _set, root, print, size, place): the first shingles of each set, from rare to frequent, of which any near one has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h in enumerate(b.column(3)):
                x = unpacked(h.as_buffer())
                n = len(x) - -(-len(x) * NEAR[0] // NEAR[1]) + 1
                x = x[np.lexsort((x, counts[(x % np.uint64(ORDER_BUCKETS)).astype(np.int64)]))[:n]].astype(np.int64)
                same = [pa.array(np.full(n, v, np.int64)) for v in (*(b.column(c)[i].as_py() for c in range(3)), len(h.as_buffer()) // HASH_BYTES)]
                yield pa.RecordBatch.from_arrays([pa.array(x), *same, pa.array(np.arange(n))], names=["shingle", "_set", "root", "print", "size", "place"])

    return crowd.select("_set", "root", "print", "hashes").mapInArrow(run, "shingle long, _set long, root long, print long, size long, place long")


def proposed(first: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of prefixes() that can be near and are not joined. Of a shingle with more than CELL_ROWS rows each pair of cells
    is a group of its own."""
    open_ones = first.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("shingle", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("cells"))
    rows = first.join(open_ones, "shingle").withColumn("cell", F.pmod(F.xxhash64("_set"), F.col("cells")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: F.struct(F.least(c, F.col("cell")).alias("x"), F.greatest(c, F.col("cell")).alias("y")))
    dealt = rows.select("shingle", "_set", "root", "print", "size", "place", "cell", F.inline(pairs))
    side = F.when(F.col("x") == F.col("y"), 0).otherwise((F.col("cell") == F.col("y")).cast("int")).alias("side")
    dealt = dealt.select("shingle", "x", "y", side, "_set", "root", "print", "size", "place").repartition("shingle").sortWithinPartitions("shingle", "x", "y", "size", "_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, ids, roots, prints, sizes, places in grouped(batches, 3):
            side, root, size, room = np.array(side), np.array(roots), np.array(sizes), np.array(sizes) - np.array(places)
            bits = np.array(prints, np.int64).astype(np.uint64)
            apart = bool(side.any())
            for i in range(1, len(ids)):
                # What is still to come from this place on must hold what a near pair has in common.
                fits = (root[:i] != root[i]) & (np.minimum(room[:i], room[i]) * (NEAR[0] + NEAR[1]) >= (size[:i] + size[i]) * NEAR[0])
                if apart:
                    fits &= side[:i] != side[i]
                if fits.any() and (some := np.flatnonzero(fits & fitting(size, bits, i)).tolist()):
                    yield told([(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in some])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i in range(b.num_rows):
                x, y = unpacked(b.column(2)[i].as_buffer()), unpacked(b.column(3)[i].as_buffer())
                if near(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    found.append((b.column(0)[i].as_py(), b.column(1)[i].as_py()))
            yield told(found)

    both = pairs.join(sets.select(F.col("_set").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("_set").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, rows["_set"] == roots["node"], "left").withColumn("root", F.coalesce("root", "_set")).drop("node")


def open_keys(rows: DataFrame) -> DataFrame:
    """(key, n, total) of the keys of rows (key, _set, _size, root) whose sets are not all joined."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("_size").alias("total"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").drop("least", "most")


def links(tagged: DataFrame) -> DataFrame:
    """(node, root) of all sets that are linked, from (text, _set, _size, _bands)."""
    keyed = tagged.groupBy("_set").agg(F.max("_size").alias("_size"), F.first("_bands").alias("_bands")).select("_set", "_size", F.posexplode("_bands").alias("band", "key"))
    keyed = materialize(keyed, "near-keys")
    shared = materialize(keyed.join(keyed.groupBy("key").count().where("count > 1"), "key", "left_semi"), "near-shared")
    some = tagged.select("_set", "text").join(shared.select("_set").distinct(), "_set", "left_semi").dropDuplicates(["_set"])
    sets = materialize(hashes_of(some), "near-sets")
    found, roots = None, None
    for part in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        rows = shared.where(part)
        rows = rows.withColumn("root", F.col("_set")) if roots is None else with_roots(rows, roots)
        rows = materialize(rows.select("key", "_set", "_size", "root"), "near-rows")
        new = linked(rows.join(open_keys(rows), "key"), sets)
        found = materialize(new if found is None else found.union(new), "near-links")
        roots = connected_components(found, "near-components")
    crowded = materialize(shared.groupBy("key").agg(F.count("*").alias("n"), F.sum("_size").alias("total")).where(cells() > 1).select("key"), "near-crowded")
    if crowded.isEmpty():
        return roots
    rows = materialize(with_roots(shared.join(crowded, "key").select("key", "_set", "_size"), roots), "near-rows")
    crowd = rows.join(open_keys(rows), "key", "left_semi").select("_set", "root").distinct().join(sets, "_set")
    crowd = materialize(crowd, "near-crowd")
    if crowd.isEmpty():
        return roots
    pairs = materialize(proposed(materialize(prefixes(crowd, bucket_counts(crowd)), "near-prefixes")), "near-pairs")
    return connected_components(found.union(compared(pairs, sets)), "near-components")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies."""
    inner = shielded(docs, "doc_id", "text")
    tagged = materialize(with_set(inner), "near-docs")
    return least_rows(tagged, links(tagged), inner.columns).toDF(*docs.columns)
