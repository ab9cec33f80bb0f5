"""Packing documents into sequences by cutting-stock column generation.

Contract: one row per piece with doc_id, start, length, ids, doc_tokens, sequence_id and offset; every id of every
document, its closing id included, lies in exactly one piece. Null and empty texts are the closing id alone. Repeated
rows are packed each; extra columns are ignored; an empty table gives an empty result. Sequences hold at most `capacity`
ids; they are padded up to it but for those whose ids are a power of two.

Method. A document gives whole sequences and a rest, and the rest is cut into halves, quarters and so on of a sequence,
down to `unit` ids, and what remains below that: parts of few lengths fit together whatever lengths are common. The
histogram of the lengths, at most `capacity` numbers, is the only thing that comes to the driver. A linear program over patterns (how
many parts of each length share a sequence) is solved by column generation: a knapsack dynamic program over the dual
prices finds the pattern worth most until none is worth more than a sequence. Patterns are rounded down, what is left
is packed by first fit decreasing, and the parts, ranked within their length by hash buckets, take the patterns' places
in order of rank.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.llm.common import bucket_count, materialize, order_hash, plus, running_start

CAPACITY, UNIT, END = 2_048, 128, 1
#: Sequence ids: packed rests count up from zero, whole sequences from here.
WHOLE = 1 << 62

_ENCODERS: dict[object, object] = {}


def encoder(path: str):  # noqa: ANN201
    """An encoder (text -> ids) for a byte-level BPE file of the tokenizers library, made once in each process.

    tiktoken runs the file's own vocabulary some four times as fast as the library that wrote it, with equal ids: a
    byte-level vocabulary lists its merges in the order of their ids, which is checked here. Tests hold the two against
    each other.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: merges do not stand in the order of their ids")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: byte-level BPE writes these bytes as themselves
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and t != "<|endoftext|>"}
        _ENCODERS[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _ENCODERS[path]


def encoder_with_added(path: str):  # noqa: ANN201
    """An encoder with the ids of the tokenizers library without switches: the file's added tokens are matched in the
    text, the leftmost first, and what stands between them is encoded piece by piece."""
    if (path, "added") not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}
        plain = encoder(path)
        marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

        def encode(text: str) -> list[int]:
            if marks is None or not any(t in text for t in added):
                return plain(text)
            out: list[int] = []
            for i, part in enumerate(marks.split(text)):
                out += [added[part]] if i % 2 else plain(part)
            return out

        _ENCODERS[path, "added"] = encode
    return _ENCODERS[path, "added"]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def cuts(n: int, capacity: int, unit: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of n ids."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at, size = len(out) * capacity, capacity // 2
    while size >= unit:
        if n - at >= size:
            out.append((at, size))
            at += size
        size //= 2
    return [*out, (at, n - at)] if at < n else out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, unit: int = UNIT, end: int = END, digest: bool = False) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens) of all parts; ids as crc32 only if digest is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_with_added(path)
        for b in batches:
            owner, start, length, total, payload = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.array([*encode((t.as_py() or "")), end], "<u4")
                for s, size in cuts(len(ids), capacity, unit):
                    part = ids[s : s + size]
                    owner.append(i)
                    start.append(s)
                    length.append(size)
                    total.append(len(ids))
                    payload.append(zlib.crc32(part.tobytes()) if digest else part.astype(np.int32))
            column = pa.array(payload, pa.int64() if digest else pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), column, pa.array(total, pa.int64())], names=["doc_id", "start", "length", name, "doc_tokens"])

    kept, name = docs.select("doc_id", "text"), "ids_crc32" if digest else "ids"
    kind = "bigint" if digest else "array<int>"
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, start long, length long, {name} {kind}, doc_tokens long")


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern worth most. sizes ascend."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if w := fit[c]:
            worth = best[c - sizes[:w]] + values[:w]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], item[c] = worth[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            pattern[item[c]] += 1
            c -= sizes[item[c]]
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering demand[i] items of i + 1 units exactly, few sequences in all."""
    left = demand.astype(np.int64).copy()
    rows = np.flatnonzero(left)
    if not len(rows):
        return []
    n = len(demand)
    basis = [np.where(np.arange(n) == r, capacity // (r + 1), 0) for r in rows]
    inverse = np.diag([1.0 / (capacity // (r + 1)) for r in rows])
    x = inverse @ left[rows]
    for _ in range(rounds):
        worth, bought = price(rows + 1, inverse.sum(0), capacity)  # the duals: every pattern costs one sequence
        pattern = np.zeros(n, np.int64)
        pattern[rows] = bought
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ pattern[rows]
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(0, x - step * direction)
        x[out] = step
        inverse[out] /= direction[out]
        others = np.arange(len(rows)) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        basis[out] = pattern
    plan = []
    for p, times in zip(basis, np.floor(x + 1e-6).astype(np.int64), strict=True):
        times = min([int(times), *(left[p > 0] // p[p > 0]).tolist()])
        if times > 0:
            plan.append((p, times))
            left -= p * times
    while left.any():  # first fit decreasing: few sequences, at most about one for each pattern
        p, room = np.zeros(n, np.int64), capacity
        for i in range(n - 1, -1, -1):
            take = min(int(left[i]), room // (i + 1))
            p[i] += take
            room -= take * (i + 1)
        times = int((left[p > 0] // p[p > 0]).min())
        plan.append((p, times))
        left -= p * times
    return plan


def places(plan: list[tuple[np.ndarray, int]], n: int) -> list[tuple[np.ndarray, ...]]:
    """For each bin: first rank, first sequence, items a sequence and first slot of each pattern that uses it."""
    out, first = [[] for _ in range(n)], 0
    taken = np.zeros(n, np.int64)
    for p, times in plan:
        slot = 0
        for i in np.flatnonzero(p):
            out[i].append((taken[i], first, p[i], slot))
            taken[i] += p[i] * times
            slot += p[i]
        first += times
    return [tuple(np.array(x, np.int64).reshape(-1, 4).T) for x in out]


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (start, length and any more columns) with sequence_id and offset. parts is read more than once."""
    parts = parts.withColumn("_bin", F.col("length").cast("int")).withColumn("_h", order_hash(F.col("doc_id"), F.col("start"), F.col("length")))
    # Parts of repeated ids differ in their ids or totals, so that a task run again ranks them alike.
    rest = [c for c in ("ids", "ids_crc32", "doc_tokens") if c in parts.columns]
    parts = parts.withColumn("_one", F.lit(1).cast("long")).withColumn("_tie", F.xxhash64(*rest) if rest else F.lit(0))
    histogram = {r["_bin"]: r["n"] for r in parts.groupBy("_bin").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    ranked = running_start(parts, "_bin", ["_h", "doc_id", "_tie"], "_one", "_rank", bucket_count(sum(histogram.values())))
    demand = np.array([histogram.get(i + 1, 0) for i in range(capacity - 1)], np.int64)
    at = places(solve(demand, capacity), capacity - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, ranks = b.column("_bin").to_numpy(), b.column("_rank").to_numpy()
            seq, slot = ranks + WHOLE, np.zeros(len(ranks), np.int64)
            for i in np.unique(bins[bins < capacity]):
                m = bins == i
                rank, first, many, base = at[i - 1]
                k = np.searchsorted(rank, ranks[m], side="right") - 1
                j = ranks[m] - rank[k]
                seq[m], slot[m] = first[k] + j // many[k], base[k] + j % many[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq, pa.int64()), pa.array(slot, pa.int64())], names=[*b.schema.names, "sequence_id", "_slot"])

    ranked = ranked.drop("_h", "_one", "_tie")
    placed = ranked.mapInArrow(run, plus(ranked.schema, sequence_id="bigint", _slot="bigint"))
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.withColumn("offset", offset).drop("_bin", "_rank", "_slot")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT, end: int = END, digest: bool = False) -> DataFrame:
    """The pieces of all documents and their places; digest keeps a crc32 of each piece's ids instead of the ids."""
    parts = pieces(docs, path or vocabulary(), capacity, unit, end, digest)
    return place(materialize(parts, "pack-pieces"), capacity)
