"""Alignment of two tokenizers over the same texts: where their tokens end together, and how often which ids do.

Contract: one row per input row with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256. A text is
encoded with a space in front of it by A (byte-level BPE) and by B (pieces; it adds the space itself), special tokens'
strings being plain text. Byte offsets at which tokens of both end cut the tokens into groups; the two tokens that end there are
a link. A pair's count is the number of its links in all rows; n_best counts a row's links whose pair has the highest
count of its B id (ties included), count_sum adds the counts over its links. Null and empty texts, and those that A's or B's
tokens do not spell byte for byte, have no tokens: zeros, and '' for the hash. Repeated rows count each; extra columns are
ignored; an empty table gives an empty result.

Method. An inverted index of pairs: texts come in blocks of at most BLOCK_ROWS rows, and for each pair of a block a bitmap
says which rows hold it. Multiplicities are cut into binary planes, a bitmap each, so plane k holds the rows in whose
multiplicity bit k is set. The planes of a pair OR-merge into its documents; popcounts give the number of documents, and
those of the planes, times powers of two, the number of links. Bitmaps are stored compressed, a block a row of a table. The
numbers are added over blocks by pair; of two ids that end together one's bytes end with the other's, so that there are never
more pairs than bytes in both vocabularies (`most_pairs`), and the table of counts goes to the tasks, where each bitmap's postings return
their pair's score to their rows. A block is bounded by its rows and bytes (one text may be longer), so memory does not
depend on the number of texts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.llm import packing
from rowledger.llm.common import materialize

BLOCK_ROWS, BLOCK_BYTES = 1_024, 4 << 20


@dataclass(frozen=True)
class Pair:
    """Two encoders with the bytes of all their ids."""

    encode_a: object
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    def __post_init__(self) -> None:
        object.__setattr__(self, "len_a", np.array([len(x) for x in self.bytes_a], np.int64))
        object.__setattr__(self, "len_b", np.array([len(x) for x in self.bytes_b], np.int64))
        # What a token adds to the digest's text: its id and the mark behind it, inside a group or at its end.
        marks = [f"{i}{m}" for i in range(len(self.bytes_a)) for m in ",|"] + [f"{i}{m}" for i in range(len(self.bytes_b)) for m in ",;"]
        object.__setattr__(self, "marks", marks)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """The two tokenizers, loaded once in each process."""
    if (path_a, path_b) not in _PAIRS:
        import sentencepiece

        a = packing.encoder(path_a)
        table, b = a.__self__, sentencepiece.SentencePieceProcessor(model_file=path_b)
        first = [b""] * table.n_vocab
        for t in table.token_byte_values():
            first[table.encode_single_token(t)] = t
        pieces = b.id_to_piece(list(range(b.get_piece_size())))
        second = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        _PAIRS[path_a, path_b] = Pair(a, b.encode, first, second)
    return _PAIRS[path_a, path_b]


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return packing.vocabulary(), os.fspath(public_tokenizers.path("piece_bpe_32k.model"))


def most_pairs(p: Pair) -> int:
    """No more pairs of ids can end together: one's bytes are among the suffixes of the other's."""
    return int(p.len_a.sum() + p.len_b.sum())


@dataclass(frozen=True)
class Aligned:
    a: np.ndarray
    b: np.ndarray
    #: Whether a token is the last one of its group.
    last_a: np.ndarray
    last_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return self.a[self.last_a], self.b[self.last_b]

    def groups(self, p: Pair) -> str:
        """a1,a2|b1;a3|b2,b3"""
        if not len(self.a):
            return ""
        ends_a, ends_b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + np.concatenate(([0], ends_b))[group_a]] = 2 * self.a + self.last_a
        out[np.arange(len(self.b)) + ends_a[group_b]] = 2 * (len(p.bytes_a) + self.b) + self.last_b
        return "".join(map(p.marks.__getitem__, out.tolist()))[:-1]


NOTHING = Aligned(*[np.zeros(0, np.int64)] * 2, *[np.zeros(0, bool)] * 2)


def align(text: str | None, p: Pair) -> Aligned:
    if not text:
        return NOTHING
    data = (" " + text).encode("utf-8", "surrogatepass")
    a, b = p.encode_a(" " + text), p.encode_b(text)
    if b"".join(map(p.bytes_b.__getitem__, b)) != data or b"".join(map(p.bytes_a.__getitem__, a)) != data:
        return NOTHING
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    ends_a, ends_b = np.cumsum(p.len_a[a]), np.cumsum(p.len_b[b])
    at_a, at_b = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    at_a[ends_a] = at_b[ends_b] = True
    return Aligned(a, b, at_b[ends_a], at_a[ends_b])


def planes_of(pair: np.ndarray, row: np.ndarray, times: np.ndarray, rows: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(sorted pairs, planes) of postings: plane k is (places of its pairs, a bitmap of `rows` bits for each of them)."""
    pairs, at = np.unique(pair, return_inverse=True)
    planes = []
    for k in range(int(times.max()).bit_length() if len(times) else 0):
        has = (times >> k & 1).astype(bool)
        places, i = np.unique(at[has], return_inverse=True)
        bits = np.zeros((len(places), -(-rows // 64) * 8), np.uint8)
        np.bitwise_or.at(bits, (i, row[has] >> 3), (1 << (row[has] & 7)).astype(np.uint8))
        planes.append((places, bits))
    return pairs, planes


def packed(pairs: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, list[bytes], list[bytes]]:
    press = zstandard.ZstdCompressor(level=1).compress
    return press(np.diff(pairs, prepend=0).astype("<i8").tobytes()), [press(places.astype("<i4").tobytes()) for places, _ in planes], [press(bits.tobytes()) for _, bits in planes]


def opened(pairs: bytes, places: list[bytes], bits: list[bytes], rows: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    plain = zstandard.ZstdDecompressor().decompress
    width = -(-rows // 64) * 8
    return np.cumsum(np.frombuffer(plain(pairs), "<i8")), [(np.frombuffer(plain(i), "<i4"), np.frombuffer(plain(x), np.uint8).reshape(-1, width)) for i, x in zip(places, bits, strict=True)]


def popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits.view(np.uint64)).sum(1, dtype=np.int64)


def counted(pairs: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, links) of each pair: the popcount of its OR-merged planes, and the planes' own by their weight."""
    documents, links = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    if planes:
        merged = np.zeros((len(pairs), planes[0][1].shape[1]), np.uint8)
        for k, (places, bits) in enumerate(planes):
            merged[places] |= bits
            links[places] += popcount(bits) << k
        documents = popcount(merged)
    return documents, links


def returned(planes: list[tuple[np.ndarray, np.ndarray]], score: np.ndarray, rows: int) -> np.ndarray:
    """For each row the sum of its pairs' scores, times their multiplicities. Exact: halves of 32 bits are added apart."""
    out = np.zeros(rows, np.int64)
    for k, (places, bits) in enumerate(planes):
        for i in range(0, len(places), 8_192):
            pair, row = np.unpackbits(bits[i : i + 8_192], axis=1, count=rows, bitorder="little").nonzero()
            value = score[places[i : i + 8_192]][pair]
            for half, shift in ((value & 0xFFFFFFFF, 0), (value >> 32, 32)):
                out += np.bincount(row, half, rows).astype(np.int64) << (k + shift)
    return out


BLOCK = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs binary, places array<binary>, bits array<binary>"


def index(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per block of texts: what each of them holds, and the block's pairs with their bitmaps."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair_of(path_a, path_b)
        numbers = [pa.list_(pa.int64())] * 4
        kinds = [*numbers, pa.list_(pa.string()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        names = ["doc_ids", *[c.split()[0] for c in BLOCK.split(", ")]]

        def block(ids: pa.Array, found: list[Aligned], digests: list[str]) -> pa.RecordBatch:
            posting = [np.unique(np.left_shift(x[0], 32) | x[1], return_counts=True) for x in (f.links() for f in found)]
            row = np.repeat(np.arange(len(found)), [len(u) for u, _ in posting])
            made = planes_of(np.concatenate([u for u, _ in posting]), row, np.concatenate([n for _, n in posting]), len(found))
            sizes = [[len(f.a) for f in found], [len(f.b) for f in found], *[[int(f.last_a.sum()) for f in found]] * 2]
            values = [pa.array([x], k) for x, k in zip([*sizes, digests, *packed(*made)], kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *values], names=names)

        for b in batches:
            first, size, found, digests = 0, 0, [], []
            for i, t in enumerate(b.column(1)):
                f = align(t.as_py(), p)
                found.append(f)
                digests.append(hashlib.sha256(f.groups(p).encode()).hexdigest() if len(f.a) else "")
                size += int(p.len_a[f.a].sum())
                if len(found) == BLOCK_ROWS or size >= BLOCK_BYTES or i + 1 == b.num_rows:
                    yield block(b.column(0).slice(first, len(found)), found, digests)
                    first, size, found, digests = i + 1, 0, [], []

    return rows.mapInArrow(run, f"doc_ids array<{kind.simpleString()}>, {BLOCK}")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best) of every pair of ids: rows that hold it, links, and whether no pair of its b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, *held in zip(*[c.to_pylist() for c in b.columns], strict=True):
                pairs, planes = opened(*held, rows)
                documents, links = counted(pairs, planes)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(documents), pa.array(links)], names=["pair", "n_docs", "n_links"])

    one = blocks.select(F.size("n_a").alias("rows"), "pairs", "places", "bits").mapInArrow(run, "pair long, n_docs long, n_links long")
    sums = one.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    sums = sums.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n_docs", "n_links")
    sums = materialize(sums, "align-pairs")
    return sums.join(sums.groupBy("b").agg(F.max("n_links").alias("_most")), "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("best"))


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of all blocks, to which the postings have returned their pairs' counts."""
    spark = blocks.sparkSession
    made = counts.select((F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("pair"), "n_links", "best").toArrow().sort_by("pair")  # at most most_pairs
    shared = spark.sparkContext.broadcast(tuple(made.column(c).to_numpy() for c in ("pair", "n_links", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = shared.value
        for b in batches:
            for i in range(b.num_rows):
                at = {n: b.column(n)[i] for n in b.schema.names}
                rows = len(at["n_a"])
                pairs, planes = opened(at["pairs"].as_py(), at["places"].as_py(), at["bits"].as_py(), rows)
                place = np.searchsorted(known, pairs)
                sums = [pa.array(returned(planes, x[place].astype(np.int64), rows)) for x in (best, links)]
                plain = [at[n].values for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*plain, *sums, at["groups_sha256"].values], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def correspond(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs (doc_id, text)."""
    a, b = vocabularies()
    blocks = materialize(index(docs, path_a or a, path_b or b), "align-blocks")
    return scored(blocks, pair_counts(blocks))
