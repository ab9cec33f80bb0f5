"""Language identification by prediction by partial matching under frozen statistics.

Contract: one row per input row with doc_id, held_out, lang_pred and score (0 to 1). Predictions depend on the text alone.
Null texts and texts without a letter are `und` with score 0; ties go to the language first in code point order;
repeated rows count each; extra columns are ignored; an empty table gives an empty result, and without any labelled text
every prediction is `und`.

Method. For each language a tree of byte contexts up to `order` bytes is counted on a bounded sample outside the
held-out fold. A byte's code length in its longest known context is the logarithm of n / (t + d), n being its count, t the
context's total and d its number of distinct bytes; a byte that is new there costs the escape d / (t + d) and is coded
in the next shorter context, at last evenly over 256 bytes (escape method C, without exclusions). As statistics are frozen, code lengths
are a table of (context, byte), and a text's code length is a sum over its bytes, computed for all languages at once
over whole texts, in blocks. The score is the share of the shortest code: 2 to the power of minus the mean length times a few bytes, over
the sum for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import is_held_out

BLOCK = 1 << 18


@dataclass(frozen=True)
class Settings:
    order: int = 4
    #: The sample's bounds for each language: rows and bytes.
    sample_rows: int = 400
    sample_bytes: int = 600_000
    #: A context is kept if it stands so often in the sample.
    least: int = 8
    #: The number of bytes whose code lengths the score compares.
    sharpness: float = 24.0


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...] = ()
    classes: np.ndarray = field(default_factory=lambda: np.zeros(256, np.int32))
    #: child[node * n_classes + class of the byte before] is a node or 0, the root.
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    #: bits[node * n_classes + class of the byte, language]
    bits: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    settings: Settings = field(default_factory=Settings)


def classes_of(texts: list[bytes]) -> tuple[np.ndarray, int]:
    """Bytes that no sample holds are alike to every tree and share class 0; the line end stands between samples."""
    seen = np.arange(256) == 10
    for t in texts:
        seen |= np.bincount(np.frombuffer(t, np.uint8), minlength=256) > 0
    return np.where(seen, np.cumsum(seen), 0).astype(np.int32), int(seen.sum()) + 1


def walk(codes: np.ndarray, child: np.ndarray, width: int, order: int) -> np.ndarray:
    """The node of the longest known context before each position."""
    node = np.zeros(len(codes), np.int32)
    live = np.arange(len(codes))
    for k in range(1, order + 1):
        live = live[live >= k]
        deeper = child[node[live] * width + codes[live - k]]
        live = live[deeper > 0]
        node[live] = deeper[deeper > 0]
        if not len(live):
            break
    return node


def build(samples: dict[str, list[bytes]], s: Settings) -> Model:
    """The trees of all languages over one set of contexts: the union of what is frequent in any."""
    langs = tuple(sorted(k for k, v in samples.items() if v))
    if not langs:
        return Model(settings=s)
    classes, width = classes_of([t for k in langs for t in samples[k]])
    gap = b"\n" * s.order
    streams = [classes[np.frombuffer(gap + gap.join(samples[k]), np.uint8)] for k in langs]
    child, parent, counts = np.zeros(width, np.int32), np.zeros(1, np.int32), []
    nodes = 1
    # Grow level by level: positions whose context is a node of this depth, split by the byte before it.
    at = [np.zeros(len(x), np.int32) for x in streams]
    live = [np.arange(len(x)) for x in streams]
    levels = [(0, 1)]
    for depth in range(1, s.order + 1):
        total: dict[int, int] = {}
        for x, a, i in zip(streams, at, live, strict=True):
            i = i[i >= depth]
            keys, n = np.unique(a[i].astype(np.int64) * width + x[i - depth], return_counts=True)
            for k, c in zip(keys.tolist(), n.tolist(), strict=True):
                total[k] = max(total.get(k, 0), c)
        grown = sorted(k for k, c in total.items() if c >= s.least)
        if not grown:
            break
        child = np.concatenate([child, np.zeros(len(grown) * width, np.int32)])
        child[grown] = np.arange(nodes, nodes + len(grown))
        parent = np.concatenate([parent, np.array(grown, np.int64) // width]).astype(np.int32)
        levels.append((nodes, nodes + len(grown)))
        nodes += len(grown)
        for j, (x, i) in enumerate(zip(streams, live, strict=True)):
            i = i[i >= depth]
            to = child[at[j][i].astype(np.int64) * width + x[i - depth]]
            at[j][i[to > 0]] = to[to > 0]
            live[j] = i[to > 0]
    bits = np.zeros((nodes * width, len(langs)), np.float32)
    for j, x in enumerate(streams):
        # A position counts in its deepest node and in all shorter contexts.
        own = np.bincount(at[j][s.order :].astype(np.int64) * width + x[s.order :], minlength=nodes * width).reshape(nodes, width).astype(np.float64)
        for a, b in reversed(levels[1:]):
            np.add.at(own, parent[a:b], own[a:b])
        counts.append(own)
        p = np.empty((nodes, width))
        for a, b in levels:
            n = own[a:b]
            t, d = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            shorter = np.full((b - a, width), 1 / 256) if a == 0 else p[parent[a:b]]
            known = t > 0
            p[a:b] = np.where(known, np.where(n > 0, n, d * shorter) / np.maximum(t + d, 1), shorter)
        bits[:, j] = -np.log2(p).reshape(-1)
    return Model(langs, classes, child, bits, s)


def code_lengths(model: Model, data: bytes) -> np.ndarray:
    """Bits of data for each language."""
    width, order = int(model.classes.max()) + 1, model.settings.order
    total = np.zeros(len(model.langs))
    codes = model.classes[np.frombuffer(b"\n" * order + data, np.uint8)]
    for a in range(order, len(codes), BLOCK):
        part = codes[a - order : a + BLOCK]
        node = walk(part, model.child, width, order)[order:]
        total += model.bits[node.astype(np.int64) * width + part[order:]].sum(0, dtype=np.float64)
    return total


def batch_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text for each language; texts are coded together, each after line ends of its own."""
    width, order = int(model.classes.max()) + 1, model.settings.order
    gap = b"\n" * order
    codes = model.classes[np.frombuffer(gap + gap.join(texts) + gap, np.uint8)]
    sizes = np.array([len(t) for t in texts])
    starts = order + np.concatenate(([0], np.cumsum(sizes + order)[:-1]))
    row = model.bits[walk(codes, model.child, width, order).astype(np.int64) * width + codes]
    sums = np.concatenate([np.zeros((1, row.shape[1])), np.cumsum(row, 0, dtype=np.float64)])
    return sums[starts + sizes] - sums[starts]


def decide(model: Model, bits: np.ndarray, size: int) -> tuple[str, float]:
    mean = bits / max(1, size)
    share = 2 ** (-(mean - mean.min()) * model.settings.sharpness)
    return model.langs[int(mean.argmin())], float(1 / share.sum())


def fit(docs: DataFrame, s: Settings | None = None) -> Model:
    s = s or Settings()
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count()  # one row per language
    chosen = rows.where("text is not null").join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(float(s.sample_rows << 20)) / F.col("count"))
    most = (s.sample_rows + 100) * max(1, counts.count())
    samples: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    # No text comes longer than a language's whole bound; the one that crosses it is cut there.
    part = F.substring("text", 1, s.sample_bytes).alias("text")
    for r in chosen.select("lang", "doc_id", part).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).toLocalIterator():
        data = r["text"].encode("utf-8", "replace")[: room.setdefault(r["lang"], s.sample_bytes)]
        if data:
            room[r["lang"]] -= len(data)
            samples.setdefault(r["lang"], []).append(data)
    return build(samples, s)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores, todo = ["und"] * b.num_rows, [0.0] * b.num_rows, []
            for i, (t, letters) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                if m.langs and letters.as_py():
                    todo.append((i, t.as_py().encode("utf-8", "replace")))
            k = 0
            while k < len(todo):
                if len(todo[k][1]) > BLOCK:
                    part, bits = todo[k : k + 1], [code_lengths(m, todo[k][1])]
                else:
                    e, size = k, 0
                    while e < len(todo) and size + len(todo[e][1]) <= BLOCK:
                        size += len(todo[e][1])
                        e += 1
                    part = todo[k:e]
                    bits = batch_lengths(m, [x for _, x in part])
                for (i, data), x in zip(part, bits, strict=True):
                    names[i], scores[i] = decide(m, x, len(data))
                k += len(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
