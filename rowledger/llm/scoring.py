"""Scoring of texts by an n-gram language model with deleted interpolation.

Contract: one row per input row with doc_id, held_out (crc32 of the id as text leaves 0 by division by `folds`), n_tokens,
n_known, train_tokens, base_score and score. Tokens are a text's words, A-Z in lower case, and one end; the model learns
from all rows that are not held out. base_score is the unigram score smoothed by a tenth of a count, score the base 10
logarithm of the model's probability of the whole text. Null and empty texts are the end alone; a null id is not held
out; repeated rows count each; extra columns are ignored; an empty table gives an empty result, and with nothing to learn
from every probability is one of a single unknown word.

Method. P(w | context) mixes maximum-likelihood estimates recursively: the share of w behind the whole context with weight
l, and with 1 - l the same for a context that is one word shorter, at last an even share of all known words and one
unknown. l depends on how often the context was seen, in powers of two. The weights are learned by expectation-maximisation: a part of the training
rows is deleted from the counts (crc32 leaves `deleted`), and the weights that make its counts likely under the counts that
are left are found; the final model has the counts of all training rows. Every n-gram is counted, none is pruned.

As a job: texts come in blocks of about `block_tokens` tokens. A block asks for the counts of its distinct n-grams, packed
by ranges of their 62-bit hashes; a range adds what all blocks tell it and answers each, so a frequent n-gram is one number a block and no
key is hot. Weights, and two totals, are all that comes to the driver. A text longer than a block is scored in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rowledger.llm.common import materialize

#: Bytes of a text that are split at once; the cut falls on white space.
STEP = 4 << 20
HELD_OUT, DELETED, KEPT = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    order: int = 2
    folds: int = 10
    #: The remainder of crc32 whose training rows the weights are learned on.
    deleted: int = 1
    block_tokens: int = 1 << 19
    #: Distinct n-grams of blocks that a range of hashes holds on average.
    range_grams: int = 1 << 20
    #: Expectation-maximisation ends after so many rounds, or when the log likelihood rises by less than this share.
    rounds: int = 15
    tolerance: float = 1e-4


@dataclass(frozen=True)
class Totals:
    """Training tokens and distinct ones among them; the same of the kept part."""

    tokens: int = 0
    words: int = 0
    kept_tokens: int = 0
    kept_words: int = 0


class Words(dict):
    """Local numbers of words in the order in which they come. A word holds no blank, so the two marks are none."""

    def __init__(self) -> None:
        super().__init__({b" start": 0, b" end": 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time, and its end."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    a = 0
    while len(data) - a > STEP:
        b = a + STEP
        while b < len(data) and not data[b : b + 1].isspace():
            b += 1
        yield data[a:b].split()
        a = b
    yield [*data[a:].split(), b" end"]


@dataclass
class Block:
    """Pieces of texts, each with the `lead` words before it."""

    lead: int
    words: Words = field(default_factory=Words)
    parts: list[np.ndarray] = field(default_factory=list)
    ids: list[object] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    begins: list[bool] = field(default_factory=list)
    tokens: int = 0

    def add(self, doc_id: object, row: int, words: list[bytes], before: list[bytes], begins: bool) -> None:
        get = self.words.__getitem__
        self.parts.append(np.fromiter(map(get, before + words), np.int32, len(before) + len(words)))
        self.ids.append(doc_id)
        self.rows.append(row)
        self.sizes.append(len(words))
        self.begins.append(begins)
        self.tokens += len(words)

    def packed(self) -> bytes:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        t = np.concatenate(self.parts).astype("<u4").view(np.uint8).reshape(-1, 4).T
        return zstandard.ZstdCompressor(level=3).compress(np.int64(len(hashes)).tobytes() + hashes.astype("<u8").tobytes() + t.tobytes())


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each local word, local words)"""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    t = np.frombuffer(raw, np.uint8, offset=8 + 8 * n).reshape(4, -1).T
    return np.frombuffer(raw, "<u8", n, 8), np.ascontiguousarray(t).view("<u4").reshape(-1).astype(np.int64)


def blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """(block, fold, n_tokens, doc_ids, rows, sizes, begins, payload); a block holds rows of one fold."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(s.folds)), F.lit(-1))
    fold = F.when(fold == 0, HELD_OUT).when(fold == s.deleted, DELETED).otherwise(KEPT).cast("int")
    docs = docs.select("doc_id", "text", fold.alias("fold"))
    kind, lead = docs.schema["doc_id"].dataType, s.order - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        made, row = 0, 0
        held: dict[int, Block] = {}

        def flush(fold: int, ids: pa.DataType) -> pa.RecordBatch:
            nonlocal made
            b = held.pop(fold)
            made += 1
            lists = [pa.array([x], pa.list_(k)) for x, k in ((b.ids, ids), (b.rows, pa.int64()), (b.sizes, pa.int64()), (b.begins, pa.bool_()))]
            columns = [pa.array([first + made]), pa.array([fold], pa.int32()), pa.array([b.tokens], pa.int64()), *lists, pa.array([b.packed()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "fold", "n_tokens", "doc_ids", "rows", "sizes", "begins", "payload"])

        ids = pa.null()
        for b in batches:
            ids = b.column(0).type
            for doc_id, text, fold in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                row, before, begins = row + 1, [b" start"] * lead, True
                for words in word_lists(text.as_py()):
                    while words:
                        block = held.setdefault(fold, Block(lead))
                        part, words = words[: s.block_tokens - block.tokens], words[s.block_tokens - block.tokens :]
                        block.add(doc_id.as_py(), first + row, part, before, begins)
                        before, begins = [*before, *part][len(part) :] if lead else [], False
                        if block.tokens >= s.block_tokens:
                            yield flush(fold, ids)
        for fold in list(held):
            yield flush(fold, ids)

    schema = f"block long, fold int, n_tokens long, doc_ids array<{kind.simpleString()}>, rows array<long>, sizes array<long>, begins array<boolean>, payload binary"
    return docs.mapInArrow(run, schema)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Grams:
    """Distinct n-grams of one length in a block: hash keys, how often each counts, one place of each, and which one ends at
    each place (-1: none)."""

    keys: np.ndarray
    times: np.ndarray
    place: np.ndarray
    at: np.ndarray


def key_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """62 bits of the hash and the length, so that lengths never meet."""
    return (hashes & ~np.uint64(3)) | np.uint64(length)


START_KEY = key_of(np.array([xxhash.xxh3_64_intdigest(b" start")], np.uint64), 1)[0]


def grams(hashes: np.ndarray, t: np.ndarray, sizes: np.ndarray, begins: np.ndarray, order: int) -> list[Grams]:
    lead = order - 1
    ends = np.cumsum(sizes + lead)
    starts = ends - sizes - lead
    depth = np.arange(len(t)) - np.repeat(starts, sizes + lead)
    counts = depth >= lead
    if lead:  # starts of whole texts are contexts as well
        counts[starts[begins] + lead - 1] = True
    n = len(hashes)
    out = [Grams(key_of(hashes, 1), np.bincount(t, counts, n).astype(np.int64), np.zeros(0, np.int64), t)]
    raw = hashes
    for length in range(2, order + 1):
        i = np.flatnonzero(depth >= length - 1)
        ids, place, at, _ = np.unique(out[-1].at[i - 1] * n + t[i], return_index=True, return_inverse=True, return_counts=True)
        raw = mixed(raw[ids // n], hashes[ids % n])
        every = np.full(len(t), -1, np.int64)
        every[i] = at
        out.append(Grams(key_of(raw, length), np.bincount(at, counts[i], len(ids)).astype(np.int64), i[place], every))
    return out


def squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def widened(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").reshape(-1)


def block_grams(row: dict, order: int) -> tuple[list[Grams], np.ndarray]:
    """The n-grams of a row of blocks, and the order of all their keys."""
    made = grams(*unpacked(row["payload"]), np.array(row["sizes"], np.int64), np.array(row["begins"], bool), order)
    return made, np.argsort(np.concatenate([g.keys for g in made]), kind="stable")


def counted(made: DataFrame, s: Settings, ranges: int) -> DataFrame:
    """(block, fold, range, kept, deleted, words, kept_words): for each block the counts of its n-grams in the order of their keys,
    and, once a range, how many words were seen in training."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                own, order = block_grams(row, s.order)
                keys = np.concatenate([g.keys for g in own])[order]
                times = np.concatenate([g.times for g in own])[order] if row["fold"] != HELD_OUT else np.zeros(len(keys), np.int64)
                to = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(to, prepend=-1, append=ranges))
                parts = [(int(to[x]), squeezed(np.diff(keys[x:y], prepend=np.uint64(0))), squeezed(times[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                for j in range(0, len(parts), 4_096):
                    to_, keys_, times_ = zip(*parts[j : j + 4_096], strict=True)
                    same = [pa.array([row[c]] * len(to_), k) for c, k in (("block", pa.int64()), ("fold", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(to_, pa.int64()), pa.array(keys_, pa.binary()), pa.array(times_, pa.binary())], names=["block", "fold", "range", "keys", "times"])

    def answer(asked: pa.Table) -> pa.Table:
        keys = [widened(x.as_py()) for x in asked.column("keys")]
        keys = [np.cumsum(x) for x in keys]
        times = [widened(x.as_py()).astype(np.int64) for x in asked.column("times")]
        fold = np.repeat(np.array(asked.column("fold").to_pylist()), [len(x) for x in keys])
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.concatenate(times)
        kept, deleted = (np.bincount(at, np.where(fold == f, every, 0), len(known)).astype(np.int64) for f in (KEPT, DELETED))
        word = (known & np.uint64(3) == 1) & (known != START_KEY)
        cuts = np.cumsum([0, *map(len, keys)])
        told = [[squeezed(x[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (kept, deleted)]
        once = [[int(n)] + [0] * (len(keys) - 1) for n in ((word & (kept + deleted > 0)).sum(), (word & (kept > 0)).sum())]
        return pa.table([asked.column("block"), asked.column("fold"), asked.column("range"), *[pa.array(x, pa.binary()) for x in told], *[pa.array(x, pa.int64()) for x in once]], names=names)

    names = ["block", "fold", "range", "kept", "deleted", "words", "kept_words"]
    asked = made.select("block", "fold", "sizes", "begins", "payload").mapInArrow(ask, "block long, fold int, range long, keys binary, times binary")
    return asked.groupBy("range").applyInArrow(answer, "block long, fold int, range long, kept binary, deleted binary, words long, kept_words long")


def bucket(context: np.ndarray) -> np.ndarray:
    """How often a context was seen, as the number of binary digits; 0 for never."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def shares(own: list[Grams], counts: list[np.ndarray], tokens: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each distinct n-gram of the full length: the maximum-likelihood estimates of its last word, from no context to the
    whole one, and the buckets of the contexts."""
    place = own[-1].place if len(own) > 1 else None
    words = own[0].at[place] if place is not None else np.arange(len(own[0].keys))
    estimates, buckets = [counts[0][words] / max(1, tokens)], []
    for k in range(1, len(own)):
        seen = counts[k - 1][own[k - 1].at[place - 1]]
        estimates.append(np.where(seen > 0, counts[k][own[k].at[place]] / np.maximum(seen, 1), 0.0))
        buckets.append(bucket(seen))
    return estimates, buckets


def joined(made: DataFrame, told: DataFrame, run: Callable[[dict, list[Grams], np.ndarray, np.ndarray], pa.Table], s: Settings, schema: str) -> DataFrame:
    """run(block, n-grams, kept counts, deleted counts) of every block with its answers."""

    def meet(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        own, order = block_grams(row, s.order)
        answers = answers.sort_by("range")
        both = []
        for c in ("kept", "deleted"):
            x = np.empty(len(order), np.int64)
            x[order] = np.concatenate([widened(v.as_py()) for v in answers.column(c)]).astype(np.int64)
            both.append(np.split(x, np.cumsum([len(g.keys) for g in own])[:-1]))
        return run(row, own, *both)

    return made.groupBy("block").cogroup(told.select("block", "range", "kept", "deleted").groupBy("block")).applyInArrow(meet, schema)


@dataclass(frozen=True)
class Weights:
    """first: of the share of a word without context; rest[k][bucket]: of the share behind k + 1 words."""

    first: float = 0.5
    rest: tuple[tuple[float, ...], ...] = ()

    def of(self, estimates: list[np.ndarray], buckets: list[np.ndarray], words: int) -> np.ndarray:
        """Probabilities."""
        p = self.first * estimates[0] + (1 - self.first) / (words + 1)
        for e, b, w in zip(estimates[1:], buckets, self.rest, strict=True):
            x = np.array(w)[b]
            p = x * e + (1 - x) * p
        return p


BUCKETS = 65


def evidence(made: DataFrame, told: DataFrame, t: Totals, s: Settings) -> DataFrame:
    """(n, p0, p1, ..., b1, ...): the deleted part's n-grams, how often each stands there, and their estimates from the kept part."""

    def run(row: dict, own: list[Grams], kept: list[np.ndarray], deleted: list[np.ndarray]) -> pa.Table:
        estimates, buckets = shares(own, kept, t.kept_tokens)
        real = own[-1].times > 0
        columns = [own[-1].times.astype(np.float64), *estimates, *buckets]
        return pa.table([pa.array(x[real]) for x in columns], names=names)

    names = ["n", *[f"p{k}" for k in range(s.order)], *[f"b{k}" for k in range(1, s.order)]]
    schema = ", ".join(f"{n} {'long' if n[0] == 'b' else 'double'}" for n in names)
    return joined(made.where(F.col("fold") == DELETED), told.where(F.col("fold") == DELETED), run, s, schema)


def learned(found: DataFrame, t: Totals, s: Settings) -> Weights:
    """Weights by expectation-maximisation; each round is one aggregate, of at most one row for each combination of buckets.
    A bucket without evidence has the weight of the next lower one that has some, else of the next higher one."""
    w = Weights(0.5, tuple((0.0, *[0.5] * (BUCKETS - 1)) for _ in range(s.order - 1)))
    keys, last = [f"b{k}" for k in range(1, s.order)], None
    for _ in range(s.rounds):
        p, parts = F.lit(w.first) * F.col("p0") + F.lit((1 - w.first) / (t.kept_words + 1)), []
        parts.append((F.lit(w.first) * F.col("p0"), p))
        for k in range(1, s.order):
            x = F.element_at(F.array(*map(F.lit, w.rest[k - 1])), (F.col(f"b{k}") + 1).cast("int"))
            parts.append((x * F.col(f"p{k}"), x * F.col(f"p{k}") + (1 - x) * parts[-1][1]))
        # From the whole context down: what of a count its estimate takes, and what is left for the shorter ones.
        left, sums = F.col("n"), [F.sum(F.col("n") * F.log(parts[-1][1])).alias("likely")]
        for k in reversed(range(s.order)):
            taken = left * parts[k][0] / parts[k][1]
            sums += [F.sum(left).alias(f"l{k}"), F.sum(taken).alias(f"t{k}")]
            left = left - taken
        rows = found.groupBy(*keys).agg(*sums).collect()
        likely = sum(r.likely or 0.0 for r in rows)
        total = sum(r.l0 or 0.0 for r in rows)
        if not rows or not total:
            return w
        rest = []
        for k in range(1, s.order):
            made: list[float | None] = [None] * BUCKETS
            for b in {r[f"b{k}"] for r in rows} - {0}:
                mine = [r for r in rows if r[f"b{k}"] == b]
                if sum(r[f"l{k}"] for r in mine) > 0:
                    made[b] = sum(r[f"t{k}"] for r in mine) / sum(r[f"l{k}"] for r in mine)
            rest.append(filled(made))
        w = Weights(sum(r.t0 for r in rows) / total, tuple(rest))
        if last is not None and likely - last <= s.tolerance * abs(likely):
            break
        last = likely
    return w


def filled(made: list[float | None]) -> tuple[float, ...]:
    near = next((x for x in made if x is not None), 0.5)
    out = [0.0]
    for x in made[1:]:
        near = near if x is None else x
        out.append(near)
    return tuple(out)


def score(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text)."""
    s = settings or Settings()
    made = materialize(blocks(docs, s), "score-blocks")
    sizes = {r.fold: r.n for r in made.groupBy("fold").agg(F.sum("n_tokens").alias("n")).collect()}
    told = materialize(counted(made, s, max(1, sum(sizes.values()) * s.order // s.range_grams)), "score-counts")
    sums = told.agg(F.sum("words").alias("a"), F.sum("kept_words").alias("b")).first()
    kept, deleted = sizes.get(KEPT, 0), sizes.get(DELETED, 0)
    t = Totals(kept + deleted, sums.a or 0, kept, sums.b or 0)
    weights = learned(materialize(evidence(made, told, t, s), "score-evidence"), t, s)

    def run(row: dict, own: list[Grams], kept: list[np.ndarray], deleted: list[np.ndarray]) -> pa.Table:
        counts = [a + b for a, b in zip(kept, deleted, strict=True)]
        lead, sizes = s.order - 1, np.array(row["sizes"], np.int64)
        ends = np.cumsum(sizes + lead)
        real = np.concatenate([np.arange(e - n, e) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
        first = np.cumsum(sizes) - sizes
        word = counts[0]
        base = np.log10((word + 0.1) / (t.tokens + 0.1 * (t.words + 1)))
        whole = np.log10(weights.of(*shares(own, counts, t.tokens), t.words))
        at = own[0].at[real]
        columns = [np.add.reduceat(x, first) for x in ((word > 0).astype(np.int64)[at], base[at], whole[own[-1].at[real]])]
        n = len(sizes)
        return pa.table([pa.array(row["rows"], pa.int64()), pa.array(row["doc_ids"], ids), pa.array([row["fold"] == HELD_OUT] * n), pa.array(sizes), *map(pa.array, columns)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = made.schema["doc_ids"].dataType.elementType
    ids = to_arrow_type(kind)
    pieces = joined(made, told, run, s, f"row long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = pieces.groupBy("row", "held_out").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(t.tokens).cast("long").alias("train_tokens"), "base_score", "score")
