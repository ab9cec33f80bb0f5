"""Toxicity by compression distance: windows of a text against zstandard dictionaries of ordinary and toxic text.

Contract: one row per input row with doc_id, held_out, score (0 to 1) and predicted (1 from `cut` on). Scores depend on
the text alone. Null and empty texts have no window, so no gain, and get the score of that; repeated rows count each;
extra columns are ignored; an empty table gives an empty result; without labels of both kinds every score is 0.

Method. A bounded sample of labelled rows outside the held-out fold is fitted on the driver. zstandard trains two
dictionaries: the ordinary one on windows of ordinary text, the toxic one on passages of toxic text that recur there in
many different contexts and far more often than in ordinary text (contexts, not counts, so that copies weigh once).
Every window of about `window` bytes, cut at spaces, is compressed with the ordinary dictionary and with the toxic one in
front of it; what the second saves is the window's gain. A logistic curve calibrates the two largest gains and the number
of gaining windows of a document into a probability; it is fitted on the gains of texts that the dictionaries did not
see, by `folds` turns. Whole texts are scored, in memory bounded by one batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.llm.common import absent, is_held_out, plus

GRAM, CONTEXT = 5, 6


@dataclass(frozen=True)
class Settings:
    #: The sample's bound: rows of each label.
    sample_rows: int = 2_500
    #: And bytes of each label.
    sample_bytes: int = 6_000_000
    #: Ordinary windows that zstandard trains on, of that sample.
    sample_windows: int = 60_000
    window: int = 48
    level: int = 9
    min_match: int = 6
    ordinary_bytes: int = 32_768
    toxic_bytes: int = 8_192
    piece: int = 48
    folds: int = 3
    #: A gram is toxic if its contexts are so many times as frequent as in ordinary text, in this share of toxic texts.
    ratio: float = 10.0
    share: float = 0.01
    cut: float = 0.3


@dataclass(frozen=True)
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    settings: Settings = field(default_factory=Settings)


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def windows(b: bytes, size: int) -> list[bytes]:
    """Consecutive windows, each up to the first space after `size` bytes, and twice that at most."""
    out, i, n = [], 0, len(b)
    while i < n:
        j = i + size
        if j < n:
            k = b.find(b" ", j, j + size)
            j = k if k >= 0 else j + size
        out.append(b[i:j])
        i = j
    return out


def gram_contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams (no white space but in front) as integers, and in how many distinct contexts each one stands."""
    a = np.frombuffer((b"\n" * CONTEXT).join([b"", *texts, b""]), np.uint8).astype(np.uint64)
    n = len(a) - GRAM - 2 * CONTEXT + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, around, inside = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(CONTEXT, CONTEXT + GRAM):
        code = code << np.uint64(8) | a[i : i + n]
        if i > CONTEXT:
            inside &= (a[i : i + n] != 32) & (a[i : i + n] != 10)
    for i in [*range(CONTEXT), *range(CONTEXT + GRAM, 2 * CONTEXT + GRAM)]:
        around = around * np.uint64(1099511628211) ^ a[i : i + n]
    code, around = code[inside], around[inside]
    _, first = np.unique(code * np.uint64(0x9E3779B97F4A7C15) ^ around, return_index=True)
    return np.unique(code[first], return_counts=True)


def toxic_passages(toxic: list[bytes], ordinary: list[bytes], s: Settings) -> list[bytes]:
    """The passages of toxic texts, as often as they occur."""
    grams, n = gram_contexts(toxic)
    other, m = gram_contexts(ordinary)
    at = np.minimum(np.searchsorted(other, grams), max(0, len(other) - 1))
    known = np.where(other[at] == grams, m[at], 0) if len(other) else np.zeros(len(grams))
    per_toxic, per_ordinary = max(1, sum(map(len, toxic))), max(1, sum(map(len, ordinary)))
    chosen = {int(g).to_bytes(GRAM, "big") for g in grams[(n >= max(4, s.share * len(toxic))) & (n / per_toxic >= s.ratio * (known + 1) / per_ordinary)]}
    out = []
    for t in toxic:
        i, end = 0, len(t) - GRAM
        while i <= end:
            if t[i : i + GRAM] not in chosen:
                i += 1
                continue
            j = i
            while j < end and t[j + 1 : j + 1 + GRAM] in chosen:
                j += 1
            out.append(t[i : j + GRAM])
            i = j + GRAM
    return out


def trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary that zstandard trains on the samples; whole samples up to the size where they are too few for that."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        out, room = [], size
        for x in samples:
            if len(x) < room:
                out.append(x)
                room -= len(x) + 1
        return b"\n".join(out)


def dictionaries(toxic: list[bytes], ordinary: list[bytes], s: Settings) -> tuple[bytes, bytes]:
    """(ordinary, toxic), both trained by zstandard."""
    plain = islice((w for t in ordinary for w in windows(t, s.window)), s.sample_windows)
    # zstandard cuts its dictionary from pieces of k bytes: a sample repeats one passage, so that no piece is half of one.
    lines = [(p + b"\n") * (1 + 2 * s.piece // (len(p) + 1)) for p in toxic_passages(toxic, ordinary, s)]
    return trained(list(plain), s.ordinary_bytes), trained(lines, s.toxic_bytes, k=s.piece, d=6, f=18, accel=1)


class Scorer:
    """Compressors are not picklable: made once in each task."""

    def __init__(self, model: Model) -> None:
        self.model, s = model, model.settings
        self.pair = [self._compressor(model.ordinary, s), self._compressor(model.toxic + model.ordinary, s)]

    @staticmethod
    def _compressor(content: bytes, s: Settings) -> zstandard.ZstdCompressor:
        p = zstandard.ZstdCompressionParameters.from_level(s.level, source_size=s.window, dict_size=len(content), min_match=s.min_match, write_content_size=0, write_checksum=0, write_dict_id=0)
        if len(content) < 8:
            return zstandard.ZstdCompressor(compression_params=p)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def features(self, text: str | None) -> tuple[float, float, float]:
        plain, toxic = self.pair[0].compress, self.pair[1].compress
        first = second = many = 0
        for w in windows(folded(text), self.model.settings.window):
            g = len(plain(w)) - len(toxic(w))
            if g > 0:
                if g > first:
                    first, second = g, first
                elif g > second:
                    second = g
                many += g > 1
        return first, second, float(np.log1p(many))

    def score(self, text: str | None) -> float:
        if not self.model.weights:
            return 0.0
        z = self.model.weights[0] + float(np.dot(self.model.weights[1:], self.features(text)))
        return float(1 / (1 + np.exp(-min(35.0, max(-35.0, z)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, with a constant in front."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[list[bytes], list[bytes], float]:
    """(toxic, ordinary) texts, about s.sample_rows of each at most, chosen by a hash of the id, so that the bound holds
    at any input size; and by how much the log odds of toxic text are larger in the sample than among all labels."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return [], [], 0.0
    part = F.when(F.col("toxic") == 1, min(1.0, s.sample_rows / counts[1])).otherwise(min(1.0, s.sample_rows / counts[0]))
    most = 2 * s.sample_rows + 1_000
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).limit(most)
    known_docs = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(chosen), "doc_id")  # broadcast: `most` rows of two numbers
    # The byte bound holds before any text leaves Spark: lengths of `most` rows are summed in order, and the text that
    # crosses the bound is cut there.
    rows = known_docs.select("doc_id", "toxic", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most).groupBy("doc_id", "toxic", "h", "n").agg(F.count("*").alias("times"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    rows = rows.withColumn("room", F.lit(s.sample_bytes) - F.sum(F.col("n") * F.col("times")).over(order) + F.col("n") * F.col("times"))
    rows = rows.where("room > 0").select("doc_id", "h", "times", "room", F.least("times", F.ceil(F.col("room") / F.col("n"))).alias("copies"))
    texts = known_docs.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).join(F.broadcast(rows), ["doc_id", "h"])
    texts = texts.select("doc_id", "h", "toxic", "copies", "room", F.expr("substring(text, 1, cast(room as int))").alias("text"))
    out: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(texts.collect(), key=lambda r: (r["h"], str(r["doc_id"]))):
        t, room = folded(r["text"]), r["room"]
        for _ in range(r["copies"]):
            if part := t[: max(0, room)]:
                out[r["toxic"]].append(part)
            room -= len(t)
    return out[1], out[0], float(np.log(max(1, len(out[1])) / counts[1]) - np.log(max(1, len(out[0])) / counts[0]))


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Model:
    s = s or Settings()
    toxic, ordinary, shift = sample(docs, labels, s)
    if not toxic or not ordinary:
        return Model(settings=s)
    scorer = Scorer(Model(*dictionaries(toxic, ordinary, s), (0.0,) * 4, s))
    x, y = [], []
    for fold in range(s.folds):
        # Texts of the fold against dictionaries of the others; too few texts are scored by the dictionaries they are in.
        apart = lambda texts: [t for i, t in enumerate(texts) if i % s.folds != fold]  # noqa: B023, E731
        unseen = len(toxic) >= 2 * s.folds and len(ordinary) >= 2 * s.folds
        other = Scorer(Model(*dictionaries(apart(toxic), apart(ordinary), s), (0.0,) * 4, s)) if unseen else scorer
        for label, texts in ((1, toxic), (0, ordinary)):
            x += [other.features(t.decode("utf-8", "replace")) for t in texts[fold :: s.folds]]
            y += [label] * len(texts[fold :: s.folds])
    w = logistic(np.array(x), np.array(y, float))
    w[0] -= shift
    return Model(scorer.model.ordinary, scorer.model.toxic, tuple(w.tolist()), s)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with the column `out`, all other columns kept."""
    kept = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, out])

    return kept.mapInArrow(run, plus(kept.schema, **{out: "double"}))


def classify(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    s = s or Settings()
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, s))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= s.cut).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of docs below the cut, with their columns, of whatever names; null and repeated ids count as any row."""
    s = s or Settings()
    (name,) = absent(docs.columns, "_toxicity")
    return score(docs, fit(docs, labels, s), name).where(F.col(name) < s.cut).select(docs.columns)
