"""Importance resampling towards a target distribution by hashed n-gram features.

Contract: one row per input row with doc_id, n_features, weight, score and rank. Features of a text are its words and pairs of
consecutive words, repeats counted; weight is the floored mean of their buckets' gains (no feature: 0), score adds Gumbel
noise drawn from the doc_id, and the share of the highest scores among texts of enough words is drawn: rank counts from 1,
ties to smaller doc_id, null where a row is not drawn. Null texts are empty; a null doc_id counts as an empty one in the noise
and comes before all others in ties; repeated rows take part each; extra columns are ignored; an empty table gives an
empty result, and an empty target leaves gains that the corpus alone makes.

Method. Words come from an untrained pre-tokeniser of the tokenizers library: a regular expression splits the
lower-cased text and returns byte offsets. Windows over neighbouring offset pairs are fed to crc32, which goes on from the first
word's sum to the second one's, and the bucket numbers of a row are kept as one packed column, so that texts are
split once. Histograms are counted in each task and added; gains are `buckets` numbers, which go to the tasks. Ranks
come from the histogram of scores, whose number of values is bounded (gains and noise are logarithms), and an order
within one score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowledger.llm.common import materialize

#: A word of a text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    #: Words of a text that may be drawn, and the share drawn of those, in hundredths.
    least_words: int = 20
    percent: int = 25
    seed: int = 7
    #: Gains, weights and noise are whole thousandths.
    scale: int = 1_000


_SPLITTERS: dict[str, object] = {}


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def word_offsets(data: bytes, pattern: str = WORD) -> list[tuple[int, int]]:
    """(first, end) byte of each match of pattern, by the tokenizers library."""
    from tokenizers import PreTokenizedString, Regex, pre_tokenizers

    if pattern not in _SPLITTERS:
        _SPLITTERS[pattern] = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    parts = PreTokenizedString(data.decode("utf-8", "replace"))
    _SPLITTERS[pattern].pre_tokenize(parts)
    return [at for _, at, _ in parts.get_splits(offset_referential="original", offset_type="byte")]


def feature_buckets(text: str | None, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every feature) of one text: words first, then pairs."""
    if not text:
        return 0, np.zeros(0, np.uint32)
    data = lowered(text)
    words = [data[a:b] for a, b in word_offsets(data)]
    if not words:
        return 0, np.zeros(0, np.uint32)
    crc = zlib.crc32
    ones = [crc(w) for w in words]
    twos = [crc(w, crc(b" ", c)) for c, w in zip(ones, words[1:], strict=False)]
    return len(words), np.array(ones + twos, np.uint32) % np.uint32(buckets)


def featured(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n_words, n_features, features): the bucket numbers as packed unsigned integers of two or four bytes."""
    kind = np.dtype("<u2" if s.buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                found = [feature_buckets(t.as_py(), s.buckets) for t in part.column(1)]
                columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.astype(kind).tobytes() for _, x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_words", "n_features", "features"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, features binary")


def unpacked(features: pa.Array, s: Settings) -> Iterator[np.ndarray]:
    kind = "<u2" if s.buckets <= 1 << 16 else "<u4"
    return (np.frombuffer(x.as_buffer() or b"", kind) for x in features)


def histogram(features: DataFrame, s: Settings) -> np.ndarray:
    """How many features each bucket holds; each task sends one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for b in batches:
            for x in unpacked(b.column(0), s):
                total += np.bincount(x, minlength=s.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(s.buckets, np.int64)
    for r in features.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, s: Settings) -> np.ndarray:
    """Floored thousandths of the logarithm of how much more of the target than of the corpus falls into each bucket."""
    a, b = float(corpus.sum() + s.buckets), float(target.sum() + s.buckets)
    return np.array([math.floor(s.scale * math.log((float(t + 1) * a) / (float(c + 1) * b))) for c, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(features: DataFrame, gain: np.ndarray, s: Settings) -> DataFrame:
    """features (with its packed column) with the floored mean of gains in its place."""
    shared = features.sparkSession.sparkContext.broadcast(gain)  # `buckets` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means = [int(shared.value[x].sum()) // len(x) if len(x) else 0 for x in unpacked(b.column(3), s)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(means, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: Column, s: Settings) -> Column:
    """Floored thousandths of a Gumbel number drawn from the id."""
    text = F.concat(F.lit(f"{s.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(s.scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of docs (doc_id, text), drawn to look like target (text)."""
    s = settings or Settings()
    features = materialize(featured(docs, s), "resample-features")
    wanted = featured(target.select(F.lit(0).alias("doc_id"), "text"), s)
    gain = gains(histogram(features, s), histogram(wanted, s), s)
    scored = weighted(features, gain, s).withColumn("score", F.col("weight") + noise(F.col("doc_id"), s))
    scored = materialize(scored, "resample-scores")
    able = F.col("n_words") >= s.least_words
    # A score is the sum of two bounded logarithms, so it has fewer than 200,000 values whatever the number of rows.
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    drawn = scored.where(able).count() * s.percent // 100
    place = F.col("_above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = scored.where(able).join(F.broadcast(counts), "score").withColumn("rank", F.when(place <= drawn, place).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).union(scored.where(~able).select(*columns[:-1], F.lit(None).cast("long").alias("rank")))
