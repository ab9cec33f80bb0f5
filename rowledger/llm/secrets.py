"""Secret scans: fixed patterns, and a character convolutional network over every further candidate and its context.

Contract: one row per input row with doc_id, findings (kind, start, end in code points, end exclusive, and a score) and
the digest columns of them. Null and empty texts have none; repeated rows count each; extra columns are ignored by
`scan` and kept by `redact`; an empty table gives an empty result, and a corpus without labelled findings trains no
network, so that only the patterns find. Whole texts are scanned.

Method. The base patterns' matches stay as they are and are the labelled findings. Candidates are runs of 16 or more
characters of the alphabet in which secrets are written, with a digit and a letter among them. On a bounded sample of
documents, with all windows of their candidates, a network in numpy (one-hot characters, one convolution, maximum over positions, one logistic unit) learns
labelled findings against all other candidates, in half of the cases with the words around them blanked, so that it
looks at the token as well as its context. Platt scaling on rows kept apart calibrates it, and the threshold is the
highest one, to a ten-thousandth of the log odds' range, that recalls `recall` of the base findings of all documents.
Long candidates are scored in windows, whose maximum counts. A candidate that reaches beyond the base findings it
overlaps is a finding of its own if it passes, so that no part of a long token stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import plus

# Fixed patterns: the base kinds and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' @"
OTHER, SPACE = len(ALPHABET), ALPHABET.index(" ")
CODES = np.full(128, OTHER, np.int64)
for _i, _c in enumerate(ALPHABET):
    CODES[ord(_c)] = _i
BODY, AROUND, KERNEL, FILTERS = 48, 16, 5, 16
WIDTH = BODY + 2 * AROUND
#: Windows that the network takes at once.
WINDOWS = 512

Span = tuple[int, int, str]


@dataclass(frozen=True)
class Settings:
    #: Bounds of the sample that is fitted: documents, and windows of their candidates.
    sample_docs: int = 20_000
    sample_candidates: int = 12_000
    recall: float = 0.98
    steps: int = 400


@dataclass(frozen=True)
class Model:
    parts: tuple[np.ndarray, ...] = ()
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0
    settings: Settings = field(default_factory=Settings)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of the secrets' alphabet with a digit and a letter, without the marks at their ends."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        token = run.strip("+/_.=-")
        if len(token) >= 16 and re.search(r"\d", token, re.ASCII) and re.search(r"[A-Za-z]", token):
            a = m.start() + run.index(token)
            out.append((a, a + len(token)))
    return out


def encode(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """Windows (n, WIDTH) of codes: BODY characters of the candidate, AROUND ones before and after, spaces beyond the text;
    blocks of at most WINDOWS, so that a candidate of millions of characters takes no more memory than a short one."""
    step = BODY // 2
    many = max(1, -(-(end - start - step) // step))
    for first in range(0, many, WINDOWS):
        n = min(WINDOWS, many - first)
        a, b = start + first * step - AROUND, min(end + AROUND, start + (first + n - 1) * step + BODY + AROUND)
        raw = np.frombuffer(text[max(0, a) : b].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.full((n - 1) * step + WIDTH, SPACE, np.int64)
        at = max(0, -a)
        codes[at : at + len(raw)] = np.where(raw < 128, CODES[np.minimum(raw, 127)], OTHER)
        yield np.lib.stride_tricks.sliding_window_view(codes, WIDTH)[::step]


def forward(x: np.ndarray, parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Logits, and what the backward pass needs. The first layer on one-hot input is a sum of looked-up rows."""
    kernel, bias, out, constant = parts
    n = x.shape[1] - KERNEL + 1
    z = bias + sum(kernel[k][x[:, k : k + n]] for k in range(KERNEL))
    at = z.argmax(1)
    top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
    return np.maximum(top, 0) @ out + constant[0], top, at


def train(x: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """Adam on the weighted log loss, by hand."""
    rng = np.random.default_rng(7)
    parts = [rng.normal(0, 0.2, (KERNEL, OTHER + 1, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for step in range(1, settings.steps + 1):
        i = np.r_[rng.choice(pos, 64), rng.choice(neg, 64)]
        xb, yb = x[i].copy(), y[i]
        blank = rng.random(len(i)) < 0.5
        xb[blank, :AROUND] = SPACE
        xb[blank, AROUND + BODY :] = SPACE
        logit, top, at = forward(xb, tuple(parts))
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - yb) / len(i)
        grads = [np.zeros_like(parts[0]), None, np.maximum(top, 0).T @ d, np.array([d.sum()])]
        dt = d[:, None] * parts[2] * (top > 0)
        grads[1] = dt.sum(0)
        f = np.arange(FILTERS)
        for k in range(KERNEL):
            np.add.at(grads[0][k], (np.take_along_axis(xb, at + k, 1), f[None, :]), dt)
        for j, g in enumerate(grads):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            parts[j] = parts[j] - 0.02 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return tuple(parts)


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the logits, with smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.c_[logit / 10, np.ones(len(y))]
    w = np.array([10.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - t) + 1e-2 * (w - np.array([10.0, 0.0])))
    return max(0.01, float(w[0]) / 10), float(w[1])


def probability(model: Model, windows: np.ndarray) -> np.ndarray:
    logit = forward(windows, model.parts)[0]
    return 1 / (1 + np.exp(-np.clip(model.scale[0] * logit + model.scale[1], -30, 30)))


def best_probability(model: Model, text: str, start: int, end: int) -> float:
    return max(float(probability(model, w).max()) for w in encode(text, start, end))


def labelled(text: str) -> Iterator[tuple[bytes, int]]:
    """Every window of every candidate, with 1 if its body meets a base finding; findings without a candidate count too."""
    spans = base_spans(text)
    seen = set()
    for a, b in candidates(text):
        hit = [s for s in spans if s[0] < b and a < s[1]]
        seen.update(hit)
        at = a
        for windows in encode(text, a, b):
            for x in windows.astype(np.uint8):
                yield x.tobytes(), int(any(s[0] < min(at + BODY, b) and at < s[1] for s in hit))
                at += BODY // 2
    for s in spans:
        if s not in seen:
            for windows in encode(text, s[0], s[1]):
                yield from ((x.tobytes(), 1) for x in windows.astype(np.uint8))


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Trained on the driver on at most settings.sample_candidates windows of about settings.sample_docs documents."""
    settings = settings or Settings()
    n = docs.count()
    part = 1.0 if n <= settings.sample_docs else settings.sample_docs / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_windows = (w for t in b.column(0) if t.as_py() for w in labelled(t.as_py()))
            while found := list(islice(all_windows, 64 * WINDOWS)):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32())], names=["x", "y"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).select("text")
    found = chosen.mapInArrow(run, "x binary, y int").groupBy("x").agg(F.max("y").alias("y"))
    half = settings.sample_candidates // 2
    rows = [r for y in (0, 1) for r in found.where(F.col("y") == y).orderBy(F.xxhash64("x"), "x").limit(half).collect()]
    if not rows:
        return Model(settings=settings)
    x, y = np.array([np.frombuffer(bytes(r["x"]), np.uint8) for r in rows], np.int64), np.array([r["y"] for r in rows])
    if not 0 < y.sum() < len(y):  # one kind only: there is nothing to tell apart
        return Model(settings=settings)
    apart = np.arange(len(y)) % 4 == 3
    if y[apart].sum() in (0, apart.sum()) or y[~apart].sum() in (0, (~apart).sum()):
        apart[:] = False
    model = Model(train(x[~apart], y[~apart], settings), settings=settings)
    held = apart if apart.any() else ~apart
    logit = forward(x[held], model.parts)[0]
    model = Model(model.parts, platt(logit, y[held]), settings=settings)
    return Model(model.parts, model.scale, recalling(docs, model), settings)


#: Intervals of the log odds from -30 to 30 by which the base findings are counted.
LEVELS = 10_000


def recalling(docs: DataFrame, model: Model) -> float:
    """The highest lower end of an interval of log odds from which on `recall` of all documents' base findings lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.zeros(LEVELS, np.int64)
            for t in b.column(0):
                p = base_probabilities(t.as_py() or "", model)
                if len(p):
                    counts += np.bincount(np.clip((level(p) * LEVELS).astype(np.int64), 0, LEVELS - 1), minlength=LEVELS)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["level", "n"])

    found = docs.select("text").mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()  # at most LEVELS rows
    total, above = sum(r["n"] for r in found), 0
    for r in sorted(found, key=lambda r: -r["level"]):
        above += r["n"]
        if above >= model.settings.recall * total:
            return float(1 / (1 + np.exp(30 - 60 * r["level"] / LEVELS))) * (1 - 1e-9)
    return 2.0


def level(p: np.ndarray) -> np.ndarray:
    """Log odds from -30 to 30 as 0 to 1."""
    with np.errstate(divide="ignore"):
        return (np.clip(np.log(p) - np.log1p(-p), -30, 30) + 30) / 60


def base_probabilities(text: str, model: Model) -> np.ndarray:
    """The network's probability of each base finding: of the candidates that overlap it, or of itself without any."""
    spans = base_spans(text)
    if not spans:
        return np.zeros(0)
    runs = [(a, b) for a, b in candidates(text) if any(s[0] < b and a < s[1] for s in spans)]
    scores = [best_probability(model, text, a, b) for a, b in runs]
    out = []
    for s in spans:
        over = [p for (a, b), p in zip(runs, scores, strict=True) if s[0] < b and a < s[1]]
        out.append(max(over) if over else best_probability(model, text, s[0], s[1]))
    return np.array(out)


def scan_texts(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """Findings of each text: the base spans, and the candidates not covered by them that pass the threshold."""
    found = [[(*s, 1.0) for s in base_spans(t)] for t in texts]
    todo = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t) if not covered(a, b, found[i])] if model.parts else []
    best, held, owners, size = np.zeros(len(todo)), [], [], 0

    def flush() -> None:
        np.maximum.at(best, np.concatenate(owners), probability(model, np.concatenate(held)))
        held.clear()
        owners.clear()

    for k, (i, a, b) in enumerate(todo):
        for windows in encode(texts[i], a, b):
            held.append(windows)
            owners.append(np.full(len(windows), k))
            size += len(windows)
            if size >= WINDOWS:
                flush()
                size = 0
    if held:
        flush()
    for (i, a, b), q in zip(todo, best.tolist(), strict=True):
        if q >= model.threshold:
            found[i].append((a, b, "model", q))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for x in found]


def covered(start: int, end: int, spans: list[tuple]) -> bool:
    """Whether the spans, by start, together hold all of start to end."""
    for a, b, *_ in spans:
        if a <= start < b:
            start = b
    return start >= end


FINDINGS = "array<struct<start:bigint,end:bigint,kind:string,score:double>>"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with a column findings, all other columns kept."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
        for b in batches:
            found = scan_texts([t.as_py() or "" for t in b.column("text")], model)
            column = pa.array([[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, "findings"])

    kept = docs.drop("findings")
    return kept.mapInArrow(run, plus(kept.schema, findings=FINDINGS))


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Digest columns of the findings."""
    base = F.filter("findings", lambda s: s["kind"] != "model")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text"), model).select("doc_id", count("assign"), count("access"), count("hex"), count("model"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every finding in text replaced by the mark; rows without one, and null and repeated ids, stay as they are."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            for i, found in enumerate(scan_texts([t or "" for t in texts], model)):
                if found:
                    texts[i] = replaced(texts[i], found, mark)
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, found: list[tuple[int, int, str, float]], mark: str) -> str:
    out, end = [], 0
    for a, b, _, _ in found:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])
