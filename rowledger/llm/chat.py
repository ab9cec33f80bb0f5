"""Chat formatting at the level of tokens.

Contract: `assemble` gives one row per turn, in order of (conv_id, turn, role, text) within partitions that hold whole
conversations: conv_id, turn, ids and loss mask. `read_back` reads the turns from the ids, and `digests` sums up
conversations. A null role or text is empty; equal turns stand in the order of role and text and count each; a null
conv_id is a conversation of its own; extra columns are ignored; an empty table gives an empty result.

Method. A turn is <|im_start|>role\\ntext<|im_end|>\\n. Its segments are encoded one by one, the two marks are reserved
ids beyond the vocabulary that no text encodes to, and the loss mask of the tokens is the prefix sum of +1 where an
assistant's text begins and -1 where it ends. In texts `<`, any backslashes and `|` get one backslash more, so no
control string is left in content, and taking one away gives the text back; in roles line ends are escaped too.
Conversations are streamed in order with running digests: memory does not grow with a conversation's length. The
digest of one conversation is made by one task, as a hash over its turns in order has to be.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.llm.packing import encoder, vocabulary

START, STOP = "<|im_start|>", "<|im_end|>"
#: Reserved ids, beyond the vocabulary.
START_ID, STOP_ID = 50_257, 50_258
_DECODERS: dict[str, object] = {}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def turn_ids(role: str, text: str, encode) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Ids and loss mask of one turn."""
    segments = [[START_ID], encode(escape_role(role)), encode("\n"), encode(escape(text)), [STOP_ID], encode("\n")]
    ends = np.cumsum([len(s) for s in segments])
    change = np.zeros(ends[-1] + 1, np.int8)
    if role == "assistant":
        change[ends[2]] += 1
        change[ends[3]] -= 1
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(change[:-1]).astype(bool)


def decoder(path: str):  # noqa: ANN201
    if path not in _DECODERS:
        _DECODERS[path] = encoder(path).__self__.decode_bytes
    return _DECODERS[path]


def parse_turn(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[str, str, str, int]:  # noqa: ANN001
    """(role, text, text under the mask, characters) of one turn's ids."""
    stop = int(np.flatnonzero(ids == STOP_ID)[0])
    if ids[0] != START_ID:
        raise ValueError("a turn must begin with its mark")
    inner = decode(ids[1:stop].tolist()).decode()
    role, _, text = inner.partition("\n")
    under = decode(ids[mask].tolist()).decode()
    size = len(START) + len(inner) + len(STOP) + len(decode(ids[stop + 1 :].tolist()).decode())
    return unescape_role(role), unescape(text), unescape(under), size


def assemble(turns: DataFrame, path: str | None = None) -> DataFrame:
    path = path or vocabulary()
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            made = [turn_ids(r.as_py(), t.as_py(), encode) for r, t in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.bool_()))], names=["conv_id", "turn", "ids", "loss"])

    return rows.mapInArrow(run, "conv_id long, turn long, ids array<int>, loss array<boolean>")


def digests(assembled: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation of what assemble gave, read back from the ids."""
    path = path or vocabulary()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path)
        now, began, done = None, False, []
        for b in batches:
            for conv, ids, loss in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if not began or conv != now:
                    if began:
                        done.append((now, n, turns.hexdigest(), loss_chars, under.hexdigest(), chars))
                    now, began, n, loss_chars, chars = conv, True, 0, 0, 0
                    turns, under = hashlib.sha256(), hashlib.sha256()
                role, text, masked, size = parse_turn(ids.values.to_numpy(), np.array(loss.values.to_pylist(), bool), decode)
                turns.update(f"{role}\n{text}\n".encode())
                under.update(masked.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + size
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        if began:
            last = [(now, n, turns.hexdigest(), loss_chars, under.hexdigest(), chars)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last, strict=True), kinds, strict=True)], names=names)

    return assembled.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
