"""Crowded keys of near copies, a plain version of the toxicity score, recordings of several rates, very long values and ties."""

import math
import re

import numpy as np
import pytest
import zstandard
from test_findings import brute_jaccard, brute_kept, edited

import corpus_pipeline
from rowledger.llm import audio, mixing, nearcopies, queries, secrets, toxicity, warc
from rowledger.llm.common import table

DIR = "/root/testdata/sf0.001"


def crowd_of(rng, many=60, shared=150, own=80):
    """Pages with one passage in common and their own words behind it, and near copies of every sixth."""
    passage = [f"menu{i}" for i in range(shared)]
    pages = [[*passage, *(f"p{p}w{rng.integers(0, 10_000)}" for _ in range(own + int(rng.integers(0, 40))))] for p in range(many)]
    return [" ".join(p) for p in pages] + [edited(rng, p, 1 + i % 5, f"e{i}x") for i, p in enumerate(pages[::6])]


def test_near_copies_of_a_crowded_key(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CELL_SETS", 4)
    monkeypatch.setattr(nearcopies, "CELL_ROWS", 4)
    rows = list(enumerate(crowd_of(np.random.default_rng(4))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in nearcopies.keep_one(docs).collect())
    assert kept == brute_kept(rows) and 60 <= len(kept) < 70


@pytest.mark.parametrize("cell", [3, 4_096])
def test_prefixes_propose_every_near_pair(spark, monkeypatch, cell):
    """Whatever was joined before: no pair at 0.8 or more is missed but by the SimHash, and none below is linked."""
    monkeypatch.setattr(nearcopies, "CELL_ROWS", cell)
    rng = np.random.default_rng(7)
    texts = crowd_of(rng, 24) + crowd_of(rng, 12, 400, 40) + ["a b c d e f g h", "a b c d e f g h i", "x y"]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = nearcopies.hashes_of(spark.createDataFrame(rows, "_set long, text string")).persist()
    crowd = sets.selectExpr("_set", "_set as root", "print", "hashes")
    pairs = nearcopies.proposed(nearcopies.prefixes(crowd, nearcopies.bucket_counts(crowd)))
    got = {(r.a, r.b) for r in nearcopies.compared(pairs, sets).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if brute_jaccard(texts[i], texts[j]) >= 0.8}
    assert got == want and len(want) >= 6
    assert pairs.count() < len(texts) ** 2 / 8  # pages that share a passage alone are not even proposed
    joined = crowd.withColumn("root", crowd["_set"] * 0)
    assert nearcopies.proposed(nearcopies.prefixes(joined, nearcopies.bucket_counts(joined))).count() == 0


def plain_score(text, model):
    """Windows, compressed lengths and the logistic curve, step by step."""
    s = model.settings
    data, cut = (text or "").lower().encode("utf-8", "replace"), []
    while data:
        at = next((k for k in range(s.window, min(len(data), 2 * s.window)) if data[k] == 32), 2 * s.window)
        cut.append(data[:at])
        data = data[at:]

    def length(window, content):
        how = zstandard.ZstdCompressionParameters.from_level(s.level, source_size=s.window, dict_size=len(content), min_match=s.min_match, write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(window))

    gains = sorted((length(w, model.ordinary) - length(w, model.toxic + model.ordinary) for w in cut), reverse=True)
    best = [max(0, g) for g in [*gains, 0, 0][:2]]
    z = sum(a * b for a, b in zip(model.weights, [1, *best, math.log1p(sum(g > 1 for g in gains))], strict=True))
    return 1 / (1 + math.exp(-z))


def test_toxicity_against_a_plain_version(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    asked = [*sorted(i for i in texts if i is not None)[:40]]
    got = {r.doc_id: r for r in queries.QUERIES["op4_toxicity"](spark, DIR).collect()}
    assert len(got) == len(texts)
    for i in asked:
        want = plain_score(texts[i], model)
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(want >= 0.3)


def test_logistic_is_at_its_minimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0).astype(float)
    w = toxicity.logistic(x, y)

    def loss(w):
        z = np.c_[np.ones(300), x] @ w
        return np.mean(np.logaddexp(0, z) - y * z) + 1e-3 / 2 * w @ w

    assert all(loss(w) <= loss(w + d) for d in 1e-3 * np.r_[np.eye(4), -np.eye(4)])


def tune(rate, seconds=12, seed=3):
    notes = np.random.default_rng(seed).integers(0, 12, math.ceil(seconds * 4))
    t = np.arange(int(seconds * rate)) / rate
    return 8_000 * np.sin(2 * np.pi * 261.6256 * 2 ** (notes[(t * 4).astype(int)] / 12) * t)


def stereo(samples, rate):
    """A two-channel file: the tune in both, and something else of opposite sign."""
    other = 2_000 * np.sin(np.arange(len(samples)) / 3)
    mono = audio.wav(np.stack([samples + other, samples - other], 1).reshape(-1), rate)
    return mono[:22] + (2).to_bytes(2, "little") + mono[24:28] + (4 * rate).to_bytes(4, "little") + (4).to_bytes(2, "little") + mono[34:]


def test_one_tune_at_several_rates(spark):
    rows = [(100, audio.wav(tune(44_100), 44_100), 1), (1, audio.wav(tune(22_050), 22_050), 1), (2, audio.wav(tune(8_000), 8_000), 1), (3, stereo(tune(44_100), 44_100), 1)]
    rows += [(4, audio.wav(tune(16_000, seed=9), 16_000), 1), (5, audio.wav(tune(2_000), 2_000)[:22] + b"\0\0" + b"\0" * 50, 1)]
    recordings = spark.createDataFrame(rows, "vec_id long, audio binary, key int")
    got = {r.vec_id: r for r in audio.align(recordings).collect()}
    for i in (1, 2, 3):
        same = got[i].class_id == 100
        assert same or (got[i].best_query, got[i].best_offset) == (100, 0) and got[i].best_errors < 0.05, got[i]
    assert got[4].n_links == 0 and got[5].class_id is None


def test_a_long_recording(spark, monkeypatch):
    """Half an hour, in blocks of few integers: it is found at its place by a piece of ten seconds."""
    monkeypatch.setattr(audio, "BLOCK_INTS", 64)
    long = tune(2_000, 1_800, 5)
    rows = [(100, audio.wav(long, 2_000)), (7, audio.wav(long[128 * 4_000 : 128 * 4_160], 2_000)), (200, audio.wav(tune(2_000, 10, 6), 2_000))]
    got = {r.vec_id: r for r in audio.align(spark.createDataFrame(rows, "vec_id long, audio binary")).collect()}
    assert (got[7].best_query, got[7].best_offset, got[7].best_errors) == (100, -4_000, 0.0) and got[200].n_links == 0


def test_secrets_learn_from_all_windows():
    """A candidate's later windows count, each by what it holds."""
    text = "x " + "Z9" * 60 + " password=" + "aB3" * 20 + " y"
    found = list(secrets.labelled(text))
    assert len(found) == sum(len(w) for a, b in secrets.candidates(text) for w in secrets.encode(text, a, b))
    assert [y for _, y in found].count(0) == 4 and [y for _, y in found].count(1) >= 1
    mixed = "Q-" * 40 + "0123456789abcdef01234567"
    assert [y for _, y in secrets.labelled(mixed)][0] == 0 and [y for _, y in secrets.labelled(mixed)][-1] == 1


def test_very_long_html(spark):
    """A page many times an archive's size is one record, and comes back whole."""
    rng = np.random.default_rng(1)
    html = "<p>" + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz é"), 300_000)) * 60 + "</p>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", html), (3, "http://c/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(pages).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == len(html.encode()) and got[2].refers_to == 1 and got[3].payload_bytes == 0


def test_long_texts_in_stages(spark):
    """Toxicity, mixing and packing of a text of a million characters among short, null and empty ones."""
    long = " ".join(f"word{i % 977}" for i in range(130_000))
    rows = [(0, "s", long), (1, "s", "some words here"), (2, None, "more words"), (3, "t", ""), (4, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clean = corpus_pipeline.drop_toxic(spark, docs, DIR)
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 3, 4]
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert taken[3] == taken[4] == 0 and taken[0] > 100_000 and all(taken[i] <= 3 * len(re.findall(r"\S+", t or "")) for i, _, t in rows)
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, DIR).collect()} <= {0, 1, 2}
    pieces = corpus_pipeline.pack_sequences(spark, docs, DIR).collect()
    for i in range(5):
        mine = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert mine[0][0] == 0 and sum(n for _, n, _ in mine) == mine[0][2] and all(a + n == b for (a, n, _), (b, _, _) in zip(mine, mine[1:], strict=False))


def test_mixing_of_ties(spark):
    """Documents alike in all and sources alike in size: every word is taken once or more, and reruns agree."""
    rows = [(i % 3, f"s{i % 6}", "one two three") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    runs = [sorted((r.source, r.doc_id, r.taken) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and sum(t for *_, t in runs[0]) == 180 and len(runs[0]) == 60
