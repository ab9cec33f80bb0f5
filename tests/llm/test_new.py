"""Language-model scores, tokenizer alignment and importance resampling against plain Python, on whole and awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowledger.llm import alignment, packing, queries, resampling, scoring
from rowledger.llm.common import table

DIR = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\r\n"), (4, "A a  A\x0bb É é Ü"), (4, "A a  A\x0bb É é Ü"), (None, "no id here"), (None, None), (5, "<|endoftext|> x </s> <s>"), (6, "▁ x"), (7, "a" * 5_000), (8, "one two " * 3_000), (9, "\U0001f600 \x00 ﬁ ½ ​")]
SCHEMA = "doc_id long, text string"


def folds(i, n):
    return -1 if i is None else zlib.crc32(str(i).encode()) % n


def tokens_of(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())] + [None]


def naive_counts(rows, order):
    """counts[k][gram of k words], contexts at the start of a text included."""
    counts = [Counter() for _ in range(order + 1)]
    for text in rows:
        t = ["start"] * (order - 1) + tokens_of(text)
        for i in range(order - 1, len(t)):
            for k in range(1, order + 1):
                counts[k][tuple(t[i - k + 1 : i + 1])] += 1
        for k in range(1, order):
            counts[k][("start",) * k] += 1
    return counts


def naive_shares(counts, gram, total):
    """[(estimate, bucket)] from no context to the whole one."""
    out = [(counts[1][gram[-1:]] / max(1, total), None)]
    for k in range(2, len(gram) + 1):
        seen = counts[k - 1][gram[-k:-1]]
        out.append((counts[k][gram[-k:]] / seen if seen else 0.0, seen.bit_length()))
    return out


def naive_scores(rows, s):
    held, deleted = [[r for r in rows if folds(r[0], s.folds) == f] for f in (0, s.deleted)]
    train = [r for r in rows if folds(r[0], s.folds) != 0]
    kept = naive_counts([t for i, t in train if folds(i, s.folds) != s.deleted], s.order)
    every = naive_counts([t for _, t in train], s.order)
    words = lambda c: {g for g in c[1] if g != ("start",) and c[1][g] > 0}
    total = lambda c: sum(c[1][g] for g in words(c))

    def mix(parts, first, rest, n):
        levels = [(first * parts[0][0], first * parts[0][0] + (1 - first) / (n + 1))]
        for (e, b), w in zip(parts[1:], rest, strict=True):
            levels.append((w[b] * e, w[b] * e + (1 - w[b]) * levels[-1][1]))
        return levels

    found = Counter()
    for _, text in deleted:
        t = ["start"] * (s.order - 1) + tokens_of(text)
        found.update(tuple(t[i - s.order + 1 : i + 1]) for i in range(s.order - 1, len(t)))
    first, rest, last = 0.5, [[0.0] + [0.5] * 64 for _ in range(s.order - 1)], None
    kept_total, kept_words = total(kept), len(words(kept))
    for _ in range(s.rounds if found else 0):
        sums, likely = defaultdict(float), 0.0
        for gram, n in found.items():
            parts = naive_shares(kept, gram, kept_total)
            levels, left = mix(parts, first, rest, kept_words), float(n)
            likely += n * math.log(levels[-1][1])
            for k in reversed(range(s.order)):
                taken = left * levels[k][0] / levels[k][1]
                sums["l", k, parts[k][1]] += left
                sums["t", k, parts[k][1]] += taken
                left -= taken
        first = sums["t", 0, None] / sums["l", 0, None]
        rest = [list(scoring.filled([None if b == 0 or not sums["l", k, b] else sums["t", k, b] / sums["l", k, b] for b in range(65)])) for k in range(1, s.order)]
        if last is not None and likely - last <= s.tolerance * abs(likely):
            break
        last = likely
    out = []
    n, v = total(every), len(words(every))
    for i, text in rows:
        t = ["start"] * (s.order - 1) + tokens_of(text)
        grams = [tuple(t[j - s.order + 1 : j + 1]) for j in range(s.order - 1, len(t))]
        c = [every[1][g[-1:]] for g in grams]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        score = sum(math.log10(mix(naive_shares(every, g, n), first, rest, v)[-1][1]) for g in grams)
        out.append((i, folds(i, s.folds) == 0, len(c), sum(x > 0 for x in c), n, base, score))
    return out, len(held)


def matches(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:5], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-8)


@pytest.mark.parametrize("order,block", [(1, 1 << 20), (2, 700), (3, 5_000)])
def test_scores_against_plain_counts(spark, order, block):
    """Whole table and awkward rows; small blocks cut texts into pieces, small ranges make many of them."""
    rows = [(r.doc_id, r.text) for r in table(spark, DIR, "documents").limit(40).collect()] + ODD
    s = scoring.Settings(order=order, block_tokens=block, range_grams=3_000)
    want, _ = naive_scores(rows, s)
    matches(scoring.score(spark.createDataFrame(rows, SCHEMA).repartition(3), s).collect(), want)


def test_scoring_query_beats_the_base_on_held_out_texts(spark):
    rows = queries.op11_scoring(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (folds(r.doc_id, 10) == 0) for r in rows)
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    """Over all known words and one unknown, behind a seen and an unseen context."""
    s = scoring.Settings(order=2)
    texts, words = ["a b a c", "b b a", "c"], ["a", "b", "c", None, "zz"]
    c = naive_counts(texts, 2)
    w = scoring.Weights(0.8, ((0.0, *[0.6] * 64),))
    for context in (b"a", b"zz", "start"):
        p = 0.0
        for x in words:
            parts = naive_shares(c, (context, x.encode() if x else None), 11)
            p += w.of([np.array([e]) for e, _ in parts], [np.array([parts[1][1]])], 4)[0]
        assert p == pytest.approx(1) and s.order == 2


@pytest.mark.parametrize("rows", [[], [(20, "x")], [(None, None)]])
def test_scores_of_hardly_any_rows(spark, rows):
    got = scoring.score(spark.createDataFrame(rows, SCHEMA)).collect()
    matches(got, naive_scores(rows, scoring.Settings())[0])


def test_words_and_words_across_steps(monkeypatch):
    monkeypatch.setattr(scoring, "STEP", 7)
    for text in ("", " ", "one two  three fourteenletters \x0bx ", "abcdefgh", "É" * 20):
        assert sum(scoring.word_lists(text), []) == [*text.encode().lower().split(), b" end"]


def naive_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    spell_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x..>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode()
    made, counts = [], Counter()
    for i, text in rows:
        groups, links, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if not b"".join(map(spell_a, ids_a)) == b"".join(map(spell_b, ids_b)) == (" " + text).encode():
                ids_a, ids_b = [], []
        x, y, at_a, at_b, own_a, own_b = 0, 0, 0, 0, [], []
        while x < len(ids_a):
            own_a.append(ids_a[x])
            at_a += len(spell_a(ids_a[x]))
            x += 1
            while at_b < at_a:
                own_b.append(ids_b[y])
                at_b += len(spell_b(ids_b[y]))
                y += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
                links.append((own_a[-1], own_b[-1]))
                own_a, own_b = [], []
        counts.update(links)
        made.append((i, len(ids_a), len(ids_b), ";".join(groups), links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    docs = Counter(p for *_, links in made for p in set(links))
    return [(i, na, nb, len(k), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(g.encode()).hexdigest() if na else "") for i, na, nb, g, k in made], counts, docs


def test_alignment_against_both_libraries(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DIR, "documents").collect()] + ODD
    want, counts, docs = naive_alignment(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in alignment.correspond(frame.withColumn("pairs", F.lit(1))).collect()), key=key) == sorted(want, key=key)
    pairs = alignment.pair_counts(alignment.index(frame, *alignment.vocabularies())).collect()
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in pairs} == {p: (docs[p], n) for p, n in counts.items()}
    assert len(pairs) < alignment.most_pairs(alignment.pair_of(*alignment.vocabularies()))
    assert [w[1] > 0 for w in want[-len(ODD) :]] == [False, False, True, True, True, True, False, True, False, True, True, want[-1][1] > 0]


def test_alignment_query_is_whole(spark):
    got = queries.op12_alignment(spark, DIR).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, DIR, "documents").collect()]
    assert sorted(map(tuple, got)) == sorted(naive_alignment(rows)[0])


def test_planes_hold_multiplicities():
    rng = np.random.default_rng(5)
    pair, row, times = rng.integers(0, 40, 900) << 32, rng.integers(0, 130, 900), rng.integers(1, 1 << 34, 900)
    unique = {(int(p), int(r)): int(t) for p, r, t in zip(pair, row, times, strict=True)}
    p, r, t = (np.array(x) for x in zip(*[(*k, v) for k, v in unique.items()], strict=True))
    pairs, planes = alignment.opened(*alignment.packed(*alignment.planes_of(p, r, t, 130)), 130)
    documents, links = alignment.counted(pairs, planes)
    assert {int(k): (int(d), int(n)) for k, d, n in zip(pairs, documents, links, strict=True)} == {int(k): (int((p == k).sum()), int(t[p == k].sum())) for k in set(p)}
    score = rng.integers(1, 1 << 27, len(pairs))
    assert alignment.returned(planes, score, 130).tolist() == [sum(int(score[np.searchsorted(pairs, k)]) * v for (k, i), v in unique.items() if i == x) for x in range(130)]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_alignment_without_tokens(spark, rows):
    assert sorted(tuple(r) for r in alignment.correspond(spark.createDataFrame(rows, SCHEMA)).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def naive_resampling(rows, target):
    def features(text):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return len(w), [zlib.crc32(x) % 10_000 for x in [*w, *[a + b" " + b for a, b in zip(w, w[1:], strict=False)]]]

    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in range(10_000)]
    out, able = [], []
    for i, text in rows:
        n, f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r) for r in out]


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:4], r[4] or 0))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_resampling_query(spark, size):
    d = f"/root/testdata/{size}"
    rows = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    assert by_id(queries.op13_resampling(spark, d).collect()) == by_id(naive_resampling(rows, [r.text for r in table(spark, d, "benchmark").collect()]))


def test_resampling_of_awkward_rows(spark):
    rows = ODD + [(i, "Wort ein zwei " * (5 + i % 7)) for i in range(20, 60)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))
    target = spark.createDataFrame([("Wort EIN",), (None,), ("",)], "text string")
    assert by_id(resampling.resample(docs, target).collect()) == by_id(naive_resampling(rows, ["Wort EIN"]))
    assert by_id(resampling.resample(docs, target.limit(0)).collect()) == by_id(naive_resampling(rows, []))
    assert resampling.resample(docs.limit(0), target).collect() == []


def test_encoder_is_the_librarys(spark):
    """Bytes of A's ids as its file spells them."""
    p = alignment.pair_of(*alignment.vocabularies())
    assert p.bytes_a[:3] == [b"!", b'"', b"#"] and p.bytes_a[220] == b" " and packing.encoder(packing.vocabulary())(" x") == [2124]
