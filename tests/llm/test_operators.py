"""The operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rowledger.llm import audio, chat, language, mixing, packing, secrets, simhash, topk, toxicity, warc
from rowledger.llm.common import connected_components, crc_mod4, running_start, table

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp long, size int"


def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(1, None, "en", "a", 0, "s", 1, 1), (2, "", None, None, None, None, None, None), (3, " \t\n ", "en", "a", 3, "s", 1, 1), (4, long, "de", None, 9, "s", 1, 1)]
    rows += [(5, "the same text twice over here", "en", "b", 9, "s", 1, 1)] * 2 + [(None, "no id at all but words", "en", "b", 9, "s", 1, 1), (6, "12345 ...", "en", "b", 9, "s", 1, 1)]
    return spark.createDataFrame(rows, DOCS)


def brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, bits=4):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i in range(len(ids)):
        least[find(i)] = min(least[find(i)], ids[i])
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("limit", [96, 2])
def test_simhash_brute_force(spark, limit):
    docs = table(spark, DIR, "documents").limit(120).select("doc_id", "text")
    copies = docs.where("doc_id < 40").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text"))
    rows = docs.union(copies).collect()
    want = brute_components([r.doc_id for r in rows], [brute_print(r.text) for r in rows])
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket_limit=limit).collect()}
    assert {r.doc_id: (f"{brute_print(r.text):016x}", c) for r, c in zip(rows, want, strict=True)} == {k: (r.fingerprint, r.component_id) for k, r in got.items()}


def test_simhash_links_random_prints(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(40)}
    fps = [simhash.signed(p) for p in prints]
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & simhash.ALL).count("1") <= 4}
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert {tuple(r) for r in simhash.near_links(frame, bucket_limit=10_000).collect()} == want

    def closed(links):
        links, nodes = list(links), {x for p in links for x in p}
        comp = {n: n for n in nodes}
        for _ in nodes:
            for a, b in links:
                comp[a] = comp[b] = min(comp[a], comp[b])
        return comp

    assert closed([tuple(r) for r in simhash.near_links(frame, bucket_limit=3).collect()]) == closed(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(5, 25), (100, 101)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "test").collect())
    assert got[29] == 0 and got[19] == 10 and got[101] == 100 and got[0] == 0


def test_running_sum_is_exact(spark):
    rows = [(i % 3, hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(500)]
    got = running_start(spark.createDataFrame(rows, "g int, h string, v long"), "g", ["h"], "v", "start", 16).collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.h)
        assert [r.start for r in mine] == [sum(x.v for x in mine[:i]) for i in range(len(mine))]


def test_language_code_lengths_and_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.fit(docs)
    text = docs.select("text").first()[0].encode()
    assert np.allclose(language.code_lengths(model, text), language.batch_lengths(model, [b"x", text, b""])[1], rtol=1e-6)
    width = int(model.classes.max()) + 1
    inside = 2.0 ** -model.bits.reshape(-1, width, len(model.langs))
    assert (inside[:, 1:].sum(1) <= 1 + 1e-5).all()
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(crc_mod4(r.doc_id) == 2 for r in rows)


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted and r.toxic for r in rows)
    assert right / max(1, sum(r.predicted for r in rows)) > 0.7 and right / sum(r.toxic for r in rows) > 0.5


def test_secrets_base_and_model(spark):
    key = "AKIA" + "Q" * 16
    text = f'é password = "hunter22" {key} token: abc SECRET=ab {"0f" * 14} x'
    got = secrets.base_spans(text)
    assert [(k, text[a:b]) for a, b, k in got] == [("assign", 'password = "hunter22'), ("access", key), ("hex", "0f" * 14)]
    assert secrets.base_spans("secret=token: abcdefgh") == []
    rows = [(i, f"words token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" more" if i % 2 else f"mail to abcdefgh.{i:02d}@mail{i}.example.com now") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.fit(docs)
    odd = hashlib.md5(b"x").hexdigest().upper()
    found = secrets.scan_texts([f"key {odd} end", "mail to abcdefgh.77@mail3.example.com now", ""], model)
    assert [s[2] for s in found[0]] == ["model"] and found[1] == [] and found[2] == []
    masked = secrets.redact(docs.limit(2), model).orderBy("doc_id").collect()
    assert masked[0].text == rows[0][1] and masked[1].text == 'words [secret]" more'


def test_mixing_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), "abc"[i % 3] if i % 10 else None) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total, taken = sum(r.size for r in got), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(taken.values()) == total and abs(sum(t for t, _ in targets.values()) - total) < 1e-6
    assert all(abs(taken[s] - t) <= 64 and t <= 3 * z for s, (t, z) in targets.items())
    assert targets[None][0] == 3 * targets[None][1] or targets[None][0] < targets["b"][0]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = table(spark, DIR, "documents").limit(150)
    tok = Tokenizer.from_file(packing.vocabulary())
    tok.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    want = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [1] for r in docs.collect()}
    made, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        made[r.doc_id].append((r.start, r.ids))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert {k: sum((x for _, x in sorted(v)), []) for k, v in made.items()} == want
    for parts in seqs.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    strange = ["<|endoftext|> x", "a" * 3000, "​  　tab\tx\r\n\n  end  ", "1234567890123 \U0001f600́ 'll 'S", " " * 900]
    assert [list(packing.encoder(packing.vocabulary())(s)) for s in strange] == [tok.encode(s, add_special_tokens=False).ids for s in strange]


def test_cutting_stock_is_tight():
    rng = np.random.default_rng(3)
    demand = rng.integers(0, 400, 255)
    plan = packing.solve(demand, 256)
    assert (sum(p * n for p, n in plan) == demand).all() and all(p @ np.arange(1, 256) <= 256 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.01 * max(demand @ np.arange(1, 256) / 256, demand[128:].sum()) + 60  # no two parts over half fit together


def test_topk_brute_force(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i // 3).normal(0, 0.3, 8)]) for i in range(90)]
    rows += [(200, None), (201, [None, 1.0]), (202, [float("nan")] * 8), (203, [float("inf")] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows if i < 100}
    want = {(q, n + 1, c, s) for q in range(0, 90, 10) for n, (s, c) in enumerate(sorted(((int(ints[q] @ ints[c]), c) for c in ints if c != q), key=lambda x: (-x[0], x[1]))[:5])}
    assert {tuple(r) for r in topk.top_k(frame, frame.where("vec_id % 10 = 0")).collect()} == want
    few = frame.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2


def test_warc_round_trip(spark):
    rows = [(1, "http://www.B.com/x#f", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, None), (3, "https://a.b.com:443", ""), (7, "http://b.com/x", "<p>é\r\n\r\nWARC/1.1</p>"), (5, "http://b.com/\r\ny", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 2), 7: ("revisit", 1), 5: ("response", None)}
    assert all(r.payload_digest == warc.base32((h or "").encode()) and r.payload_bytes == len((h or "").encode()) for (k, _, h) in rows for r in [got[k]])
    assert got[1].url_key == "com,b)/x" and got[3].url_key == "com,b,a)/" and got[2].url_key == "-"
    index = warc.archive(table(spark, DIR, "pages")).collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in index]
    assert keys == sorted(keys) and len(keys) == table(spark, DIR, "pages").count()


def test_loser_tree():
    rng = np.random.default_rng(0)
    runs = [sorted((int(x), i, j) for j, x in enumerate(rng.integers(0, 50, n))) for i, n in enumerate((0, 5, 1, 40, 17))]
    assert list(warc.LoserTree(runs)) == sorted(sum(runs, [])) and list(warc.LoserTree([])) == []


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "", None, "<\\|x <|<|", "line\nline é\U0001f600", "<|endoftext|>"]
    rows = [(c, i, ["system", "user", "assistant", None, "a\nb%"][(c + i) % 5], s) for c in range(5) for i, s in enumerate(said)]
    got = {r.conv_id: r for r in chat.digests(chat.assemble(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in range(5):
        mine = [(r or "", x or "") for k, _, r, x in rows if k == c]
        under = "".join(x for r, x in mine if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())
    for s in said:
        assert chat.unescape(chat.escape(s or "")) == (s or "") and "<|" not in chat.escape(s or "")


def test_audio_alignment(spark):
    rng = np.random.default_rng(5)
    notes = rng.normal(0, 0.4, 64)
    rows = [(0, notes.tolist()), (103, notes.tolist()), (7, rng.normal(0, 0.4, 64).tolist()), (9, None), (11, [0.1])]
    got = {r.vec_id: r for r in audio.align(audio.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()}
    assert (got[103].n_links, got[103].best_query, got[103].best_offset) == (1, 0, -3) and got[103].best_errors < 0.05
    assert got[7].n_links == 0 and got[9].class_id is None and got[11].class_id is None and got[0].class_id == 0


@pytest.mark.parametrize("empty", [False, True])
def test_edge_tables(spark, empty):
    docs = edge_docs(spark)
    docs = docs.limit(0) if empty else docs
    n = 0 if empty else 8
    labels = spark.createDataFrame([(5, 1), (6, None)], "doc_id long, toxic int")
    assert len(language.identify(docs).collect()) == n
    scored = toxicity.classify(docs, labels).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    assert len(secrets.report(docs).collect()) == n
    assert secrets.redact(docs).columns == docs.columns and toxicity.keep_clean(docs, labels).columns == docs.columns
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == n and mixing.resample(docs).columns == docs.columns
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == n
    kept = simhash.keep_one(docs).collect()
    packed = packing.pack(docs).collect()
    assert sum(r.length for r in packed) == sum({(r.doc_id, r.doc_tokens, i): r.doc_tokens for i, r in enumerate(packed) if r.start == 0}.values())
    if not empty:
        assert {r.doc_id: r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
        assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 4, 5, 6] and len(kept) == 5
        assert {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}[6] == "und"
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(pages).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).count() == 0 and audio.align(audio.rendered(none)).count() == 0
    assert chat.digests(chat.assemble(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
