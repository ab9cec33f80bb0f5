"""Whole queries against plain Python, archives and stages on awkward tables."""

import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowledger.llm import audio, chat, language, mixing, nearcopies, packing, secrets, simhash, topk, toxicity, warc
from rowledger.llm.common import absent, connected_components, join_spread, table

DIR = "/root/testdata/sf0.001"


def naive_bits(samples, data, order, least):
    """Code length by walking plain dictionaries of contexts (escape method C), one byte after the other."""
    stream = b"\n" * order + (b"\n" * order).join(samples)
    counts = defaultdict(Counter)
    for i in range(order, len(stream)):
        for k in range(order + 1):
            counts[stream[i - k : i]][stream[i]] += 1
    # How often a context stands counts in the gap before the first text as well.
    often = Counter(stream[i - k : i] for k in range(1, order + 1) for i in range(k, len(stream)))
    kept = {c for c in counts if not c or often[c] >= least}
    # A context is grown from its shorter one only.
    kept = {c for c in kept if all(c[i:] in kept for i in range(len(c) + 1))}

    def p(context, byte):
        if context not in kept:
            return p(context[1:], byte)
        here = counts[context]
        t, d = sum(here.values()), len(here)
        if byte in here:
            return here[byte] / (t + d)
        return d / (t + d) * (p(context[1:], byte) if context else 1 / 256)

    text, bits = b"\n" * order + data, 0.0
    for i in range(order, len(text)):
        bits -= np.log2(p(text[i - order : i], text[i]))
    return bits


def test_language_against_a_naive_coder():
    """One language, so that its contexts are those of the union."""
    rng = np.random.default_rng(2)
    samples = [bytes(rng.choice(list(b"abca the"), 900).tolist()) for _ in range(3)]
    model = language.build({"x": samples}, language.Settings(order=3, least=8))
    for data in (samples[0][:200], b"the cab zz\xff at", b"a", b"\n\nq"):
        assert language.code_lengths(model, data)[0] == pytest.approx(naive_bits(samples, data, 3, 8), rel=1e-5)


def test_language_of_long_texts_only(spark):
    """Texts longer than a language's whole bound teach it by their first part."""
    rows = [(i, ("das ist ein langer satz " if i % 2 else "here is another sentence ") * 300, "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, language.Settings(sample_bytes=3_000))
    assert model.langs == ("de", "en")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def contract_spans(text):
    """The base kinds by the contract's own patterns and filters."""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_secrets_base_of_whole_tables(spark, size):
    docs = table(spark, f"/root/testdata/{size}", "documents")
    got = {r.doc_id: r for r in secrets.report(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and (size == "sf0.001" or sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 0)
    for i, t in texts.items():
        want = contract_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        kinds = Counter(k for *_, k in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))


def test_secrets_long_run_in_blocks():
    """Windows of one long candidate come in blocks, and score as all of them at once."""
    rng = np.random.default_rng(1)
    text = "x " + "".join(rng.choice(list("abcdefXYZ0123456789+/"), 60_000)) + " y"
    blocks = list(secrets.encode(text, 2, len(text) - 2))
    assert max(map(len, blocks)) <= secrets.WINDOWS and sum(map(len, blocks)) == -(-(60_000 - 24) // 24)
    parts = secrets.train(np.concatenate(blocks)[:200], np.arange(200) % 2, secrets.Settings(steps=5))
    model = secrets.Model(parts, (1.0, 0.0), 0.0)
    found = secrets.scan_texts(["", text, "short"], model)
    whole = float(secrets.probability(model, np.concatenate(blocks)).max())
    assert [f for f in found[1] if f[2] == "model"][0][3] == pytest.approx(whole) and found[0] == found[2] == []


def brute_links(ints, queries):
    """Every offset with enough overlap is compared, whether integers match or not."""
    out = set()
    for q in queries:
        for c in ints:
            if c == q:
                continue
            x, y = ints[c], ints[q]
            for shift in range(audio.OVERLAP - len(y), len(x) - audio.OVERLAP + 1):
                a, e = max(0, shift), min(len(x), shift + len(y))
                if e - a >= audio.OVERLAP and np.bitwise_count(x[a:e] ^ y[a - shift : e - shift]).mean() / 32 <= audio.ERRORS:
                    out.add((c, q))
                    break
    return out


def test_audio_recall_against_all_offsets(spark):
    """Noisy and shifted recordings: at least 0.9 of what comparing all offsets links, and nothing else."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        notes = rng.normal(0, 0.4, 60)
        for j in range(4):
            mine = notes.copy()
            hit = rng.choice(60, j, replace=False)
            mine[hit] = rng.normal(0, 0.4, j)
            rows.append((100 * g + j, np.roll(mine, 0)[j:].tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = {r.vec_id: np.frombuffer(bytes(r.ints), "<u4") for r in audio.prints(audio.rendered(frame)).collect()}
    want = brute_links(made, [i for i in made if i % 100 == 0])
    got = Counter()
    for r in audio.align(audio.rendered(frame)).collect():
        got[r.vec_id] = r.n_links
    wanted = Counter(c for c, _ in want)
    assert len(want) >= 24 and all(got[c] <= wanted[c] for c in got) and sum(got.values()) >= 0.9 * len(want)


def test_audio_repeated_rows(spark):
    rng = np.random.default_rng(5)
    notes = rng.normal(0, 0.4, 64).tolist()
    rows = [(0, notes)] * 3 + [(103, notes)] * 2 + [(None, notes)]
    got = audio.align(audio.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert len(got) == 6 and {r.n_links for r in got if r.vec_id == 103} == {1}


def test_warc_members(spark, tmp_path):
    """Archives of other writers: many records in a member, many members in a file, further types, none gzipped."""

    def record(kind, i, body):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        digest = warc.base32(body).encode()
        head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (kind, i, digest, len(http))
        return head + http + b"\r\n\r\n"

    r = [record(b"response", i, b"x" * (i * 50_000)) for i in range(4)] + [record(b"request", 9, b"")]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(r[0] + r[1]) + gzip.compress(r[2]) + gzip.compress(b"") + gzip.compress(r[4]))
    (tmp_path / "b.warc").write_bytes(r[3])
    got = {x.page_id: x for x in warc.read_archives(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3] and [got[i].payload_bytes for i in range(4)] == [0, 50_000, 100_000, 150_000]
    with pytest.raises(ValueError):
        list(warc.members_of(gzip.compress(r[0])[:-9]))


def test_warc_index_fetches_single_records(spark, tmp_path):
    long = "".join(chr(97 + i * 7919 % 26) for i in range(300_000))
    rows = [(i, f"http://h{i % 7}.org/{i}", None if i == 3 else long[: i * 3_000]) for i in range(80)] + [(80, "http://x.y", long), (81, "http://x.z", long)]
    path = str(tmp_path / "w")
    extra = spark.createDataFrame([(*r, "r", 5) for r in rows], "page_id long, url string, html string, record string, archive int")
    warc.write_archives(extra, path)
    index = warc.capture_index(warc.read_archives(spark, path))
    got = warc.fetch(index, path).collect()
    assert len(got) == len(rows)
    for x in got:
        (_, fields, block), html = next(warc.records(bytes(x.record))), rows[x.page_id][2] or ""
        assert fields[b"warc-record-id"] == b"<urn:page:%d>" % x.page_id
        assert block.partition(b"\r\n\r\n")[2] == (b"" if x.record_type == "revisit" else html.encode())


def test_warc_null_and_repeated_ids(spark):
    rows = [(None, "u", "same"), (None, "u", "same"), (4, "u", "same"), (4, "u", "same"), (6, None, "same"), (None, None, None)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(None, "revisit", 4): 2, (4, "response", None): 2, (6, "revisit", 4): 1, (None, "response", None): 1})


def test_chat_repeated_turns_and_clashing_names(spark):
    rows = [(1, 0, "user", "b", [1], True), (1, 0, "user", "a", [2], False), (1, 0, "user", "a", [2], False), (1, 1, "assistant", "z" * 100_000, None, None), (None, 0, None, None, None, None)]
    got = {r.conv_id: r for r in chat.digests(chat.assemble(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids array<int>, loss boolean"))).collect()}
    said = "user\na\nuser\na\nuser\nb\nassistant\n" + "z" * 100_000 + "\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and (got[1].n_turns, got[1].loss_chars) == (4, 100_000)
    assert got[None].n_turns == 1 and got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_topk_clashing_names_ties_and_long_vectors(spark):
    rows = [(i, [0.5, 0.25] if i % 2 else [0.5, 0.25, 0.0], i, "q", 1) for i in range(20)] + [(100, [0.1] * 3_000, 1, "q", 1), (None, [1.0], 1, "q", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q int, rank string, score int")
    got = topk.top_k(frame, frame.where("vec_id in (0, 100)")).collect()
    assert [(r.rank, r.vec_id) for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert len([r for r in got if r.query_id == 100]) == 5


def test_join_spread_and_components_with_hot_keys(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(6_000)], "k long, v long")
    by = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = {r.v: r.m for r in join_spread(rows, by, "k", "n", 6_000).collect()}
    assert len(got) == 6_000 and got[1] == got[5] == 5_999 and got[3] == 3
    star = [(0, i) for i in range(1, 3_000)] + [(3_000 + i, 3_001 + i) for i in range(20)]
    roots = dict(connected_components(spark.createDataFrame(star, "a long, b long"), "test").collect())
    assert len(roots) == 3_021 and {roots[i] for i in range(3_000)} == {0} and {roots[3_000 + i] for i in range(21)} == {3_000}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _n int, _w int, _k int, _toxicity double, _set string, _root int, _best int, findings string, c0 int"


def clash_rows():
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 5 :]) + f" only{i}", "en", "ab"[i % 2], 5, 7, 8, 9, 0.5, "s", 1, 2, "f", 3) for i in range(30)]
    rows += [(None, "a text without an id " + " ".join(f"x{i}" for i in range(30)), None, None, None, 7, 8, 9, 0.5, "s", 1, 2, "f", 3), (None, None, None, None, None, None, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 7, 8, 9, 0.5, "s", 1, 2, "f", 3)]
    return rows


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_of_any_name(spark, name, stage):
    docs = spark.createDataFrame(clash_rows(), CLASH)
    out = stage(spark, docs, DIR)
    if name == "packing":
        assert out.count() >= 33
        return
    assert out.columns == docs.columns and out.schema["_set"].dataType == docs.schema["_set"].dataType
    have = Counter(tuple(r) for r in docs.collect())
    for r in out.collect():
        assert tuple(r) in have or name == "secrets"
    assert {r._n for r in out.where("doc_id is not null").collect()} == {7}
    assert stage(spark, docs.limit(0), DIR).count() == 0


def test_pipeline_against_plain_python(spark):
    """run() on a whole table: what each stage does to single texts is computed by itself, the rest by plain Python."""
    docs = table(spark, DIR, "documents")
    rows = [r.asDict() for r in docs.collect()]
    tox = toxicity.Scorer(toxicity.fit(docs, table(spark, DIR, "labels")))
    rows = [r for r in rows if tox.score(r["text"]) < 0.3]
    # Near copies by exact sets of word shingles, all pairs.
    sets = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if k not in least or r["doc_id"] < rows[least[k]]["doc_id"]:
            least[k] = i
    rows = [rows[i] for i in sorted(least.values())]
    frame = spark.createDataFrame(rows, docs.schema)
    model = secrets.fit(frame)
    for r in rows:
        found = secrets.scan_texts([r["text"] or ""], model)[0]
        if found:
            new = secrets.replaced(r["text"], found, "[secret]")
            r["n_chars"] = len(new) if len(new) != len(r["text"]) else r["n_chars"]
            r["text"] = new
    # Weighted fair queueing over packets, in one list.
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    order = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[id(r)] for r in rows if r["source"] == s) for s in order}
    weight, budget, capped = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(total.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(3 * total[s] for s in capped)
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * total[s] if s in capped else left / sum(weight[x] for x in free) * weight[s] for s in order}
    packets, taken = [], Counter()
    for rank, s in enumerate(order):
        at = 0
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        for r in mine:
            for turn in range(3):
                for k in range(0, size[id(r)], 64):
                    p, n = turn * total[s] + at + k, min(64, size[id(r)] - k)
                    if p < target[s]:
                        packets.append(((p + n) / target[s], rank, p, n, id(r)))
            at += size[id(r)]
    used = 0
    for _, _, _, n, who in sorted(packets):
        taken[who] += min(n, budget - used)
        used += min(n, budget - used)
    mixed = [r for r in rows for _ in range(int(taken[id(r)] / size[id(r)] + 0.5) if size[id(r)] else 0)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    want = Counter((r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in mixed)
    got = corpus_pipeline.run(spark, DIR).collect()
    ids = {k[0]: k[1] for k in want}
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    for (doc, tokens), n in want.items():
        whole = sorted(pieces.pop(doc))
        assert sum(x for _, x in whole) == n * len(tokens) and [a for a, _ in whole[::n]] == [sum(x for _, x in whole[::n][:i]) for i in range(len(whole[::n]))]
    assert not pieces


def test_absent_names():
    assert absent(["A", "b_"], "a", "b", "c", "c") == ["a_", "b", "c", "c_"]


def test_repeated_ids_of_mixing_and_simhash(spark):
    rows = [(5, "one two three " * 20, "a"), (5, "other words here " * 20, "a"), (None, "null id text", None), (None, "null id text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert len(mixing.mix(docs).collect()) == len(simhash.near_duplicates(docs).collect()) == 4
    assert nearcopies.keep_one(docs).count() == 3
