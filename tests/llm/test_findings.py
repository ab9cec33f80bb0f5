"""Cases of whole jobs: near copies of the pipeline, ids, repeats, samples and overlaps."""

import numpy as np

import corpus_pipeline
from rowledger.llm import nearcopies, packing, secrets, simhash, topk, toxicity


def brute_jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def edited(rng, words, n, tag):
    out = list(words)
    for i in rng.choice(len(words), n, replace=False):
        out[i] = f"{tag}{i}"
    return " ".join(out)


def brute_kept(rows):
    root = {i: i for i, _ in rows}
    for i, s in rows:
        for j, t in rows:
            if j < i and root[i] != root[j] and brute_jaccard(s, t) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return sorted(set(root.values()))


def test_pipeline_near_copies(spark):
    """Pairs from 0.5 to 1 are dropped from 0.8 on, also where a key is crowded, which takes rounds."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(8):
        words = [f"g{g}w{rng.integers(0, 5000)}" for _ in range(300)]
        rows += [" ".join(words)] + [edited(rng, words, n, f"e{n}x") for n in (1, 3, 6, 9, 12, 15, 25)]
    words = [f"hot{i}" for i in range(200)]
    rows += [edited(rng, words, 3, f"h{i}x") for i in range(60)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == brute_kept(rows)


def test_pipeline_near_copies_brute_force_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == brute_kept(sorted(rows))


def test_toxicity_sample_is_bounded_in_bytes(spark):
    """Long texts come cut to the bound, and neither block nor leave out the others."""
    rows = [(i, f"{i} " + "word " * 2_000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for room in (7_000, 35_000):
        toxic, ordinary, _ = toxicity.sample(docs, labels, toxicity.Settings(sample_bytes=room))
        assert sum(map(len, toxic)) == room and sum(map(len, ordinary)) == room
    assert toxicity.Settings().sample_bytes == 6_000_000


def test_packing_added_token(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    texts = ["a <|endoftext|> x", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "<|endoftext|", "plain é", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in packing.pack(docs).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}


def test_keep_one_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, stay unless their texts are near copies."""
    texts = {c: " ".join(f"{c}{i}" for i in range(80)) for c in "abcdef"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (8, texts["d"]), (9, texts["e"]), (None, texts["e"]), (7, texts["c"])]
    want = sorted([(-1, texts["a"]), (-1, texts["b"]), (7, texts["c"]), (7, texts["d"]), (9, texts["e"])])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (simhash.keep_one, nearcopies.keep_one):
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in keep(docs).collect()) == want


def test_topk_repeated_query_row(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(1, 40)]
    query = (0, rng.normal(0, 0.3, 8).tolist())
    once = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame([query, *rows], "vec_id long, embedding array<double>"), spark.createDataFrame([query], "vec_id long, embedding array<double>")).collect())
    twice = spark.createDataFrame([query, query, *rows], "vec_id long, embedding array<double>")
    assert len(once) == 5 and sorted(tuple(r) for r in topk.top_k(twice, twice.where("vec_id = 0")).collect()) == sorted(once * 2)


def test_secrets_rest_of_a_token_and_threshold(spark):
    import hashlib

    rows = [(i, f"words token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" more" if i % 2 else f"mail to abcdefgh.{i:02d}@mail{i}.example.com now") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.fit(docs)
    p = np.concatenate([secrets.base_probabilities(t, model) for _, t in rows])
    assert (p >= model.threshold).mean() >= 0.98
    key = "9F8E7D6C5B4A39281F" + "0f" * 12 + "A1B2C3D4E5F60718A9"
    assert secrets.replaced(f"key {key} end", secrets.scan_texts([f"key {key} end"], model)[0], "[secret]") == "key [secret] end"
    low = secrets.Model(model.parts, (0.001, -2.0), 2.0, model.settings)
    assert 0 < secrets.recalling(docs, low) < 0.5
