"""Each operator against brute force, an exact round trip or held-out labels, and on dirty small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import chat, decontaminate, jaccard, langid, licenses, mixing, neighbours, pii, quality, token_file
from postloom.llm.words import gram_hashes, shingle_sets, word_hashes

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 40_000
DIRTY = [(1, None, "a"), (2, "", None), (3, " \t\n ", "b"), (4, "one two", "a"), (4, "one two", "a"), (5, "Ünï ☃ é", None),
         (None, "one two three four five six", "a"), (6, LONG, "b"), (7, "call a@b.co 10.0.0.1 now", "a")]


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [(i, t, s, "x", 9, 1.0) for i, t, s in DIRTY]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n int, score double")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_word_hashes():
    texts = [t.encode() if t is not None else None for _, t, _ in DIRTY]
    for (_, t, _), own in zip(DIRTY, shingle_sets(texts)):
        assert len(own) == len(shingles(t)) and (own[1:] > own[:-1]).all()
    a, _ = word_hashes(b"Ab cd")
    b, _ = word_hashes(b"x ab\tCD")
    assert a[0] == b[1] and a[1] == b[2] and len(gram_hashes(a, 5)) == 0


def test_mix(spark, dirty):
    sizes, runs = mixing.mix(dirty, block=1000, shard_words=20_000)
    rows = mixing.words_taken(sizes, runs).collect()
    assert len(rows) == len(DIRTY) and sorted(r["size"] for r in rows) == sorted(len(words(t)) for _, t, _ in DIRTY)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, runs = mixing.mix(docs, block=500, shard_words=5000)
    got = mixing.words_taken(sizes, runs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("w"), F.sum("size").alias("s")).collect()
    assert all(abs(r["t"] - r["w"]) <= 0.5 and r["w"] <= 2 * r["s"] + 1e-6 for r in got)
    assert abs(sum(r["w"] for r in got) - 1.5 * sum(r["s"] for r in got)) < 1e-3
    out = mixing.mixed_rows(docs, runs, sizes)
    assert out.columns == docs.columns
    assert {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()} == {
        r["source"]: r["t"] for r in got}
    empty, none = mixing.mix(docs.limit(0))
    assert mixing.words_taken(empty, none).count() == 0


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 7), (None, 0)], "source string, quota long")
    leaves = mixing.splitting_tree(quotas, 100).groupBy("source").agg(F.sum("quota").alias("q"), F.min("quota").alias("m")).collect()
    assert {(r["source"], r["q"]) for r in leaves} == {("a", 1000), ("b", 7), (None, 0)} and all(r["m"] >= 0 for r in leaves)


def test_draws_are_hypergeometric_at_every_size():
    rng = np.random.default_rng(5)
    for own, others, drawn in ((7, 5, 4), (30, 100, 25), (3, 2000, 900), (400, 10, 390)):
        exact = {x: math.comb(own, x) * math.comb(others, drawn - x) / math.comb(own + others, drawn)
                 for x in range(max(0, drawn - others), min(own, drawn) + 1)}
        assert all(abs(mixing.log_chance(x, own, others, drawn) - math.log(p)) < 1e-9 for x, p in exact.items())
        seen = Counter(mixing.hypergeometric(own, others, drawn, rng) for _ in range(8000))
        assert set(seen) <= set(exact)
        assert sum((seen[x] - 8000 * p) ** 2 / (8000 * p) for x, p in exact.items() if 8000 * p > 5) < 3 * len(exact) + 15
    own, others, drawn = 3 * 10**12, 5 * 10**12, 4 * 10**12  # far past what the numbers of numpy's own draw may be
    mean, spread = drawn * own / (own + others), math.sqrt(drawn * own / (own + others) * others / (own + others) * 0.5)
    z = np.array([(mixing.hypergeometric(own, others, drawn, rng) - mean) / spread for _ in range(4000)])
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06 and abs(np.mean(np.abs(z) < 1) - 0.683) < 0.04
    assert [mixing.hypergeometric(*a, rng) for a in ((0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10), (1, 0, 1))] == [0, 3, 0, 5, 1]


def test_mix_keeps_rows_alike_in_id_text_and_source(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "s", lang, 0, 0, 0, 0, 0.5, "r", lang) for lang in ("de", "en", "fr", None)] + [(2, text, "t", "x", 1, 1, 1, 1, 0.5, "r", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, a int, b int, _shard int, _place int, "
                                       "`k.1` double, row string, size string")
    sizes, runs = mixing.mix(docs, block=7, shard_words=50, share=2.0)
    out = mixing.mixed_rows(docs, runs, sizes)
    got = out.collect()
    assert out.columns == docs.columns and {(r["doc_id"], r["lang"], r["size"]) for r in got} == {(r[0], r[3], r[10]) for r in rows}
    taken = {(r["doc_id"], r["lang"]): 0 for r in got}
    for r in got:
        assert r["text"] in text and r["k.1"] == 0.5 and r["row"] == "r"
        taken[r["doc_id"], r["lang"]] += len(words(r["text"]))
    assert set(taken.values()) == {80}


def test_sets_that_share_a_value_are_told_apart(spark):
    rows = [(1, 5, 1), (2, 5, 2), (3, 5, 1), (4, 6, 1), (5, None, None), (6, 7, 3), (7, 7, 3)]
    out = {r["doc_id"]: r["sig"] for r in jaccard.apart(spark.createDataFrame(rows, "doc_id long, sig long, sig2 long")).collect()}
    assert out[1] == out[3] != out[2] and out[6] == out[7] == 7 and out[4] == 6 and out[5] is None
    one, two = jaccard.signature(np.array([1, 2, 3])), jaccard.signature(np.array([1, 2, 4]))
    assert one == jaccard.signature(np.array([1, 2, 3])) and one[0] != two[0] and one[1] != two[1]


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))) == list(range(n))


def test_quality(spark, dirty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = quality.score(docs, model).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert np.mean([(r["score"] >= 0.7) == r["quality"] for r in got]) > 0.9
    out = quality.score(dirty, model)
    assert sorted(out.columns) == sorted(dirty.columns) and out.count() == len(DIRTY) and out.filter("score between 0 and 1").count() == len(DIRTY)
    nothing = quality.fit(docs.limit(0), labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(dirty, nothing).collect()} == {0.5}


def test_language(spark, dirty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = langid.predict(docs, net).filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    out = {(r["doc_id"], r["text"]): r["lang_pred"] for r in langid.predict(dirty, net).collect()}
    assert out[(1, None)] == out[(2, "")] == out[(3, " \t\n ")] == "und" and out[(6, LONG)] != "und"
    assert langid.fit(docs.limit(0), F.lit(True)) is None and langid.predict(docs.limit(0), None).count() == 0
    assert not langid.has_letter("½ 12 _".encode()) and langid.has_letter("ß".encode())


def test_jaccard(spark, dirty):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 60, 60)]
    texts = []
    for i in range(120):
        w = list(base) if i % 3 else [f"v{j}" for j in rng.integers(0, 999, 40)] + base[:12]
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(len(w)))] = f"z{rng.integers(9)}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, "A b"), (202, "a  B"), (203, "")]
    sets, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    while True:
        new = {i: min([low[i]] + [low[j] for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]) for i in sets}
        if new == low:
            break
        low = new
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for long_, block in ((64, 256), (0, 4)):
        got = {r["doc_id"]: (r["n"], r["component_id"]) for r in jaccard.classes(docs, long_=long_, block=block).collect()}
        assert got == {i: (len(sets[i]), low[i]) for i in sets}
    kept = jaccard.one_per_group(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if low[i] == i)
    out = jaccard.one_per_group(dirty)
    assert out.columns == dirty.columns and out.filter("doc_id = 4").count() == 1 and out.filter("doc_id in (1, 2, 3)").count() == 3
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_pii(spark, dirty):
    got = {(r["doc_id"], len(r["base"])) for r in pii.find_pii(dirty).collect()}
    assert (7, 2) in got and (1, 0) in got and len(pii.find_pii(dirty).collect()) == len(DIRTY)
    assert pii.base_spans("x@a.b%y@c.d") == [("email", 0, 5), ("email", 5, 11)]
    assert pii.base_spans("1.2.3.4.5.6.7.8") == [("ip", 0, 7), ("ip", 8, 15)]
    assert pii.base_spans("4111 1111-1111 1111") == [("card", 0, 19)] and pii.base_spans("300.1.1.1") == []
    # contexts of seeds find what no base pattern takes
    seeds = [(i, f"reach user{i}@host.org today") for i in range(20)] + [(50, "reach root@localhost today")]
    found = pii.find_pii(spark.createDataFrame(seeds, "doc_id long, text string")).filter("doc_id = 50").first()
    assert not found["base"] and [tuple(s) for s in found["spans"]] == [("email", 6, 20)]


def test_token_file(spark, dirty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    want = [(i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in DIRTY]
    folder = token_file.write_tokens(dirty, path, parts=3)
    got = token_file.read_tokens(spark, folder).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got)) == sorted((i or 0, len(x), crc(x)) for i, x in want)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0] + [r["n_tokens"] for r in ordered[:-1]]))
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in ordered), key=lambda v: -1 if v is None else v)
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1] * 300, np.uint32)
    packed = token_file.pack(ids)
    assert token_file.unpack(*packed[:2]).tolist() == ids.tolist()
    assert all(token_file.access(*packed, i) == ids[i] for i in range(0, len(ids), 7))
    assert token_file.read_tokens(spark, token_file.write_tokens(dirty.limit(0), path)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12)).round(2)
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (904, [None] * 12)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    hit = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        true = np.lexsort((np.arange(600), -s))[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(s[v] - z) < 1e-12 for _, v, z in mine)
        hit += len({v for _, v, _ in mine} & set(true.tolist()))
    assert hit / 600 >= 0.9
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")
    assert neighbours.nearest(few, F.lit(True)).count() == 2 and neighbours.nearest(few.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_ids_over_parts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)).round(2)
    ids = np.arange(500)
    ids[300:] = 40  # a hot id, asked for and found
    x[300:420] = x[300]
    df = spark.createDataFrame([(int(i), [float(v) for v in r], "x", 1) for i, r in zip(ids, x)], "vec_id long, embedding array<double>, row string, list int")
    monkeypatch.setattr(neighbours, "PART_ROWS", 37)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 11)
    monkeypatch.setattr(neighbours, "RECALL", 1.0)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    want = []
    asked = np.flatnonzero(ids % 20 == 0)
    for q in asked:
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want += [(int(ids[q]), r, int(ids[v])) for r, v in enumerate(np.lexsort((ids, -s))[:5], 1)]
    assert len(got) == 5 * len(asked)
    mine = {}
    for r in got:
        mine[r["query_id"], r["rank"], r["vec_id"]] = mine.get((r["query_id"], r["rank"], r["vec_id"]), 0) + 1
    hits = 0
    for w in want:
        if mine.get(w, 0):
            mine[w] -= 1
            hits += 1
    assert hits / len(want) >= 0.95
    sample = neighbours.fit_sample(df.select("vec_id", F.monotonically_increasing_id().alias("row"), F.col("embedding").alias("x")), 500)
    assert len(sample) == 500


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "", None, "### a</turn>\n\\n", "ß " * 5]
    rows = [(c, t, ("user", "assistant", None, "a:b\\")[t % 4], v, "x") for c in (1, None) for t, v in enumerate(said)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = out.withColumn("learned", chat.learned_text(out)).collect()
    for r in got:
        assert r["identical"] and [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in rows[:7]]
        assert r["learned"] == "".join(x[3] or "" for x in rows[:7] if x[2] == "assistant")
    assert len(got) == 2 and chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_with_long_roles(spark):
    said = [":" * 100_000, "\\" * 100_000, "a:\\" * 50_000, "</turn>\n### x: " * 10_000]
    rows = [(i, 0, role, role) for i, role in enumerate(said)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["identical"], r["turns"][0]["role"], r["turns"][0]["text"]) for r in got) == [(i, True, x, x) for i, x in enumerate(said)]


def test_token_file_over_segments(spark, dirty, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = sorted(map(tuple, token_file.read_tokens(spark, token_file.write_tokens(dirty, path, parts=2)).select("start", "n_tokens", "ids_crc32").collect()))
    monkeypatch.setattr(token_file, "SEGMENT", 999)
    folder = token_file.write_tokens(dirty, path, parts=2)
    assert max(r["n_tokens"] for r in spark.read.parquet(folder).select("n_tokens").collect()) <= 999
    assert sorted(map(tuple, token_file.read_tokens(spark, folder).select("start", "n_tokens", "ids_crc32").collect())) == whole
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc" * 99, b"\0" * 1000), (b"\xff" * 7, bytes(range(256)) * 64)):
        assert token_file.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_encoder_on_odd_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encode, rng = Tokenizer.from_file(path), token_file.Encoder(path), np.random.default_rng(6)
    pool = [*"abz AZ.,;:!?\n\t\r\x0b\x1c\x00'\"-_<|>/[]0 9$*", *"éÉßẞİıœŒÿ½中한　", "\u0301", "\u200d", "\ufeff", "😀", "👍🏽", "<|endoftext|>", "don't", "Été. "]
    texts = ["".join(rng.choice(pool, int(rng.integers(0, 40)))) for _ in range(3000)]
    for at in range(0, 3000, 300):
        flat, bounds = encode([t.encode() for t in texts[at:at + 300]])
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts[at:at + 300]]
    assert encode([])[1].tolist() == [0]


def test_decontaminate(spark, dirty):
    item = " ".join(f"k{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 9000 + item + " y" * 9), (2, item.replace("k20", "q")), (3, item.replace("k15", "q").replace("k22", "q").replace("k5 ", "q ")),
                                  (4, None), (5, "One  TWO")], "doc_id long, text string")
    want = {(d["doc_id"], i["item_id"], len(shingles(d["text"]) & shingles(i["text"]))) for d in docs.collect() for i in items.collect()
            if shingles(i["text"]) and 100 * len(shingles(d["text"]) & shingles(i["text"])) >= 80 * len(shingles(i["text"]))}
    got = decontaminate.contained_items(docs, items)
    assert {(r["doc_id"], r["item_id"], r["shared"]) for r in got.collect()} == want
    clean = decontaminate.decontaminated(docs, items)
    assert {r["doc_id"] for r in clean.collect()} == {1, 2, 3, 4, 5} - {d for d, _, _ in want} and clean.columns == docs.columns
    assert decontaminate.contained_items(dirty, items).filter("doc_id = 4").count() == 2
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0


def test_licenses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit(docs)
    got = licenses.scan_licenses(docs, model).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(d, i) for d, t in text.items() for i, line in enumerate(t.split("\n")) if re.search("(?i)licensed? under|License\\.|rights reserved", line)}
    assert {(r["doc_id"], r["paragraph"]) for r in got} == want
    rows = [(1, None), (2, ""), (3, LONG + "\nReleased under the MIT License.\n" + LONG), (4, "the license version of nothing"), (5, "so " * 100 + "Licensed under CC BY-NC 4.0.")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {(r["doc_id"], r["family"]) for r in found} == {(3, "MIT"), (5, "CC-BY-NC")}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.drop_benchmark(spark, docs, SF)
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in docs.collect() if not any(100 * len(shingles(r["text"]) & i) >= 80 * len(i) for i in items if i)}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows from the rows of the stage before, in plain Python."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, rows = spark.read.parquet(f"{SF}/documents.parquet"), {}
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    given = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, SF).write.parquet(str(tmp_path / str(n)))
        given = spark.read.parquet(str(tmp_path / str(n)))
        rows[n] = given.collect()
        assert n == 4 or given.columns == docs.columns
    first = docs.collect()

    model = quality.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    good, bad = (quality._compressor(d).compress for d in (model.good, model.bad))
    x = quality.difference([(r["text"] or "").encode() for r in first], good, bad)
    stays = 1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -40, 40))) >= 0.7
    assert sorted(map(str, rows[0])) == sorted(str(r) for r, s in zip(first, stays) if s) and 0 < len(rows[0]) < len(first)

    sets, low = {r["doc_id"]: shingles(r["text"]) for r in rows[0]}, {r["doc_id"]: r["doc_id"] for r in rows[0]}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    assert sorted(map(str, rows[1])) == sorted(str(r) for r in rows[0] if low[r["doc_id"]] == r["doc_id"]) and links

    items = [i for i in (shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if i]
    assert sorted(map(str, rows[2])) == sorted(str(r) for r in rows[1] if not any(100 * len(shingles(r["text"]) & i) >= 80 * len(i) for i in items))

    size, taken, whole = {}, {}, {}
    for r in rows[2]:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
        whole[r["doc_id"]] = r
    for r in rows[3]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
        was = whole[r["doc_id"]]
        assert (r["text"] or "").strip() in (was["text"] or "") and r["lang"] == was["lang"] and r["source"] == was["source"]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    want, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while open_:
        part = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * size[s]} or None
        for s in over or open_:
            want[s] = 2 * size[s] if over else part[s]
            left -= want[s]
        open_ = open_ - over if over else set()
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in size) and len(set(size)) > 1

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = [(r["doc_id"], encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in rows[3]]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows[4]) == sorted((i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in ids)
    ordered = sorted(rows[4], key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1]] and [r["doc_id"] for r in ordered] == sorted(i for i, _ in ids)


WRAPPED = {
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL": """# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "MIT": """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction""",
    "BSD": """Redistribution and use in source and
binary forms, with or without modification,
are permitted provided that the following conditions are met:""",
}


@pytest.fixture(scope="module")
def notices(spark):
    model = licenses.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))

    def scan(texts):
        rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
        return [sorted((r["paragraph"], r["family"]) for r in rows if r["doc_id"] == i) for i in range(len(texts))]
    return scan


def test_licenses_wrapped(notices):
    got = notices([f"lorem ipsum\n\n{t}\n\ndolor sit" for t in WRAPPED.values()] + ["so it goes on\n" * 40 + t for t in WRAPPED.values()])
    assert [{f for _, f in x} for x in got] == [{f} for f in WRAPPED] * 2
    # the line in which the notice starts; a blank line ends a paragraph; neighbouring lines keep their notices
    assert notices(["a b\nReleased under\nthe MIT License", "Released under the\n\nMIT License", "Released under the MIT License\n" * 3])[:2] == [[(1, "MIT")], []]
    assert notices(["Released under the MIT License\n" * 3]) == [[(i, "MIT") for i in range(3)]]


def test_licenses_several_families(notices):
    cases = {"Licensed under the MIT License or the Apache License, Version 2.0": {"MIT", "Apache-2.0"},
             "Licensed under the Apache License, Version 2.0 or the MIT license, at your option": {"MIT", "Apache-2.0"},
             "Licensed under the MIT License, the Apache License, Version 2.0 or the BSD 3-Clause License": {"MIT", "Apache-2.0", "BSD"},
             "licensed under the GNU General Public License, version 2, or the GNU Lesser General Public License, version 2.1": {"GPL-2.0", "LGPL"},
             "zlib: Released under the BSD License; core: Licensed under the Mozilla Public License 2.0; art: Licensed under CC BY-SA 4.0": {"BSD", "MPL-2.0", "CC-BY-SA"},
             "Licensed under the GNU Affero General Public License, version 3": {"AGPL-3.0"},
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": {"CC-BY-SA"},
             "the license version of the public domain under terms as published": set()}
    assert [{f for _, f in x} for x in notices(list(cases))] == list(cases.values())
    every = [n for ns in licenses.NOTICES.values() for n in ns]  # each notice alone, and next to another family's in one line
    family = [f for f, ns in licenses.NOTICES.items() for _ in ns]
    assert [{f for _, f in x} for x in notices(every)] == [{f} for f in family]
    pairs = [(i, j) for i in range(len(every)) for j in range(len(every)) if family[i] != family[j]]
    got = notices([f"{every[i]} and {every[j]}" for i, j in pairs])
    assert [(every[i], every[j], x) for (i, j), x in zip(pairs, got) if {f for _, f in x} != {family[i], family[j]}] == []


def test_licenses_in_a_line_of_millions_of_words(monkeypatch):
    model = licenses.train([b"so it goes on"] * 50, turns=100)
    monkeypatch.setattr(licenses, "BLOCK", 4)
    monkeypatch.setattr(licenses, "RUN", 2)
    said = b"Released under the MIT License . "
    found = licenses.scan_paragraphs([[said * 9 + b"a " * (9 << 19) + said]], model)
    assert [f for *_, f, _, _ in found] == ["MIT"] * 10 and found[-1][2] == 45 + (9 << 19)


def test_neighbours_of_outliers(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate((np.full((190, 8), 3.0), rng.normal(size=(10, 8)).round(2)))  # 95 % in one cluster, outliers in lists of one row
    monkeypatch.setattr(neighbours, "MOST_LISTS", 11)
    monkeypatch.setattr(neighbours, "centroids", lambda sample, lists: np.unique(sample, axis=0))
    monkeypatch.setattr(neighbours, "round", lambda _: 11, raising=False)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 188).collect()
    assert [q for q in range(188, 200) if sorted(r["rank"] for r in got if r["query_id"] == q) != list(range(1, 21))] == []
    assert all(abs(r["score"] - float((x[r["query_id"]] * x[r["vec_id"]]).sum())) < 1e-9 for r in got)


def test_decontaminate_hot_items_copies_and_other_columns(spark):
    """A third of all documents hold one item, many items share a passage, texts and items come several times, columns clash."""
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(25)]
    said = [common + [f"i{k}x{j}" for j in range(int(rng.integers(0, 40)))] for k in range(30)]
    said += [said[3], said[4][:6], ["two", "words"], [f"w{j}" for j in rng.integers(0, 9, 70)]]
    texts = [[f"w{j}" for j in rng.integers(0, 9, 60)] for _ in range(40)]
    texts += [t + said[int(rng.integers(len(said)))] for t in texts for _ in range(2)]
    texts += [texts[1] + common + texts[2]] * 50 + [sum(said, [])] * 2 + [["two", "words"], []]
    for t in texts[60:100]:
        t[int(rng.integers(len(t)))] = "changed"
    rows = [(i, " ".join(t), 0, 0, "r") for i, t in enumerate(texts)] + [(7, None, 0, 0, "r"), (7, None, 0, 0, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int, h1 int, row string").repartition(5)
    items = spark.createDataFrame([(k, " ".join(w), 0) for k, w in enumerate(said)], "item_id long, text string, n int")
    sets = {k: shingles(" ".join(w)) for k, w in enumerate(said)}
    want = sorted((i, k, len(own), len(own & shingles(t))) for i, t, *_ in rows for k, own in sets.items() if 100 * len(own & shingles(t)) >= 80 * len(own))
    got = decontaminate.contained_items(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_item"], r["shared"]) for r in got) == want and len(want) > 100
    clean, dirty_ids = decontaminate.decontaminated(docs, items), {(i, t) for i, t, *_ in rows if any(100 * len(o & shingles(t)) >= 80 * len(o) for o in sets.values())}
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(str(r) for r in docs.collect() if (r["doc_id"], r["text"]) not in dirty_ids)
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(rows) and decontaminate.decontaminated(docs.limit(0), items).count() == 0


def test_decontaminate_short_items_with_other_blanks(spark):
    said = ["a b c d e", "k　l　m　n　o p", "a\x1cb\x1dc\x1ed\x1fe f", "x\u0085y\u0085z\u0085v\u0085w u"]
    items = spark.createDataFrame(list(enumerate(said)), "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(said), (9, said[0] + " more")], "doc_id long, text string")
    got = decontaminate.contained_items(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_item"], r["shared"]) for r in got) == [(i, i, 1, 1) for i in range(4)]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()] == [9]


def test_pii_with_blanks(spark):
    seeds = [(i, f"please call +{i % 9 + 1} (555) 010-{1000 + i} after noon") for i in range(30)]
    said = ["(555) 123-4567", "0171 234 5678", "555.123.4567", "0171 234 5678 0171 234 5679"]
    rows = seeds + [(100 + i, f"please call {t} after noon") for i, t in enumerate(said)] + [(200, "it was 0171 234 5678 then")]
    cards = [f"4{i:014d}" for i in range(30)]
    cards = [next(c + str(d) for d in range(10) if pii.luhn(c + str(d))) for c in cards]
    rows += [(300 + i, f"charge my card {c} today") for i, c in enumerate(cards)] + [(400, "charge my card 4111 1111 1111 1112 today")]
    found = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    got = {i: [(s["kind"], text[i][s["a"]:s["b"]]) for s in found[i]["spans"]] for i in (100, 101, 102, 103, 400)}
    assert not any(found[i]["base"] for i in got)
    assert got == {100: [("phone", said[0])], 101: [("phone", said[1])], 102: [("phone", said[2])],
                   103: [("phone", "0171 234 5678"), ("phone", "0171 234 5679")], 400: [("card", "4111 1111 1111 1112")]}
    assert [len(found[i]["spans"]) for i in range(30)] == [1] * 30
    assert pii.occurrences("x1 2a (12) 34", []) == [] and [o["token"] for o in pii.occurrences("in (0171 234 5678)", [])] == ["0171 234 5678"]
    assert len(pii.occurrences("1234 " * 50_000, [])) > 0


def test_licenses_titles_short_forms_and_unknown_families(notices):
    cases = {"SPDX-License-Identifier: MIT": {"MIT"}, "// SPDX-License-Identifier: GPL-2.0-only": {"GPL-2.0"}, "# SPDX-License-Identifier: Apache-2.0 #": {"Apache-2.0"},
             "Apache License\nVersion 2.0, January 2004": {"Apache-2.0"}, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": {"GPL-3.0"},
             "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": {"LGPL"}, "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": {"AGPL-3.0"},
             "The MIT License (MIT)": {"MIT"}, "Distributed under the GNU GPL v3": {"GPL-3.0"}, "Eclipse Public License 2.0": {"EPL-2.0"},
             "In no event will the authors be held liable for any damages\narising from the use of this software.": {"Zlib"},
             "This data is licensed under the Open Wombat Charter, edition 7": {"unknown"}, "Released under the terms of the Foo Sharing Pact": {"unknown"},
             "under the terms of the treaty the border is open": set(), "she has a driving license and the version of the story is public": set(),
             "the software is released in may and the authors claim it is fast": set(), "": set()}
    got = [{f for _, f in x} for x in notices(list(cases))]
    assert dict(zip(cases, got)) == cases
    assert [{f for _, f in x} for x in notices([f"some words go on here and there\n\n{c}\n\nand end so" for c in cases])] == list(cases.values())


def test_license_rows_of_repeats_and_empty_tables(spark):
    from pyspark.sql import Row

    docs = spark.createDataFrame([(i, t, "x") for i, t in [(1, "Released under the MIT License")] * 3 + [(2, None), (3, "")]], "doc_id long, text string, family string")
    model = licenses.fit(docs)
    got = licenses.scan_licenses(docs, model).collect()
    assert len(got) == 3 and len(set(got)) == 1 and isinstance(got[0], Row) and got[0]["family"] == "MIT"
    assert licenses.scan_licenses(docs.limit(0), licenses.fit(docs.limit(0))).count() == 0
