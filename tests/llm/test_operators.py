"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names,
each operator against a brute-force version or an exact round trip."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import ann, audio, bpe, chat, licenses, mixing, near, quality, substrings, toxicity

R = random.Random(5)
VOCABULARY = [a + b for a in "bdfgklm" for b in ("a", "e", "in", "or", "ust")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, h long, kept string"


def prose(n):
    return " ".join(R.choice(VOCABULARY) + R.choice(["", "", ".", ","]) for _ in range(n))


def table(spark, texts, sources=None):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(i, x, "en", sources[i] if sources else "a", len(x or ""), 0.5, 1, 2, "k") for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    shared = prose(60)
    long = prose(9000)
    return [None, "", " \n\t", "Word", "word", "one two", prose(34), prose(40), shared, "x " + shared + " y", shared, shared + " tail", long, long[:-40] + "end", "ab" * 4000, "É É é <|endoftext|> Σς", prose(50).upper() + "\r\n" + shared]


# -- near duplicates


def components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, texts, k):
    base = prose(120).split()
    family = []
    for n in range(24):  # a chain: each member differs a little more from the first
        copy = list(base)
        for j in range(n):
            copy[5 * j % 120] = f"w{j}"
        family.append(" ".join(copy))
    every = texts + family
    sets = {i: shingle_set(x, k) for i, x in enumerate(every)}
    expected = components(sets, 80)
    found = near.near_duplicates(table(spark, every), words=k).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {(i, len(s), expected[i], expected[i] == i) for i, s in sets.items()}
    kept = near.keep_first(table(spark, every), words=k)
    assert kept.columns == table(spark, every).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in expected.items() if i == c}


def test_near_nothing(spark):
    assert near.near_duplicates(table(spark, ["a"]).limit(0)).count() == 0
    same = table(spark, ["a b c", "a b c"]).withColumn("doc_id", F.lit(7).cast("long"))
    assert [r.component_id for r in near.near_duplicates(same).collect()] == [7, 7]


def test_estimate_follows_similarity(spark):
    s = np.arange(1000, dtype=np.uint64)
    words = near.mix(s)
    rows = [([int(x) for x in near.signature(words)[1].view(np.int64)], [int(x) for x in near.signature(words[n:])[1].view(np.int64)], n) for n in (0, 200, 600)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, n int").select("n", near.estimate(F.col("a"), F.col("b")).alias("e")).collect()
    for r in got:
        assert abs(r.e - (1 - r.n / 1000)) < 0.13


# -- substrings


def removed(every, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in every]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = {}
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("split", [20_000, 3])
def test_substrings(spark, texts, split):
    every = [*texts, *["same " * 80], prose(20) + " " + " ".join(texts[8].split()[:36]), *[texts[8]] * 9]
    expected = removed(every, 35)
    got = substrings.without_repeats(table(spark, every).drop("kept"), split=split).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, " ".join((r.kept or "").split())) for r in got} == {i: (a, b, " ".join(c.split())) for i, (a, b, c) in expected.items()}
    digests = substrings.substring_query(table(spark, every)).collect()
    assert {r.doc_id: r.kept_sha256 for r in digests} == {i: hashlib.sha256(c.encode()).hexdigest() for i, (_, _, c) in expected.items()}


def test_substring_index_grows_by_runs(spark, tmp_path):
    a, b = prose(50), prose(50)
    index = substrings.FingerprintIndex(spark, str(tmp_path), max_runs=2)
    for text in (a, b, a):
        index.append(spark.createDataFrame([(1, text)], "rk long, text string"))
    assert len(index.runs) == 1  # compacted
    own = set(index.prints(spark.createDataFrame([(1, a)], "rk long, text string"), False).collect())
    assert {(r.fp,) for r in index.repeated().collect()} == {(r.fp,) for r in own}


def test_substrings_empty(spark):
    assert substrings.substring_query(table(spark, ["a"]).limit(0)).count() == 0
    stage = substrings.drop_repeats(table(spark, [None, "a  b", "c"]))
    assert sorted((r.doc_id, r.text) for r in stage.collect()) == [(0, ""), (1, "a  b"), (2, "c")]


# -- tokenizer


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_query(spark, texts):
    t = library()
    every = [*texts, "".join(R.choice("abcdeth") for _ in range(3000)), "it's WE'LL 1234 !?", "a <|EndOfText|> b"]
    got = {r.doc_id: r for r in bpe.bpe_query(table(spark, every)).collect()}
    for i, x in enumerate(every):
        e = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(e)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_transducer_equals_whole_words():
    b = bpe.load(bpe.tokenizer_path())
    assert 30 <= b.lookahead <= 400
    for n in range(60):
        letters = R.choice(["ab", "theinr", "abcdefghijklmnopqrstuvwxyz", "!?.", "aaaaab"])
        parts = [b.symbols[ord(c)] for c in (R.choice(letters) for _ in range(R.randrange(1, 900)))]
        parts[-1] += bpe.END
        assert list(b.transduce(iter(parts))) == b.merged(list(parts))


def test_decoder_holds_back_bytes(spark):
    b = bpe.load(bpe.tokenizer_path())
    ids, _ = b.encode("Ünïcode 漢字 👍 <|endoftext|>")
    numbers = [x for (x,) in struct.iter_unpack("<I", b"".join(ids))]
    assert "".join(b.text(numbers)) == "ünïcode 漢字 👍 <|endoftext|>"
    back = bpe.decode(bpe.encode(table(spark, ["A b", None]).select("doc_id", "text"))).collect()
    assert {r.doc_id: r.text for r in back} == {0: "a b ", 1: ""}


# -- audio


def test_audio(spark, texts):
    got = {r.doc_id: r for r in audio.audio_features(table(spark, texts).select("doc_id", audio.wav(F.col("text")).alias("media"))).collect()}
    digests = {r.doc_id: r for r in audio.audio_query(table(spark, texts)).collect()}
    by_text = defaultdict(set)
    for i, x in enumerate(texts):
        data = (x or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        r = got[i]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert digests[i].n_bytes == len(data) and digests[i].media_sha256 == r.media_sha256 and r.media_bytes == len(payload) + 44
        tensors = [audio.read_tensor(t) for t in r.tensors]
        assert {t.shape for t in tensors} == {(32, 16)} and len(tensors) == len(r.spans)
        assert all(a.end_ms <= b.start_ms for a, b in zip(r.segments, r.segments[1:], strict=False))
        by_text[x or ""].add((r.feature, r.media_sha256))
    assert all(len(v) == 1 for v in by_text.values())
    assert audio.audio_query(table(spark, ["a"]).limit(0)).count() == 0


def test_resample_keeps_a_tone():
    t = np.arange(16_000)
    y = audio.resample(np.round(100 * np.sin(2 * np.pi * 1000 * t / 16_000)).astype(np.int32))
    spectrum = np.abs(np.fft.rfft(y[500:10_500] / (1 << 14)))
    assert abs(np.argmax(spectrum) * (16_000 * 2 / 3) / 10_000 - 1000) < 3


# -- chat


def test_chat(spark):
    rows = [(1, 1, "assistant", "b</turn>\n### user: x"), (1, 0, "user", None), (2, 0, "odd: #role", "\\<|image:0|>"), (None, 0, "assistant", "é\\"), (1, 2, "assistant", ""), (1, 2, "assistant", "")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(messages.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for conv in (1, 2, None):
        own = sorted(((t, role, text or "") for c, t, role, text in rows if c == conv))
        said = "".join(x for _, role, x in own if role == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = "".join(r.piece for r in sorted(formatted.filter("conv_id = 1").collect(), key=lambda r: r.char_start))
    assert chat.parse(whole)[1] == ("assistant", "b</turn>\n### user: x")
    assert chat.digests(formatted.limit(0)).count() == 0


def test_parts_are_flattened_in_order(spark):
    parts = [dict(type="text", text="see <|image:0|>"), dict(type="image", ref="a.png", width=56, height=30), dict(type="audio", ref="b.wav", ms=100), dict(type="document", ref="c.pdf", pages=2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", [parts[1]])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = sorted(chat.format_conversations(df).collect(), key=lambda r: r.turn)
    assert a.piece == "### user: see \\<|image:0|><|image:0|><|audio:1|><|document:2|></turn>\n"
    assert [(x.slot, x.ref, x.n_tokens) for x in a.attachments] == [(0, "a.png", 4), (1, "b.wav", 3), (2, "c.pdf", 512)]
    assert b.attachments[0].slot == 3 and a.n_tokens == 2 + 4 + 3 + 512


# -- mixing and licenses, against their SQL


def against_sql(spark, frame, sql, columns, tmp_path, name="documents"):
    import duckdb

    frame.write.parquet(str(tmp_path / "t"))
    c = duckdb.connect()
    c.execute(f"create view {name} as select * from '{tmp_path}/t/*.parquet'")
    return c.sql(sql).select(", ".join(columns)).fetchall()


@pytest.mark.parametrize("empty", [False, True])
def test_mixing(spark, texts, tmp_path, empty):
    every = texts + [prose(R.randrange(400)) for _ in range(120)] + [prose(3)] * 2
    sources = [R.choice(["a", "b", "B", None, "é"]) for _ in every]
    sources[-1], sources[-2], sources[0] = "tiny", "a", "none"  # a source far below its share, one without words
    docs = table(spark, every, sources)
    docs = docs.limit(0) if empty else docs
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = mixing.mix_sources(docs).collect()
    expected = against_sql(spark, docs, mixing.mixing_sql(), columns, tmp_path)
    key = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert key([[r[c] for c in columns] for r in got]) == key(expected)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 3 * r.size and sum(r.taken_by_shard) == r.taken
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 24
    if not empty:
        assert by["tiny"][0].target == 9.0 and by["none"][0].target == 0  # capped at three times its size
        assert abs(sum(rows[0].target for rows in by.values()) - sum(r.size for r in got)) < 1e-6


def test_seats_go_by_highest_quotients(spark):
    sizes = spark.createDataFrame([("a", 530), ("b", 240), ("c", 230)], "source string, size long")
    goals = mixing.targets(sizes, weights=(53, 24, 23), max_repeat=3)
    seats = {(r.source, r.shard): r.seats for r in mixing.quotas(goals, 100, 2).collect()}
    for shard, house in ((1, 5), (2, 10)):
        quotients = sorted(((w / (2 * k + 1), s) for s, w in (("a", 530), ("b", 240), ("c", 230)) for k in range(house)), reverse=True)[:house]
        assert {s: seats[s, shard] for s in "abc"} == {**dict.fromkeys("abc", 0), **Counter(s for _, s in quotients)}


def test_licenses(spark, texts, tmp_path):
    lines = ["Released under the MIT License.", "x UNDER-the mit\nLicense", "Under the mit licenses", "licensed by: Apache License, Version 2.0", "CC BY-NC 4.0 cc_by nc", "éunder the mit license", "under the MIT licens\u212a"]
    lines += ["this WORK is licensed under the gnu general license version 3", licenses.TEMPLATES["mit-text"][:120], " ".join(sorted(licenses.TEMPLATES["bsd"].split())[:18]), "a\rReleased under the mit license " * 3]
    every = texts + lines + lines[:2]
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = table(spark, every)
    got = [tuple(r[c] for c in columns) for r in licenses.license_scan(docs).collect()]
    expected = against_sql(spark, docs, licenses.license_sql(), columns, tmp_path)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert licenses.license_scan(docs.limit(0)).count() == 0


# -- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in rng.standard_normal((900, 15)) * rng.uniform(0.2, 3, (900, 1))]
    rows = list(enumerate(vectors)) + [(2000, vectors[100]), (2001, None), (2002, [0.0] * 15), (2003, [float("nan")] * 15), (2004, [None] + [1.0] * 14), (2005, [float("inf")] * 15), (2006, [1.0]), (5, vectors[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("score", F.lit(0.0))
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    pool = {i: np.array(v) for i, v in enumerate(vectors)} | {2000: np.array(vectors[100])}
    hits = 0
    assert set(got) == {i for i in pool if i % 100 == 0}
    for q, found in got.items():
        exact = sorted((float(np.sqrt(((pool[q] - v) ** 2).sum())), i) for i, v in pool.items() if i != q)[:10]
        hits += len({i for _, i in exact} & {i for i, _ in found})
        assert [s for _, s in found] == sorted(s for _, s in found) and all(abs(s - np.sqrt(((pool[q] - pool[i]) ** 2).sum())) < 1e-9 for i, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0
    assert [r.vec_id for r in ann.nearest(df.filter("vec_id in (0, 7)")).collect()] == [7]


@pytest.mark.parametrize("kind", ["tight groups", "far from zero", "lengths apart"])
def test_neighbours_are_exact_on_any_rows(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 17))
    if kind == "tight groups":
        x = x[rng.integers(0, 3, 3000)] + 1e-4 * x
    elif kind == "far from zero":
        x += 1e5
    else:
        x *= np.exp(2 * rng.standard_normal((3000, 1)))
    x[1500:1520] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, ann.nearest(df, rerank=20).collect()))
    expected = []
    for q in range(0, 3000, 100):
        score = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        score[q] = np.inf
        expected += [(q, n + 1, int(i), float(score[i])) for n, i in enumerate(np.lexsort((np.arange(3000), score))[:10])]
    assert got == expected


def test_parallel_error_is_penalised():
    x = np.random.default_rng(2).standard_normal((2000, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(weight):
        books = ann.fit(x, weight)
        codes = ann.assign(x, books, weight)
        back = books[np.arange(8)[None, :], codes].reshape(x.shape)
        return (((x - back) * u).sum(1) ** 2).mean()

    assert parallel(6.0) < 0.8 * parallel(1.0)


# -- classifiers


def labelled(spark):
    good = [prose(R.randrange(20, 120)) for _ in range(160)]
    bad = [" ".join(w + R.choice(["%%%", "$$$", "###"]) for w in prose(60).split()) for _ in range(60)]
    toxic = [x.split() for x in good[:60]]
    for i, words in enumerate(toxic):
        for _ in range(1 + i % 6):
            words.insert(R.randrange(len(words)), R.choice(["zorg", "blarg"]))
    every = [" ".join(w) for w in toxic] + good[60:] + bad
    labels = [(i, int(i < 160), int(i < 60)) for i in range(len(every))]
    return table(spark, every + [None, ""]), spark.createDataFrame([*labels, (0, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    wrong = [r for r in rows if r.held_out and r.doc_id < 220 and r.predicted != int(r.doc_id < 160)]
    assert len(wrong) <= 2
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.severity <= 2 and r.p_severe <= r.p_toxic for r in rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id < 220]
    assert sum(r.toxic != int(r.doc_id < 60) for r in held) <= 3
    assert {r.severity for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
