"""The operators of gritsieve.llm on small tables against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from gritsieve.llm import balance, hamming, langid, lbl, licenses, planes, segment_bpe, templates, topk, warc
from gritsieve.llm.common import components, find_package, shared_folder

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "lang wort " * 30_000
ODD = [
    (1, "One two three four five six"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "One two three four five six"),
    (5, "One two three four five six"),
    (6, "12 %% 34"),
    (7, LONG),
    (None, "a row without a key"),
    (8, "İSTANBUL ΑΣ <|endoftext|>x can't 日本 \x1cé"),
]


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    find_package(spark)


def table_of(spark, rows, schema="doc_id long, text string"):
    """A table with extra columns whose names clash with those the operators make."""
    df = spark.createDataFrame(rows, schema)
    for name in ("at", "shard", "size", "n", "key", "lang_pred", "score", "h", "sig", "w", "found", "x"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return _kept(spark, table_of(spark, ODD))


def _kept(spark, df):
    path = shared_folder(spark, "test")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return table_of(spark, [], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# shards


def test_karmarkar_karp_balances_and_keeps_heavy_items_alone():
    rng = random.Random(3)
    for sizes in ([rng.randrange(1, 1000) for _ in range(400)], [1] * 33, [100_000] + [rng.randrange(1, 50) for _ in range(300)], [7], []):
        for shards in (1, 2, 5, 16):
            sums = [0] * shards
            for size, shard in zip(sizes, balance.karmarkar_karp(sizes, shards)):
                sums[shard] += size
            assert sum(sums) == sum(sizes)
            if len(sizes) > 100:
                rest = sorted(sums)[: -1 if sizes[0] == 100_000 and shards > 1 else None]
                assert max(rest) - min(rest) <= max(2, 0.02 * max(rest))


def test_two_way_differencing_by_hand():
    parts = balance.karmarkar_karp([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, p in zip([8, 7, 6, 5, 4], parts) if p == side) for side in (0, 1)]
    assert sorted(sums) == [14, 16]  # the known result of the method


def test_shards(spark, odd, documents, nothing):
    for df in (documents, odd):
        rows = balance.balanced_shards(df, 4).collect()
        assert len(rows) == df.count()
        for shard, own in itertools.groupby(sorted(rows, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
            assert [r["slot"] for r in own] == list(range(len([r for r in rows if r["shard"] == shard])))
    text = {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
    places = collections.defaultdict(set)
    sums = collections.Counter()
    for r in balance.balanced_shards(documents, 4).collect():
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
        places[data].add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(len(p) == 1 for p in places.values())
    assert max(sums.values()) - min(sums.values()) <= 0.01 * max(sums.values())
    assert balance.balanced_shards(nothing, 4).count() == 0


# tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed):
    rng = random.Random(seed)
    signs = "aàéßΣİKk'sST tdrvmM.,-_<|endoftext|>startof \t\x1c\x85   1²Ⅷ½日\U0001d49ć​\x00"
    extra = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "..,", "ab" * 200]
    return ["".join(rng.choice(signs) if rng.random() < 0.9 else rng.choice(extra) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_both_encoders_agree_with_the_library(tokenizer):
    texts = random_texts(3000, 5) + [LONG, "ab" * 5000]
    vocabulary = segment_bpe.vocabulary(PATH)
    own, library = vocabulary.chunks.of_texts(texts), planes.library_chunks(PATH).of_texts(texts)
    for text, a, b, encoded in zip(texts, own, library, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(a, "<u4").tolist() == encoded.ids, text[:80]
        assert a == b, text[:80]
        assert vocabulary.decode(a).decode() == tokenizer.decode(encoded.ids, skip_special_tokens=False)


def test_capitals_before_combining_marks(tokenizer):
    texts = ["J\u030cet", "H\u0331alil", "T\u0308a", "T\u0344a", "W\u030aa", "Y\u030aa", "E\u0301 a\u0328\u0301 K\u0327 \u212b\u0301"]
    texts += [chr(letter) + mark + "x y" for letter in range(65, 91) for mark in map(chr, range(0x300, 0x370))]
    vocabulary = segment_bpe.vocabulary(PATH)
    own, library = vocabulary.chunks.of_texts(texts), planes.library_chunks(PATH).of_texts(texts)
    for text, a, b, encoded in zip(texts, own, library, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(a, "<u4").tolist() == np.frombuffer(b, "<u4").tolist() == encoded.ids, ascii(text)
    # no other sign composes with an ASCII letter
    pairs = [d.split() for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and d[0] != "<" and " " in d]
    assert all(0x300 <= int(b, 16) < 0x370 for a, b in pairs if int(a, 16) < 128)


def test_a_small_cache_forgets_without_harm(tokenizer):
    vocabulary = segment_bpe.Vocabulary(PATH)
    vocabulary.chunks.limit = 10
    texts = random_texts(300, 8)
    for at in range(0, 300, 20):
        for a, encoded in zip(vocabulary.chunks.of_texts(texts[at : at + 20]), tokenizer.encode_batch(texts[at : at + 20], add_special_tokens=False)):
            assert np.frombuffer(a, "<u4").tolist() == encoded.ids


def test_token_digests(spark, odd, documents, nothing, tokenizer):
    for df in (odd, documents):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            decoded = tokenizer.decode(ids, skip_special_tokens=False)
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert sorted(map(tuple, segment_bpe.token_digests(df, PATH).collect()), key=str) == sorted(want, key=str)
        apart = segment_bpe.decode_documents(segment_bpe.encode_documents(df, PATH), PATH)
        together = segment_bpe.encode_and_decode(df, PATH)
        assert sorted(map(tuple, apart.collect()), key=str) == sorted(map(tuple, together.collect()), key=str)
    assert segment_bpe.token_digests(nothing, PATH).count() == 0


def test_id_files(spark, odd, documents, nothing, tokenizer):
    for df, block in ((odd, 1000), (documents, planes.BLOCK)):
        folder = planes.write_ids(df, shared_folder(spark, "ids"), PATH, parts=5, block=block)
        got = sorted(planes.read_ids(spark, folder).collect(), key=lambda r: r["start"])
        start, want = 0, []
        for r in got:
            assert (r["start"], r["n_tokens"], len(r["ids"])) == (start, r["n_tokens"], 4 * r["n_tokens"])
            start += r["n_tokens"]
        for r in df.select("doc_id", "text").collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            want.append((r["doc_id"], np.array(ids, "<u4").tobytes()))
        assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=str) == sorted(want, key=str)
        keys = [r["doc_id"] for r in got]
        assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    assert planes.read_ids(spark, planes.write_ids(nothing, shared_folder(spark, "ids"), PATH)).count() == 0


def test_planes_round_trip():
    values = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint32)
    assert (planes.from_planes(planes.to_planes(values), 1000, "<u4") == values).all()


# languages


def test_language_accuracy_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    told = entry_module.queries()["op3_byte_cnn"](spark, folder)
    rows = told.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, documents, nothing):
    model = langid.train(documents)
    told = langid.predict(odd, model)
    assert told.columns == [c for c in odd.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    rows = told.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == lettered and (r["score"] > 0) == lettered
    assert langid.train(nothing) is None and langid.predict(nothing, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def test_pair_tables_equal_the_filters():
    model = langid.ByteCNN(["a", "b"], length=32)
    x = np.random.default_rng(2).integers(32, 127, (5, 32)).astype(np.uint8)
    near, far = model.tables()
    pairs = (x[:, :-1].astype(int) << 8) | x[:, 1:]
    sums = near[pairs[:, :-2]] + far[pairs[:, 2:]]
    direct = [sum(model.weights[f"w{w}"][j][x[:, j : j + 29]] for j in range(w)) for w in model.widths]
    assert np.allclose(sums, np.concatenate(direct, 2), atol=1e-5)


# templates


def test_templates(spark, nothing):
    items = [
        (1, "Anna Smith has 12 apples and gives Bob Jones 5 apples of them in 3 hours, how many are left in the basket of Anna Smith"),
        (2, "what is the answer"),
        (3, "The quick brown fox jumps over"),
        (4, None),
        (5, ""),
    ]
    docs = [
        (10, "intro words. Carl Miller has 99 apples and gives Dan Brown 7 apples of them in 4 minutes, how many are left in the basket of Carl Miller? yes"),
        (11, "Carl Miller has 99 apples and gives Carl Miller 7 apples of them in 4 minutes, how many are left in the basket of Erik Brown"),
        (12, items[0][1].lower()),
        (13, "so what is the answer"),
        (14, "and the quick brown fox jumps over it"),
        (15, None),
        (16, ""),
        (17, "An entirely different text about the weather in the northern parts of the country " * 50),
        (12, items[0][1].upper() + " and lower"),
        (18, "word " * 40_000 + items[0][1]),
    ]
    found = templates.contaminated(table_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["changed"]) for r in found} == {(10, 1, True), (12, 1, False), (14, 3, False), (18, 1, False)}
    assert templates.contaminated(nothing, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert templates.contaminated(table_of(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_verbatim_windows_count_beside_conflicting_slots(spark):
    tail = "when the old mill by the river was sold to a farmer who grew barley and rye on the wide southern fields"
    item = f"Founded 2010 by nobody but lost again near 2010 {tail}, said Maria after Pedro had left"
    docs = [(1, item.replace("near 2010", "near 2011")), (2, item.replace("Pedro", "Maria")), (3, item), (4, item.replace("2010", "2012"))]
    docs.append((5, "Founded 2010 by nobody but lost again near 2011"))
    found = templates.contaminated(table_of(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["changed"]) for r in found} == {(1, False), (2, False), (3, False), (4, True)}


def test_wording_of_few_literals_and_without_blanks_is_found(spark):
    items = [
        (1, "Calculate 15 + 27 - 8 * 3 + 144 / 12"),
        (2, "12 kg 7 lb 3 oz 40 g 9 mg"),
        (3, "中国的首都是哪一座城市请从下面四个选项中选择正确的答案"),
        (4, "日本で一番高い山の名前は何ですか"),
        (5, "เมืองหลวงของประเทศไทยคือเมืองอะไร"),
    ]
    docs = [(i, f"{'前の文章' if i > 2 else 'before '}{t}{'後' if i > 2 else ' after'}") for i, t in items]
    docs += [(10, items[0][1].replace("144", "145")), (11, items[1][1].replace("7 lb", "8 lb")), (12, "他们昨天去了河边看见许多白色的鸟"), (13, "เมื่อวานนี้ฝนตกหนักมากในภาคเหนือ")]
    found = templates.contaminated(table_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["changed"]) for r in found} == {(i, i, False) for i, _ in items}
    assert templates.TOKEN.findall("ที่ 日本語 don't 3,5 km") == ["ที่", "日", "本", "語", "don't", "3,5", "km"]


def test_templates_find_all_verbatim_items(spark):
    folder = "/root/testdata/sf0.01"
    plain = lambda t: " " + " ".join(x.lower() for x in templates.TOKEN.findall(t or "")) + " "
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        text = plain(r["text"])
        want |= {(r["doc_id"], i) for i, t in items if t in text}
    got = {(r["doc_id"], r["item_id"]) for r in entry_module.queries()["op4_templates"](spark, folder).collect()}
    assert want and got == want


# near duplicates


def brute_classes(rows, size, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            top[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], [len(s) for s in sets]


def edited(rng, words, rate):
    return " ".join(rng.choice("alpha beta gamma delta".split()) if rng.random() < rate else w for w in words)


def test_near_duplicates_against_brute_force(spark):
    rng, rows = random.Random(4), list(ODD)
    for group in range(12):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.choice([3, 20, 60, 150]))]
        rows += [(100 + 50 * group + k, edited(rng, words, rng.choice([0, 0.01, 0.03, 0.06, 0.1]))) for k in range(25)]
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    rows += [(10_000 + k, edited(rng, words, 0.12 * rng.random())) for k in range(600)]  # several blocks
    df = _kept(spark, table_of(spark, rows))
    in_order = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text", F.monotonically_increasing_id().alias("o")).orderBy("o").collect()]
    for size in (2, 5):
        classes, sizes = brute_classes(in_order, size, 80)
        got = hamming.near_duplicates(df, size=size, block=100).orderBy("at").collect()
        assert [r["n_shingles"] for r in got] == sizes
        place = {r["at"]: i for i, r in enumerate(got)}
        assert [place[r["class_at"]] for r in got] == classes
        low = {}
        for (k, _), c in zip(in_order, classes):
            if k is not None:
                low[c] = min(k, low.get(c, k))
        assert [r["component_id"] for r in got] == [low.get(c) for c in classes]


def test_near_duplicates_of_nothing(nothing):
    assert hamming.near_duplicates(nothing).count() == 0


def test_numbers_outlive_another_split_of_the_input(spark):
    path = shared_folder(spark, "splits")
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=60)), f"u{i}") for i in range(300)]
    rows += [(300 + i, rows[i][1], f"u{300 + i}") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, url string").coalesce(1).write.option("parquet.block.size", 4096).option("maxRecordsPerFile", 40).parquet(path)
    setting = "spark.sql.files.openCostInBytes"
    held = spark.conf.get(setting)
    docs = spark.read.parquet(path)

    def places(df):
        return {r["doc_id"]: r["at"] for r in df.select("at", "doc_id").collect()}

    try:
        table = hamming.numbered(docs)
        before = places(table)
        spark.conf.set(setting, str(1 << 40))
        assert places(docs.withColumn("at", F.monotonically_increasing_id())) != before
        assert places(table.select("*")) == before
        assert places(hamming.near_duplicates(table, at="at")) == before
    finally:
        spark.conf.set(setting, held)


def test_links_beyond_the_threshold_are_found():
    assert hamming.farthest(80) == 24 and hamming.farthest(100) == hamming.THRESHOLD
    # linked sets whose signatures differ in 20 symbols, as a pair and in a group, beside a set that is no link
    rng = np.random.default_rng(3)
    for n, far_rows in ((2, 1), (90, 40)):
        base = np.sort(rng.choice(10**9, 200, False)).astype(np.uint64)
        sets = [base if k < n - far_rows else np.sort(np.concatenate([base[:190], rng.choice(10**9, 3, False).astype(np.uint64)])) for k in range(n)]
        other = np.sort(rng.choice(10**9, 200, False)).astype(np.uint64)
        signs = np.stack([hamming.signature(s) for s in (sets[0], *[sets[0]] * (n - 1), other)])
        for k in range(n - far_rows, n):
            signs[k, rng.choice(hamming.SYMBOLS, 20, False)] ^= np.uint16(k + 1)
        signs[n] = signs[0]
        signs[n, :20] ^= np.uint16(7)
        near, far = hamming._against(signs, signs, hamming.farthest(80))
        top = hamming._joined([(i, j) for i, j in near if i < j], [*sets, other], range(n + 1), 80, [(i, js[js > i]) for i, js in far])
        assert len(set(top[:n].tolist())) == 1 and top[n] not in top[:n]


def test_keys_meet_below_the_threshold():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 65536, hamming.SYMBOLS).astype(np.uint16)
        b = a.copy()
        changed = rng.choice(hamming.SYMBOLS, hamming.THRESHOLD, replace=False)
        b[changed] ^= 1
        keys = hamming.keys_of(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    ids = sorted({v for e in edges for v in e} | {9999})
    got = components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {i: 0 if i <= 200 else 1000 if i < 2000 else i for i in ids}


# language model


def test_language_model(spark, odd, nothing):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for df in (odd, rows):
        scored = lbl.score_texts(df).collect()
        assert len(scored) == df.count()
        tokens = lambda t: (t or "").encode().lower().split() + [b""]
        counts, base = collections.Counter(), []
        texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        is_held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
        for k, t in texts:
            if not is_held(k):
                counts.update(tokens(t))
        n, v = sum(counts.values()), len(counts)
        for k, t in texts:
            words = tokens(t)
            score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
            base.append((k, is_held(k), len(words), sum(counts[w] > 0 for w in words), n, round(score, 6)))
        got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored]
        for a, b in zip(sorted(got, key=str), sorted(base, key=str)):
            assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-7, abs_tol=1e-5)
    held = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.8 * len(held)
    assert lbl.score_texts(nothing).count() == 0


def test_scores_do_not_depend_on_the_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.explode(F.sequence(F.lit(10_000), F.lit(10_150)))))
    got = []
    for n in (3, 11):
        scored = lbl.score_texts(_kept(spark, docs.repartition(n, F.rand(n))), common=200).collect()  # most words are rare
        got.append(sorted(map(tuple, scored)))
    assert len(got[0]) > 500 and got[0] == got[1]


def test_training_runs_keep_every_text(spark):
    texts = [b"ab", b"cd", b"", b"ab"] + [b"xyxy"] * 300
    runs = lbl.training_runs(spark.createDataFrame([(t,) for t in texts], "kinds binary"), 5, 4).collect()
    counted = collections.Counter()
    for r in runs:
        assert 0 <= r["turn"] < 4 and 0 <= r["lane"] < 5 and 0 < r["n_times"] <= 64
        counted[bytes(r["kinds"])] += r["n_times"]
    assert counted == collections.Counter(texts)


def test_model_probabilities_sum_to_one(spark):
    model = lbl.LogBilinear(np.array([5.0, 3.0, 1.0, 0.0]))
    w = np.random.default_rng(0).integers(0, 4, 4096)
    lbl.NoiseContrastive(model, 1).batch(w, np.roll(w, 1), np.roll(w, 2))
    norm = lbl.log_normalisers(spark, model)
    last, second = model.products()
    for a, b in itertools.product(range(5), repeat=2):
        assert math.isclose(np.exp(last[a] + second[b] + model.b - norm[a, b]).sum(), 1, rel_tol=1e-4)


# archives


def test_warc(spark):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/ 4\r\n", ""), (5, "u", "ü" * 200_000), (2, "http://a/2", "<p>x</p>"), (7, "u7", "<p>x</p>")]
    df = _kept(spark, spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("at", F.lit(1)))
    folder = warc.write_warc(df, shared_folder(spark, "warc"), roll=300, parts=3)
    rows = warc.read_warc(spark, folder).collect()
    top = {}
    for k, _, h in pages:
        top[h or ""] = max(k, top.get(h or "", k))
    want = []
    for k, _, h in pages:
        data = (h or "").encode()
        first = top[h or ""] == k
        want.append((k, len(data), warc.base32_sha1(data), "response" if first else "revisit", None if first else top[h or ""], data if first else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    files = spark.read.parquet(f"{folder}/manifest").orderBy("file").collect()
    assert len(files) > 3 and sum(f["n_records"] for f in files) == len(pages)
    again = warc.write_warc(df, shared_folder(spark, "warc"), roll=300, parts=3)
    data = lambda at: [(r["path"].rsplit("/", 1)[1], bytes(r["content"])) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(at).orderBy("path").collect()]
    assert data(folder) == data(again)
    none = warc.write_warc(df.where("page_id < 0"), shared_folder(spark, "warc"))
    assert warc.read_warc(spark, none).count() == 0


def test_pages_without_an_id_are_archived(spark):
    """They never are the response another record refers to, unless nothing with an id is equal."""
    pages = [(None, "a", "x"), (None, "b", "y"), (4, "c", "x"), (None, None, None), (3, "d", "x"), (None, "b", "y"), (None, "e", "z")]
    df = _kept(spark, spark.createDataFrame(pages, "page_id long, url string, html string"))
    folders = [warc.write_warc(frame, shared_folder(spark, "warc"), parts=2) for frame in (df, df.where("page_id IS NULL"))]
    rows = [[(r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, f).collect()] for f in folders]
    want = [
        (None, "a", 1, "revisit", 4), (None, "b", 1, "response", None), (4, "c", 1, "response", None), (None, None, 0, "response", None),
        (3, "d", 1, "revisit", 4), (None, "b", 1, "response", None), (None, "e", 1, "response", None),
    ]
    assert sorted(rows[0], key=str) == sorted(want, key=str)
    assert sorted(rows[1], key=str) == sorted([(k, u, n, "response", None) for k, u, n, *_ in want if k is None], key=str)


def test_small_payloads_stay_responses(spark):
    df = _kept(spark, spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string"))
    rows = warc.read_warc(spark, warc.write_warc(df, shared_folder(spark, "warc"), least=3)).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in rows) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


# top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), None if i % 17 == 3 else rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(230)]
    rows += [(300, [float("nan")] * 6), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("inf")] * 6), (400, [1.0, 2.0]), (500, []), (100, rows[100][1]), (600, [3e15] * 6), (601, [4e15] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    good = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k in sorted({k for k, _ in good if k % 100 == 0}):
        q = next(v for i, v in good if i == k)
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), i) for i, v in good if i != k)
        want += [(k, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    for block in (4096, 2):
        assert sorted(map(tuple, topk.top_k(df, block=block).collect())) == want
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


# licenses


def test_licenses(spark, nothing):
    rows = [
        (1, "Released UNDER THE MIT-License. under the mit license"),
        (2, "apache license, version 2; Licensed under CC BY-NC 4.0"),
        (3, None),
        (4, ""),
        (5, "under the mité license; mit license under the"),
        (6, "x " * 50_000 + "This work is licensed under the GNU General Public License, version 3."),
        (7, "under the mit Åicense and under the mit licenſe"),
        (7, "cc by nc cc by nc"),
    ]
    got = licenses.license_report(licenses.scan_licenses(table_of(spark, rows))).collect()
    want = {
        (1, 9, 2, 1, 5, "mit", "mit", 1.0),
        (2, 11, 2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 1.0),
        (3, 0, 0, None, None, "", "", 0.0),
        (4, 0, 0, None, None, "", "", 0.0),
        (5, 8, 0, None, None, "", "", 0.0),
        (6, 50_012, 0, None, None, "", "gpl-3", 1.0),
        (7, 9, 0, None, None, "", "", 0.0),
        (7, 6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 3 / 7),
    }
    rounded = {(*r[:7], round(r[7], 9)) for r in map(tuple, got)}
    assert {r[:7] for r in rounded} == {r[:7] for r in want}
    assert {r for r in rounded if r[0] == 6} == {r for r in want if r[0] == 6}
    assert licenses.license_report(licenses.scan_licenses(nothing)).count() == 0


NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights""",
    "apache-2": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.""",
    "gpl-2": """This program is free software; you can redistribute it and/or modify it under the terms of the
// GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or""",
    "gpl-3": """it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "agpl-3": """GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License""",
    "bsd,bsd-3": """Redistribution and use in source and binary forms, with or without modification, are permitted.
 Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
 derived from this software without specific prior written permission.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
 granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_standard_notices(spark):
    """Whole notices have their label; without one mandatory word, or with a word more between the phrases, they have none."""
    rows = [(i, text) for i, text in enumerate(NOTICES.values())]
    far = NOTICES["gpl-3"].replace("either version", "in either version")
    spoilt = [(100, NOTICES["mit"].replace("without restriction", "with restriction")), (101, far), (102, NOTICES["unlicense"].replace("and", "or"))]
    df = table_of(spark, rows + spoilt)
    for frame in (df, df.where("doc_id IN (3, 101)"), df.unionByName(table_of(spark, [(200 + i, "gnu affero unencumbered fee restriction") for i in range(20)]))):
        got = {r["doc_id"]: r for r in licenses.license_report(licenses.scan_licenses(frame)).collect()}
        for i, label in enumerate(NOTICES):
            assert i not in got or got[i]["labels"] == label
        assert all(r["labels"] == "" and r["score"] == 0 for k, r in got.items() if k >= 100)
    assert got[7]["score"] == 1 and 0.5 < got[3]["score"] < 1 and got[1]["base_labels"] == "apache-2"


def test_license_scan_stays_in_the_jvm(documents):
    plan = licenses.license_report(licenses.scan_licenses(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
