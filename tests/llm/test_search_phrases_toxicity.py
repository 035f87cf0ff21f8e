"""Lexical search, collocations and toxicity on small tables against brute force and planted cases."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from gritsieve.llm import collocations, langid, lexical, topk, toxicity
from gritsieve.llm.common import find_package

FOLDER = "/root/testdata/sf0.01"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "toxic wort, " * 40_000


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    find_package(spark)


def with_clashes(df, *names):
    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


# ranked lexical search


def ranked_by_hand(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UPPER))
    rows = [(i, collections.Counter(split(t))) for i, t in docs if t is not None]
    rows = [(i, c, c.total()) for i, c in rows if c]
    nd, nt = len(rows), sum(n for _, _, n in rows)
    df = collections.Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        terms = set(split(text)) if text is not None else set()
        found = []
        for i, c, n in rows:
            m = 10 + 90 * n * nd // nt
            score = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, r + 1, f[2], f[3]) for r, f in enumerate(found[:k])]
    return sorted(out, key=str)


def random_docs(seed, n, words, most):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 3 else f"É{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, most)))) for i in range(n)]


@pytest.mark.parametrize("block,postings,seeds", [(1, 40, 10), (4, 300, 20), (16, 1 << 20, 4096)])
def test_search_equals_brute_force_at_every_blocking(spark, block, postings, seeds):
    docs = random_docs(5, 300, 120, 60)
    docs += [(1000 + i, docs[7][1]) for i in range(25)]  # ties of equal texts
    docs += [(None, docs[9][1]), (None, docs[9][1]), (3, docs[11][1]), (400, None), (401, ""), (402, "-- ?? \x01"), (403, "A w3 " * 5000)]
    items = [(i, t[:80]) for i, t in docs[:40]] + [(1, "w1 w2"), (1, "w3 w4"), (None, "w5"), (98, None), (99, "unheard of"), (97, "")]
    left = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"), "rank", "score", "q", "terms", "n", "words")
    right = with_clashes(spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item", "b", "score")
    found = lexical.rank_documents(left, right, block=block, postings=postings, seeds=seeds, block_items=20 if block == 4 else 1 << 14)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranked_by_hand(docs, items)


def test_search_skips_blocks_and_keeps_the_best():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 12, 400)
    terms = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in lengths])
    values = rng.integers(1, 1_000_000, len(terms)).astype(np.int64)
    segment = lexical.Segment(lengths, terms, values, 50, 4)
    ids, none = np.arange(400), np.zeros(400, bool)
    scored = []
    exact = lexical.Segment.scores
    lexical.Segment.scores = lambda self, docs: scored.append(len(docs)) or exact(self, docs)
    try:
        asked, weights = np.array([1, 5, 9, 20, 33]), np.array([900, 40, 30, 20, 1])
        best = lexical.Best(10).within(ids, none)
        segment.search(asked, weights, best, 0)
    finally:
        lexical.Segment.scores = exact
    full = np.zeros(400, np.int64)
    weight = np.zeros(50, np.int64)
    weight[asked] = weights
    np.add.at(full, np.repeat(np.arange(400), lengths), values * weight[terms])
    order = np.lexsort((ids, -full))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == full[order].tolist()
    assert sum(scored) < np.count_nonzero(full) / 2
    for blocks in segment.built.values():  # a summary bounds each of its members
        for b, (at, n) in enumerate(zip(blocks.starts.tolist(), blocks.sizes.tolist())):
            assert blocks.bounds(asked, weights)[b] >= full[blocks.docs[at : at + n]].max()


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank_documents(docs, items).collect() == []
    assert lexical.rank_documents(items.toDF("doc_id", "text"), docs.toDF("item_id", "text")).collect() == []


# collocations


def phrases_by_hand(docs, least):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            holders = [q for q in cands if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * cands[q] >= 80 * a for q in holders):
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:2000])]
    return sorted(out)


PHRASES = [
    ("en", "The cat sat. the CAT sat\tdown, the cat sat down!\n" * 12),
    ("en", "a a a a a a a a " * 5),
    (None, "le chat noir; le chat blanc: " * 20),
    ("und", "le chat noir\x0ble chat\x0cnoir\r" * 20),
    ("de", None),
    ("de", ""),
    ("de", " \t ,.;:!? "),
    ("fr", "ÉTÉ chaud été chaud \x1c\xa0x " * 15),
    ("es", LONG),
]


@pytest.mark.parametrize("run_rows,share", [(1 << 21, 1 / 4096), (3, 1 / 4096), (1 << 21, 0.02), (5, 0.3)])
def test_collocations_equal_brute_force(spark, run_rows, share):
    docs = PHRASES + [(lang, t) for (_, t), lang in zip(random_docs(8, 200, 40, 80), itertools.cycle(["en", "fr", None]))]
    df = with_clashes(spark.createDataFrame(docs, "lang string, text string"), "n", "phrase", "len", "rank", "score", "route", "k")
    found = collocations.collocations(df, least=10, run_rows=run_rows, share=share)
    assert sorted(map(tuple, found.collect())) == phrases_by_hand(docs, 10)


def test_quicksort_counts_every_frequent_prefix():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.5, 4000) % 30
    rows = collocations.suffixes(ids)
    merged, counts = collocations.merged(rows, np.ones(len(rows), np.int64), 30)
    assert counts.sum() == len(rows) == np.count_nonzero(ids)
    for least in (1, 7, 100):
        want = collections.Counter(tuple(r[:k].tolist()) for r in rows for k in range(1, 5) if r[k - 1])
        assert dict(collocations.frequent_prefixes(merged, counts, least)) == {p: n for p, n in want.items() if n >= least}


def test_collocations_of_nothing_and_scores_beyond_64_bits(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    big = 2**62
    counts = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big), ("x", "a b", 2, big)], "lang string, phrase string, len int, n long")
    assert collocations.scored_phrases(counts).first()["score"] == 1_000_000


def test_heavy_words_are_routed_by_more_words(spark):
    texts = spark.createDataFrame([("en", bytearray(b"the " + b" ".join(b"w%d" % (i * j % 97) for j in range(9)))) for i in range(400)], "lang string, text binary")
    heavy = collocations.heavy_prefixes(texts, 1 << 20, 1 << 20, 0.05)
    assert heavy["en"] >= {b"the"}
    rows = collocations.packed_suffixes(texts, heavy, 64).where("ids IS NOT NULL")
    led = set()
    for r in rows.collect():
        words = r["words"].split(b"\n")
        lead = np.frombuffer(r["ids"], "<u2").reshape(4, -1)[0]
        led |= {r["route"] for i in set(lead.tolist()) if words[i - 1] == b"the"}
    assert len(led) > 10


# toxicity


def segments_by_hand(scores):
    """Maximal segments by their definition: the best one (shortest of equals, then first), then those left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or (s, a - b, -a) > (best[2], best[0] - best[1], -best[0])):
                best = (a, b - 1, s)
    if best is None:
        return []
    a, b, s = best
    return segments_by_hand(scores[:a]) + [best] + [(x + b + 1, y + b + 1, z) for x, y, z in segments_by_hand(scores[b + 1 :])]


def test_segments_equal_their_definition():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-7, -5, -3, -2, 1, 2, 3, 4, 11]) * 1.0 + rng.random() / 8 for _ in range(rng.randrange(0, 14))]
        totals = [0.0, *itertools.accumulate(scores)]
        gains = ((i, totals[i], totals[i + 1]) for i, s in enumerate(scores) if s > 0)
        found = toxicity.segments(gains)
        want = segments_by_hand(scores)
        assert [f[:2] for f in found] == [w[:2] for w in want]
        assert [f[2] for f in found] == pytest.approx([w[2] for w in want])


def test_decay_solves_its_equation():
    chances, scores = np.array([0.001, 0.01, 0.989]), np.array([5.9, 2.0, -0.25])
    decay = toxicity.decay_of(chances, scores)
    assert decay > 0 and (chances * np.exp(decay * scores)).sum() == pytest.approx(1)


def planted(n=1200):
    rng = random.Random(9)
    plain = [f"wort{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 200))
        toxic = i % 8 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["Schurke", "Lump", "Halunke"], k=3)
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxic_passages(spark):
    docs, labels = planted()
    labels += [(None, 1), (5, None), (7, 3), (99999, 1), (8, 0), (8, 1)]
    docs += [(None, "ohne lump"), (5000, None), (5001, ""), (5002, "12 -- 3"), (5003, "lump " * 50_000), (5004, "İ Lump schurke!"), (5004, "İ Lump schurke!")]
    rows = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"), "score", "passages", "k", "y", "part", "n")
    marks = with_clashes(spark.createDataFrame(labels, "doc_id long, toxic int"), "text", "score", "y")
    model = toxicity.train(rows, marks)
    told = toxicity.toxicity(rows, model)
    assert sorted(told.columns) == sorted(rows.columns)
    found = collections.defaultdict(list)
    for r in told.collect():
        found[r["doc_id"]].append(r)
    texts = dict(docs[:1200])
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((found[i][0]["score"] >= 0.3) == (i % 8 == 0) for i in held)
    for i in (8, 16, 800):
        (p,) = found[i][0]["passages"]
        assert re.fullmatch(r"(\w+ ){2}\w+", texts[i][p["start"] : p["end"]]) and {*texts[i][p["start"] : p["end"]].split()} <= {"Schurke", "Lump", "Halunke"}
    quiet = found[5000][0]["score"]
    assert quiet == found[5001][0]["score"] == found[5002][0]["score"] < 0.1 and found[5000][0]["passages"] == []
    assert found[5003][0]["score"] > 0.9
    one, two = found[5004]
    assert one == two and "İ Lump schurke!"[one["passages"][0]["start"] : one["passages"][0]["end"]] == "Lump schurke"
    assert all(r["k"] == "clash" for r in found[5000])


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 1e-9 for r in toxicity.toxicity(docs, toxicity.train(docs, none)).collect())
    assert toxicity.toxicity(docs.limit(0), toxicity.train(docs.limit(0), none)).collect() == []


def test_toxicity_of_held_out_documents(spark):
    told = entry_module.queries()["op12_toxic_segments"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert told.count() == docs.count() and told.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = told.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] == r["toxic"] for r in rows)
    assert hits >= 0.93 * len(rows)


def test_each_vector_of_a_repeated_query_id_is_answered(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [5.0, 1.0]), (3, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (1, 4096):
        found = sorted(map(tuple, topk.top_k(df, k=2, block=block).collect()))
        first, second = [(100, 1, 2, 5 * 1024**2), (100, 2, 1, 2 * 1024**2)], [(100, 1, 1, 3 * 1024**2), (100, 2, 2, 1024**2)]
        assert found == sorted(first + second)


def test_a_row_without_key_is_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "ein text", "de", "s", 8), (5, None, "en", "s", 0), (6, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = entry_module.queries()["op3_byte_cnn"](spark, str(tmp_path)).collect()
    assert len(found) == 3 and all(r["held_out"] in (True, False) for r in found)
    assert not next(r["held_out"] for r in found if r["doc_id"] is None)
