"""The corpus pipeline against plain Python on a small corpus."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gritsieve.llm import templates
from gritsieve.llm.common import find_package
from gritsieve.llm.langid import predict, train
from test_llm_operators import PATH, brute_classes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with null, empty and letterless texts, repeated rows and an extra column."""
    find_package(spark)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(100_000, None), (100_001, ""), (100_002, "12 34 --"), (100_003, "the and with the"), (100_003, "the and with the")], "doc_id long, text string")
    odd = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("odd").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.unionByName(odd).withColumn("at", F.lit("clash")).repartition(4, "doc_id").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    told = predict(docs, train(docs)).select("doc_id", "text", "lang_pred", "score", F.monotonically_increasing_id().alias("o")).orderBy("o").collect()
    rows = [(r["doc_id"], r["text"]) for r in told if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE]
    assert {100_000, 100_001, 100_002}.isdisjoint(k for k, _ in rows)
    assert len(rows) >= 200
    classes, _ = brute_classes(rows, 5, 80)
    assert len(set(classes)) < len(rows)
    plain = lambda t: " " + " ".join(x.lower() for x in templates.TOKEN.findall(t or "")) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    leaks = lambda t: any(i in plain(t) for i in items)
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for c in sorted(set(classes)):
        members = [rows[i] for i in range(len(rows)) if classes[i] == c]
        kept = [(k, t) for k, t in members if not leaks(t)]
        want.append((members, kept))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, corpus).collect()}
    chosen = 0
    for members, kept in want:
        held = [(k, t) for k, t in members if k in got]
        assert len({k for k, _ in held}) <= 1 and (held or len(kept) < len(members))
        for k, t in held[:1]:
            chosen += 1
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            r = got[k]
            assert not leaks(t) and r["n_tokens"] == len(ids) and bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
            assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert chosen == len(got)


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus).columns == docs.columns
    nothing = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, corpus).count() == 0


def test_leaks_are_rows(spark, corpus):
    """A leaking row goes whatever its doc_id; clean rows that share the doc_id stay."""
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, f"see {item} here"), (None, "a clean row"), (7, item), (7, "another clean row"), (7, "another clean row"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit("clash")).repartition(3)
    kept = corpus_pipeline.benchmark_leaks(spark, docs, corpus).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
