"""Registered queries against their SQL, and the pipeline against plain Python."""

import public_tokenizers
import pytest
from oracle_check import database, difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from test_decontaminate import brute as passages
from test_ngram_join import brute as groups
from wardflow.llm import language, quality
from wardflow.llm.queries import ORACLES, QUERIES


def test_all_are_registered():
    import __spark_entry__ as e
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert difference(QUERIES[name](spark, SMALL), database(SMALL), ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op6_licence_scan", "op7_decontamination"])
def test_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    spoken = language.identify(docs, language.train(docs)).filter("lang_pred <> 'und' AND score >= 0.3").select(docs.columns)
    good = quality.score(spoken, quality.train(spoken, labels)).filter("predicted = 1").select("doc_id", "text").collect()
    same = groups([(r.doc_id, r.text) for r in good], 5, 80, 100)
    first = [(r.doc_id, r.text) for r in good if same[r.doc_id][1] == r.doc_id]
    from wardflow.llm.decontaminate import words
    leaks = {d for d, _ in passages({i: [w.decode() for w in words(t.encode())] for i, t in items.items()}, first)}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: lib.encode(t, add_special_tokens=False).ids for d, t in first if d not in leaks}
    got = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id: r.ids for r in got.collect()} == want and got.filter(~F.col("restored")).count() == 0


def test_pipeline_on_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
