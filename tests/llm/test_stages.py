"""The pipeline's filtering stages on rows with nulls, repeats and columns named as they name their own."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL

CLASHES = ["_language", "_language_score", "_quality", "_good", "_gone", "lang_pred", "score", "predicted", "component_id", "_GONE_"]


@pytest.fixture(scope="module")
def docs(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    rnd = random.Random(2)
    long = " ".join(rnd.choices(["the", "house", "river", "was", "quiet", "and", "green"], k=60_000))
    first = known.filter("lang = 'en'").orderBy(F.length("text").desc()).first()
    rows = [(900_001, None, "en", "s", None), (900_002, "", None, None, 0), (None, first.text, "en", "s", 1), (900_003, long, "en", "s", len(long)),
            (900_004, first.text, "en", "s", 1), (900_004, first.text, "en", "s", 1), (900_005, "12 34 !!", "en", "s", 8)]
    return known.unionByName(spark.createDataFrame(rows, known.schema))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_clashing_columns_change_nothing(spark, docs, name, stage):
    marked = docs.withColumns({c: F.lit("mine") for c in CLASHES})
    plain, got = stage(spark, docs, SMALL), stage(spark, marked, SMALL)
    assert got.columns == marked.columns and plain.columns == docs.columns
    assert got.filter(" OR ".join(f"`{c}` <> 'mine'" for c in CLASHES if c != "_GONE_")).count() == 0
    key = ["doc_id", F.xxhash64("text").alias("t"), "lang", "source"]
    assert sorted(map(tuple, got.select(key).collect()), key=repr) == sorted(map(tuple, plain.select(key).collect()), key=repr)
    kept = [r.doc_id for r in plain.select("doc_id").collect()]
    if name == "language_id":  # without letters there is no language
        assert not {900_001, 900_002, 900_005} & set(kept) and kept.count(900_004) == 2 and None in kept and 900_003 in kept
    if name == "ngram_jaccard_join":  # the smallest doc_id of a group stays, with its repeats; a null doc_id stays
        assert 900_004 not in kept and None in kept and {900_001, 900_002, 900_005} <= set(kept)
