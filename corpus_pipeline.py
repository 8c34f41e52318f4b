"""From raw documents to token ids in five stages.

Each stage works on all that its predecessor kept; `run` writes what a stage returns as Parquet to the
shared folder and reads it back for the next one.

Defined results, whatever the other columns are called (all but the last stage return the columns of their
input): a text that is null, empty or without a letter has no language and goes with the first stage; a text of any
length is read whole; a null doc_id is a document like any other, except that it links with nothing, so it stays among
near duplicates; of a group of near duplicates the smallest doc_id stays, with all rows that have this id; rows that
are equal throughout are kept or dropped alike. An empty table passes through as an empty table. Where no language or
no quality can be learned (no labelled row outside the held-out ones), that stage keeps every document.
"""

import public_tokenizers
from pyspark.sql import functions as F

from wardflow.llm import bpe, decontaminate, language, ngram_join, quality
from wardflow.session import staged

VOCABULARY = "byte_bpe_50k.json"


def language_id(spark, docs, sf_dir):
    """Documents in a language that is known; those without letters, or that fit no language, go."""
    return language.in_known_languages(docs, language.train(docs))


def quality_filter(spark, docs, sf_dir):
    """Documents whose predicted quality is good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.of_good_quality(docs, quality.train(docs, labels))


def near_duplicates(spark, docs, sf_dir):
    """The first document of each group whose five-word shingles agree by 0.8 or more."""
    return ngram_join.one_of_each_group(docs, size=5, num=80, den=100)


def decontamination(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark, docs, sf_dir):
    """Ids of every text, and whether they decode to it: doc_id, lang, source, n_tokens, ids, restored."""
    path = public_tokenizers.path(VOCABULARY)
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, ids="ids")
    rows = bpe.decode(rows, path, ids="ids", text="decoded")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"))


STAGES = [("language_id", language_id), ("quality", quality_filter), ("ngram_jaccard_join", near_duplicates),
          ("decontamination", decontamination), ("bpe", tokens)]

ORACLE_SQL = None  # fitted models decide in two stages; see tests/llm for the brute-force version


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
