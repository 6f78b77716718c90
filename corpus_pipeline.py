"""The text-corpus pipeline: documents through five stages, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
what it keeps.  All stages but the last return the columns of ``documents``; the last
returns one row per packed piece.  SQL cannot express them (hashed statistics, trained
models, packing), so the tests hold each stage against a plain version.

Cases: a null, empty or wordless text has fewer than ten words and goes with the quality
rules; texts of any length are read whole in every stage; a document as toxic as the
threshold goes, one as good as the threshold of the quality rules stays; of rows that are
repeated, or near copies, the first by id stays; a null id, language or source is kept and
is a value of its own; other columns, whatever their names, pass all stages but the last;
an empty table of documents gives no rows, an empty table of labels rejects nothing as
toxic and leaves the likelihood ratios near 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import jaccard, mixing, packing, quality_rules, toxicity
from quillon.llm.common import delete, give_back, read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels, does not reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood ratio."""
    return quality_rules.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in the order of training."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's table is removed when the next is there, but the one that the result reads."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, at = written(docs, f"stage{k}")
            if before is not None:
                delete(spark, before)
            before = at
            give_back(spark)
    return docs
