"""A corpus from raw documents to packed sequences: each stage reads the rows that its predecessor wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoyspark.llm import jaccard, lines, mixing, packing, toxicity
from convoyspark.llm.queries import table, tokenizer_path
from convoyspark.llm.shared import ship, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labels of rows that are not held out."""
    ship(spark)
    return toxicity.clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many pages of a source share go out of the texts; no document goes."""
    ship(spark)
    kept = lines.deduplicated(docs.select(*COLUMNS), site="source", ratio=0.05, least_pages=5)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, in one row. Documents without an id or without words
    are in no group and stay."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = stored(jaccard.similar(docs, words=5, percent=75).filter("doc_id IS NOT NULL AND n_shingles > 0"), "groups")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    apart, repeated = stored(gone.union(repeated), "copies"), stored(repeated, "repeated")
    once = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return docs.join(apart, "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select("doc_id", "row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    ship(spark)
    return mixing.mixed(docs.select(*COLUMNS), weights=(5, 2, 1), share=1.5, most=2.0, seed=7)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
