"""From raw documents to packed training sequences: five stages, each one of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from credsieve.llm import fuzzy_lines, minhash, mixing, packing, quality
from credsieve.llm.common import stash, table
from credsieve.llm.queries import tokenizer_path


# Keys from here on are those of further texts under an id.
OTHER_TEXTS = 1 << 62


def whole(docs: DataFrame) -> Column:
    """The document as one column, out of the way of what an operator adds."""
    return F.struct(*docs.columns).alias("__doc")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    book = quality.ledger(docs.select(whole(docs), "text"), "text")
    return book.filter(quality.passes(quality.CURRENT)).select("__doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or line, has already; ``n_chars`` follows.

    Every document stays. One whose lines all stand elsewhere is left as an empty text.
    """
    deduped = fuzzy_lines.dedup_lines(docs.select(whole(docs), "doc_id", "text"), "doc_id", "text")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("__doc.n_chars"))
    doc = F.col("__doc").withField("text", F.col("text")).withField("n_chars", length)
    return deduped.select(doc.alias("__doc")).select("__doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows that share an id and a text are one document. Rows that share an id only are compared like
    any others: all but one of their texts get a key above all ids. Rows without an id stay.
    """
    version = F.xxhash64("text")
    texts = docs.groupBy("doc_id").agg(F.min(version).alias("__least"), F.max(version).alias("__most"))
    shared = stash(texts.filter(F.col("__least") != F.col("__most")).select("doc_id", "__least"), "shared-ids")
    named = docs.select(whole(docs), "doc_id", "text").filter(F.col("doc_id").isNotNull()).join(shared, "doc_id", "left")
    other = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(OTHER_TEXTS - 1)).bitwiseOR(F.lit(OTHER_TEXTS))
    key = F.when(F.col("__least").isNull() | (version == F.col("__least")), F.col("doc_id").cast("long")).otherwise(other)
    named = named.select("__doc", key.alias("__key"), "text")
    kept = minhash.near_duplicates(named, "__key", "text").filter("kept").select("__key").distinct()
    place = F.row_number().over(W.partitionBy("__key").orderBy("__doc"))
    first = named.join(kept, "__key", "left_semi").withColumn("__place", place).filter(F.col("__place") == 1)
    return first.select("__doc.*").union(docs.filter(F.col("doc_id").isNull()))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two rows."""
    sized = docs.select(whole(docs), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(sized, "doc_id", "source", "size")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.filter(F.col("copies") > 0).select("__doc", times).select("__doc.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

# SQL has neither edit-verified line groups nor MinHash links nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
