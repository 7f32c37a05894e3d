"""From raw documents to packed training sequences: language ID, line dedup, near dedup, mixing, packing.

Each stage reads what its predecessor kept, as Parquet. Choices that the operators leave open: language ID rejects
texts without a letter and those that are longer by REJECTED bits with the languages than as bytes without context; a line found in ten or more documents stays in
one of them; near copies share 80 % of their five-word shingles and one row stays, of the least doc_id; the mix repeats no
document more than three times, and a document that a source's target cuts keeps its first words.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageloom.llm import jaccard, langid, lines, mixing, packing
from pageloom.llm.common import delete_shared, shared_dir

REJECTED = 64  # odds of 2 ** 64 against


def _with_others(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that none meets a name that an operator uses."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(out: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    return out.select(*[(own[c] if c in own else F.col("row")[c]).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter unless the evidence is against all languages, each stretch of a text being in any of them.

    A short text never gathers that much, so it stays. Null and empty texts go; repeated rows stay or go together; an
    empty table stays empty; without any lang to learn from nothing is kept. Columns of any name pass unchanged.
    """
    model = langid.train(langid.training_rows(docs))
    out = langid.predict(_with_others(docs), model).where((F.col("lang_pred") != "und") & (F.col("gain") > -REJECTED))
    return _unpacked(out, docs.columns, text=F.col("text"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines repeated in ten documents or more, but for one; a document of which nothing else is left goes.

    Null texts and texts without such a line stay as they are; an empty table stays empty. Columns of any name pass unchanged.
    """
    out = lines.drop_repeated_lines(_with_others(docs), min_docs=10, keep_first=True).where("n_dropped = 0 or kept_text rlike '[^ \\\\t\\\\n\\\\x0b\\\\f\\\\r]'")
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _unpacked(out, docs.columns, text=text, n_chars=F.length(text).cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of the least doc_id, then of the least hash, then one of equal rows.

    Rows without words are in no group and stay; an empty table stays empty. Columns of any name pass unchanged.
    """
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.select("doc_id", "text", F.struct(*columns).alias("row"), F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("_row"))
    rows = jaccard.jaccard_components(keyed, words=5, percent=80, row="_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    one = rows.where("component is not null").groupBy("component").agg(F.min_by("_row", order).alias("_row")).select("_row", F.lit(True).alias("_one"))
    kept = keyed.select("row", "_row").join(one.union(rows.where("component is null").select("_row", F.lit(False)).distinct()), "_row")
    return kept.withColumn("_n", F.row_number().over(W.partitionBy("_row").orderBy("_row"))).where("_n = 1 or not _one").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document that the mix takes words of, in the order of the mix."""
    return mixing.mixed(docs, weights=(1, 2, 3), most=3).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete_shared(spark, f"{base}/{k - 1}")
    return docs
