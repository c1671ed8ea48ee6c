"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

The stages are: reject low quality, keep one of each group of near-duplicates, drop documents
that hold benchmark items, replace personal data by pseudonyms, and pack what is left into
sequences. Each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, packing, pii, quality, simhash
from .queries import pii_key, tokenizer_path


def _carried(docs: DataFrame) -> DataFrame:
    """The text, and every other column inside one, so that no name can clash with an operator's."""
    others = [docs[c].alias(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(F.lit(0).alias(""), *others).alias("_row"), docs["text"].cast("string").alias("text"))


def _restored(df: DataFrame, like: DataFrame, **new) -> DataFrame:
    """The columns of ``like``, some of them new."""
    return df.select(*[new.get(c, F.col("text") if c == "text" else F.col("_row")[c]).cast(like.schema[c].dataType).alias(c) for c in like.columns])


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of grade 1 or better is a half or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.grades_of(labels))
    carried = _carried(docs)
    return _restored(quality.grade_documents(carried, model, keep=carried.columns).where("selected"), docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of five-word similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated_texts(docs, benchmark)
    return decontamination.clean(docs, found)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars`` follows the new text."""
    done = pii.pseudonymize(_carried(docs), pii_key(spark))
    length = F.when(F.col("text").isNotNull(), F.length("text"))
    return _restored(done, docs, n_chars=length)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", _quality),
    ("SimHash near-dedup", _near_duplicates),
    ("benchmark decontamination", _decontaminate),
    ("PII", _pii),
    ("best-fit packing", _pack),
]

#: SQL can express neither the model, nor XXH64, nor the tokenizer; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
