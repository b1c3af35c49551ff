"""From raw documents to training rows: five stages, each one operator of ``graphloom.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps; its result is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the columns of
``documents``. Every stage works on all rows it is given.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from graphloom.llm import bpe, icws, mixing, outliers, ppm
from graphloom.llm.queries import tokenizer_path
from graphloom.session import materialize, scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, which tells rows apart by id and content."""
    hashed = [f.name for f in docs.schema if not isinstance(f.dataType, MapType)]  # maps have no hash
    return docs.withColumn("row_key", F.struct("doc_id", F.xxhash64(*hashed).alias("h")))


def _extra_columns_aside(stage):
    """A stage works on the columns of ``documents``; others travel under names that no operator
    uses and come back as they were."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
        aside = {c: c if c in COLUMNS else f"extra_column_{i}" for i, c in enumerate(docs.columns)}
        kept = stage(spark, docs.select(*[quoted(c).alias(a) for c, a in aside.items()]), sf_dir)
        return kept.select(*[F.col(a).alias(c) for c, a in aside.items()])

    return run


@_extra_columns_aside
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known: null or empty text, or text without a letter, goes.
    Texts of any length are read whole; repeated rows are judged alike."""
    return ppm.identify(docs).filter(F.col("lang_pred") != ppm.UNKNOWN).select(*docs.columns)


@_extra_columns_aside
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the base rules and the outlier distance keep; null and empty texts go,
    as they have under twenty words."""
    return outliers.keep(docs)


@_extra_columns_aside
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates; of rows that share id and text one stays.

    Classes are of texts, so a row is judged by its id and text: another text of the same id has its
    own class. Rows without an id are kept.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    keyed = docs.withColumn("row_key", F.when(F.col("doc_id").isNotNull(), key))
    classes = materialize(icws.near_duplicates(keyed.select("row_key", "text"), key="row_key"))
    gone = classes.filter("not kept").select(F.col("row_key").alias("gone")).distinct()
    kept = keyed.join(gone, F.col("row_key") == F.col("gone"), "left_anti")
    repeated = classes.filter("kept and row_key is not null").groupBy("row_key").count().filter("count > 1")
    if not repeated.take(1):
        return kept.select(*docs.columns)
    once = kept.filter("row_key is not null").dropDuplicates(["row_key"])
    return once.unionByName(kept.filter("row_key is null")).select(*docs.columns)


@_extra_columns_aside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as the mix takes it; rows with no copy go."""
    hashed = _numbered(docs)
    copies = materialize(mixing.mix(hashed.select("row_key", "source", "text"), key="row_key").filter("copies > 0").select("row_key", "copies"))
    # Equal rows are dealt their copies together: the join must not multiply them.
    total = copies.groupBy("row_key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    first = hashed.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = hashed.join(total.withColumnRenamed("row_key", "k"), F.expr("row_key.doc_id <=> k.doc_id and row_key.h = k.h"))
    if first.take(1):
        joined = joined.dropDuplicates(["row_key"])
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to; null and empty
    texts have no ids, texts of any length are encoded whole."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Model learning, iterations and tokenization are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/corpus-pipeline/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
