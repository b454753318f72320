"""From raw documents to packed sequences: classify, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor
kept. All but the last return the columns of docs. Rows that share a doc_id (null
included) share the decisions of the third and fourth stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.llm import common
from causalframe.llm.decontaminate import decontaminate
from causalframe.llm.exact_dedup import exact_dedup
from causalframe.llm.ngram_join import ngram_join
from causalframe.llm.packing import pack
from causalframe.llm.quality import quality

#: What makes near copies: shingles of five words, 80 of 100 of them shared.
NEAR_WORDS, NEAR_THRESHOLD = 5, 80
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    # Other columns go through under names that the classifier's results do not have.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    renamed = docs.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(others)})
    scored = quality(spark, renamed, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1")
    return scored.select("doc_id", "text", *[F.col(f"__{i}").alias(c) for i, c in enumerate(others)]).select([F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    kept = exact_dedup(spark, docs).where("kept").select(F.col("doc_id").alias("__kept"), F.col("text_sha256").alias("__kept_sha"))
    known = docs.withColumn("__sha", F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), 256))
    found = known.join(kept, (known["__sha"] == kept["__kept_sha"]) & known["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
    return found.dropDuplicates(["doc_id", "__sha"]).drop("__sha")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram similarity links, the document with the smallest doc_id."""
    named = ngram_join(spark, docs, k=NEAR_WORDS, threshold=NEAR_THRESHOLD).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(named, docs["doc_id"].eqNullSafe(named["__kept"]), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item."""
    leaks = decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1).where("contaminated").select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["__leak"]), "left_anti")


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows of 2,048 tokens."""
    return pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_rest),
]

#: The first stage learns; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.store(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
