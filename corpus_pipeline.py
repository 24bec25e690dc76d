"""Documents to a sharded, deduplicated, decontaminated training mix, stage by stage.

Each stage takes the documents its predecessor kept and returns what it keeps of them, with the
columns of ``documents``, further ones included; the last one adds ``shard`` and ``slot``. Rows with null texts or ids
and empty tables pass through every stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledeltas.llm import langid, sharding, simhash
from tabledeltas.llm.common import fresh, saved, table, working_folder
from tabledeltas.llm.decontaminate import decontaminate
from tabledeltas.llm.mixing import mix

#: A document is rejected if less than this share of its letters gives evidence of any language.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language: no letters, or evidence of languages, be they one
    or several, for too few of them. If none could be learned, only those without letters."""
    (found,) = fresh(docs, "found")
    model = langid.train_apart(docs)
    if not model.learned:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    label = langid.label(model, spark)
    kept = (F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.evident") >= LEAST_SCORE)
    return docs.withColumn(found, label).where(kept).drop(found)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one of the smallest id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weight of its source asks for."""
    return mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place in it; copies stay together."""
    shard, slot = fresh(docs, "shard", "slot")
    folder = working_folder(spark)
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    rows = docs.select(F.struct("*").alias("doc"), key, F.col("doc_id").isNull().alias("nameless"))
    rows = saved(rows.withColumn("at", F.monotonically_increasing_id()), f"{folder}/documents")
    known_by = [F.coalesce("doc_id", F.lit(-1)), F.col("nameless"), F.col("key")]
    known = rows.select("at", "key", "nameless", F.col("doc.doc_id").alias("doc_id"))
    ranked = saved(sharding.ranked(known, known_by, f"{folder}/ranked"), f"{folder}/rows")
    placed = ranked.select("at", "row").join(sharding.assign(ranked.select("row", "key")), "row")
    return rows.join(placed.select("at", "shard", "slot"), "at").select(
        "doc.*", F.col("shard").alias(shard), F.col("slot").alias(slot)
    )


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A learned model, fingerprints and a label propagation: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again as the next one's documents."""
    folder = working_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
