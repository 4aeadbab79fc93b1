"""From raw documents to shards: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and further columns that docs may have. Null
texts count as empty ones. An empty table gives an empty result. Rows that share
an id but not a text are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontam, minhash, mixing, quality, sharding
from webloom.operators.ordered import range_parts, running_totals
from webloom.runtime import materialize

ORACLE_SQL = None


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose Bradley-Terry score is under the threshold; each row is judged by its own text."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(model.score(F.col("text")) >= model.threshold)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates, once.

    Empty texts are near nothing and stay. If ids are null or repeated, documents
    are numbered in the order of their ids (null last) and texts first; of rows
    equal in id and text one stays, that of the least hash of all its columns.
    Kept ids grow with the documents, so they are never broadcast.
    """
    params = minhash.MinHash(words=5, percent=80)
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1").limit(1).count()
    if not odd:
        kept = materialize(minhash.near_duplicates(docs, params).filter("kept").select(F.col("doc_id").alias("_kept")), "kept")
        return docs.join(kept.hint("merge"), docs["doc_id"] == kept["_kept"], "left_semi")
    same = F.sha2(F.coalesce("text", F.lit("")), 256)
    names = docs.select("doc_id", same.alias("same")).distinct()
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("same")]
    numbers = running_totals(range_parts(names, order, "names"), order, {"number": F.lit(1).cast("long")})
    numbers = materialize(numbers.select(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"), "number"), "numbers")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_own"), "text", same.alias("_text"))
    rows = rows.join(numbers, rows["_own"].eqNullSafe(numbers["_doc"]) & (rows["_text"] == numbers["_same"])).select("row", "number", "text")
    once = rows.groupBy("number").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    once = materialize(once.select("row", F.col("number"), F.col("row.text").alias("text")), "once")
    kept = minhash.near_duplicates(once, params, id_col="number").filter("kept").select(F.col("doc_id").alias("_kept"))
    kept = materialize(kept, "kept")
    return once.join(kept.hint("merge"), once["number"] == kept["_kept"], "left_semi").select("row.*")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item; each row is judged by its own text while it is read."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some of them twice, so that sources have their target shares of words; a null source is one too."""
    return mixing.take_mix(docs)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place each row in one of 40 shards of near equal bytes, equal texts together; repeated rows have slots of their own."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("shard", stage_shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
