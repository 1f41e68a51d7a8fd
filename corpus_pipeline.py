"""The corpus pipeline: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm import decontam, langid, minhash, mixing, sharding
from fogbank.llm.common import durable, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose language can't be told (null text, no letter) go; lang becomes the language that was told.

    So the later stages, whose cells are by language, stand on the network and not on labels.
    """
    net = langid.fit(docs, ~langid.fold_held_out())
    if net is None:  # no labelled text to learn from: letters alone decide, and labels stay
        return docs.where(langid.lettered(docs))
    name = "told"
    while name in docs.columns:
        name += "_"
    told = docs.withColumn(name, langid.language(docs, net)).where(F.col(name) != langid.UNKNOWN)
    return told.select(*[F.col(name).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the document with the smallest id of each near-duplicate group stays, one row of it."""
    odd = durable(docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").select("doc_id"))
    numbered = one_row_per_id(docs, odd) if odd.limit(1).count() else None
    if numbered is None:
        copies = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("copy_of_doc"))
        return docs.join(copies, docs["doc_id"] == copies["copy_of_doc"], "left_anti")
    groups = minhash.near_duplicates(numbered.select("row_number", "text"), "row_number").select(F.col("doc_id").alias("row_number"), "component_id")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row_number")
    ranked = numbered.select("row_number", rank.alias("rank")).join(groups, "row_number")
    stay = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row_number")
    return numbered.join(stay, "row_number", "left_semi").select(*docs.columns)


def one_row_per_id(docs: DataFrame, odd: DataFrame) -> DataFrame:
    """docs with a row_number that is unique: the id, or a number below all ids for the odd (null or repeated) ids.

    Rows that repeat both an odd id and its text come down to one.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    of_odd = docs.where("doc_id IS NULL").unionByName(docs.join(odd, "doc_id", "left_semi").select(*docs.columns))
    once = of_odd.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*").select(*docs.columns)
    least = docs.agg(F.least(F.min("doc_id"), F.lit(0)).cast("long")).first()[0] or 0
    plain = docs.where("doc_id IS NOT NULL").join(odd, "doc_id", "left_anti").select(*docs.columns)
    low = once.withColumn("row_number", F.lit(least) - 1 - F.monotonically_increasing_id())
    return durable(plain.withColumn("row_number", F.col("doc_id").cast("long")).unionByName(low))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with at least a twentieth of their words in benchmark windows go."""
    blocks = decontam.automata(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.uncontaminated(docs, blocks)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are sampled by their cell's raked ratio, so that three quarters of the tokens stay."""
    return mixing.calibrated(docs, keep=mixing.KEEP, rounds=mixing.ROUNDS_MOST, tolerance=mixing.TOLERANCE).where("sampled").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document's contiguous, byte-balanced shard."""
    return sharding.shard_by_bytes(docs).withColumn("law", F.lit("bytes"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The learned first stage can't be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done: list = []
    for i, (_, stage) in enumerate(STAGES):
        out, read = stage(spark, docs, sf_dir), done
        if i + 1 < len(STAGES):
            done = []
            out = durable(out, done)
            release(read)  # the stage before this one
        docs = out
    return docs
