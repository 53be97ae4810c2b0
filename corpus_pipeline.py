"""The training corpus, stage by stage: each stage reads what the one before it wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostwright.llm import common, decontaminate, minhash, mixing, sharding, toxicity


def _names(docs: DataFrame) -> list[str]:
    """The columns of docs, quoted: a name may hold a dot."""
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 stay."""
    model = toxicity.fitted(spark, docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__toxicity").filter("`__toxicity` < 0.7").drop("__toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays."""
    return minhash.near_dedup(docs, k=5, percent=80).filter("kept").select(*_names(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find_leaks(docs, common.table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*_names(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs)
    copies = mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*_names(docs))


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs).select(*_names(docs), "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: The first stage learns a model, which SQL can't. tests/llm compares near-dedup and decontamination with plain versions, and holds
#: toxicity (a subset, most of it kept), mixing (copies and budget) and sharding (counts and slots) to their laws only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage wrote on its way goes once its result is there, and its result once the next one's is."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch(spark) as keep:
            out = keep(common.durable(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        common.delete(docs)
        docs = out
    return docs
