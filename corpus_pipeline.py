"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored
as Parquet before the next one reads it.  All but the last return the columns
of ``documents``:

  quality_rules      rejected documents go; lines above the limits are cut
  quality_classifier documents under the score limit go
  near_duplicates    of each near-duplicate group one document stays
  decontaminate      contaminated documents go; hit spans of others are cut
  encode             token ids of each text, and the digests that prove them

The last stage returns the other columns with n_tokens, ids, ids_sha256 and
decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import byte_bpe, decontaminate, jaccard_join, pu_quality, quality_rules
from lexiloom.storage import materialize, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    return pu_quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    both = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }).drop("decoded")


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", keep_uncontaminated),
    ("encode", encode),
]

#: SQL expresses neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
