"""The corpus pipeline: language ID, near-dedup, decontamination, PII, packing."""

from __future__ import annotations

from quern.llm import decontaminate, language_id, near_dedup, packing, pii
from quern.llm.lineage import bound_batches, stored


def identify(spark, docs, sf_dir):
    """Documents whose language is clear stay, with all their columns."""
    bound_batches(spark)
    labelled = docs.filter(~language_id.held_out("doc_id", 5, 0))
    return language_id.identify(docs, language_id.train_dictionaries(labelled), only_accepted=True)


def deduplicate(spark, docs, sf_dir):
    """One document of each group of near copies stays: 5-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_one(docs, "doc_id", "text", 5, 80)


def decontaminated(spark, docs, sf_dir):
    """Documents with no benchmark window stay."""
    bound_batches(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark, docs, sf_dir):
    """Personal data, and terms that disclose it, are replaced in the texts."""
    return pii.sanitise(docs)


def packed(spark, docs, sf_dir):
    """Every piece of every document gets its bin and place."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("decontaminate", decontaminated), ("pii", sanitised), ("packing", packed)]

#: The first stage compresses texts, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
