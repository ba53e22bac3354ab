"""Corpus pipeline: raw documents to token ids.

Language ID drops documents without a language, the n-gram Jaccard join keeps one document of each group of near
duplicates, decontamination drops documents that hold a benchmark item, PII replaces personal data, and BPE encodes
what is left. Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from brindle.llm import bpe, decontam, langid, pii, tokengroup
from brindle.llm.common import durable

STAGES = [
    ("language", langid.stage),
    ("near_duplicates", tokengroup.stage),
    ("decontamination", decontam.stage),
    ("pii", pii.stage),
    ("bpe", bpe.stage),
]

#: SQL can express neither the fitted language model nor the merges of byte-level BPE.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
