"""Pipeline over `documents`: each stage is written as Parquet and read again as the next one's input.

The quality classifier drops what it rejects, line dedup takes boilerplate lines out of the texts that are left, of
each group of near-duplicates (5-word shingles, similarity 0.8) one document stays, contaminated documents go, and
the rest is encoded to token ids and decoded again.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm.byte_bpe import stage_bpe
from tempora.llm.common import materialise, table
from tempora.llm.decontamination import stage_decontamination
from tempora.llm.jaccard_join import stage_jaccard
from tempora.llm.line_dedup import stage_line_dedup
from tempora.llm.quality_classifier import stage_quality

STAGES = [
    ("quality classifier", stage_quality),
    ("line dedup", stage_line_dedup),
    ("n-gram Jaccard join", stage_jaccard),
    ("benchmark decontamination", stage_decontamination),
    ("byte-level BPE encoding and decoding", stage_bpe),
]

#: The classifier is trained and the vocabulary is a file, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each materialised in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
