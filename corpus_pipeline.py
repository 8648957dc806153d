"""A corpus pipeline: language ID, near-dedup, suffix dedup, mixing and BPE.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of
documents; the last returns token counts and digests. A stage's result is written as
Parquet into the shared folder and read again as the next stage's documents; tables that a
later stage has replaced are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm._util import materialize, release
from cairn.llm.bpe import stage_bpe
from cairn.llm.language_id import stage_language
from cairn.llm.mixing import stage_mixing
from cairn.llm.simhash import stage_near_duplicates
from cairn.llm.suffix_dedup import stage_suffix_dedup

STAGES = [
    ("language ID", stage_language),
    ("SimHash near-dedup", stage_near_duplicates),
    ("suffix-array dedup", stage_suffix_dedup),
    ("mixing sources", stage_mixing),
    ("BPE encoding and decoding", stage_bpe),
]

#: SQL has no byte-level BPE and no fitted classifier; tests hold every stage against a brute-force version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        now = materialize(stage(spark, docs, sf_dir), "pipeline", free=True)
        if before is not None:
            release(before)
        docs = before = now
    return docs
