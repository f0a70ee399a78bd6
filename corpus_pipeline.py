"""Documents to packed sequences: toxic documents go, then repeated lines, near copies and benchmark text.

Each stage works on what the one before kept, which is written as Parquet and read again. Null texts are empty: they have no words, are
neither toxic nor repeated nor contaminated, and become a sequence of the end id alone. Very long texts are taken whole. Of rows that repeat
doc_id and text one stays in the third stage; ties go to the smaller doc_id, null ids last. Empty tables give empty tables. Columns beyond
doc_id and text are carried along, whatever their names, up to the last stage, whose columns are its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import contamination, line_dedup, packing, shingle_join, toxicity
from pulsegrid.llm.common import Scratch, ship

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove_toxic(docs, model, threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of 50 words or more; a document of which no word is left goes.

    `n_chars` follows the text where that changed; all other columns stay as they are, also those named like counts of the operator.
    """
    ship(spark)
    own = {name: f"__own_{name}" for name in ("n_lines", "n_removed") if name in docs.columns}
    left = line_dedup.delete_repeated_lines(docs.withColumnsRenamed(own))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("n_removed") > 0
    kept = left.where(~emptied)
    if "n_chars" in docs.columns:
        count = F.when(changed, F.char_length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{own.get(name, name)}`").alias(name) for name in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8."""
    ship(spark)
    return shingle_join.one_of_each(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of the benchmark."""
    ship(spark)
    return contamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), 2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

# The scores of the first stage and the sequences of the last cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        written = scratch.write(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(docs)
        docs = written
    return docs
