"""The document pipeline: toxicity, quality, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; it is written as Parquet and read
again for the next. All but the last return the columns of documents; the last returns the packed pieces.

In every stage null and empty texts count as texts without words: no stage but near_dedup drops them, which keeps one row of
equal ones under one id. Null ids are judged like others. Texts are read whole, however long. Ties in near_dedup go to the
least id, then to the least set; equal rows leave one. An empty table gives an empty result. Extra columns are carried by
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import decontamination, near_dedup, packing, quality, toxicity
from corpusgraph.llm.common import bound_batches, materialize, read_table
from corpusgraph.llm.sampling import id_remainder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    bound_batches(spark)
    lexicon = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), use=id_remainder("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, lexicon)


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    bound_batches(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), use=id_remainder("doc_id", 3) != 1)
    return quality.drop_poor(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the least id stays."""
    bound_batches(spark)
    return near_dedup.drop_near_duplicates(docs, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (0.8 of its shingles) go."""
    bound_batches(spark)
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096."""
    bound_batches(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", without_poor),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None  # the fitted models and the packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
