"""The corpus pipeline: from ``documents`` to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as parquet and reread as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm.chosen_path import near_duplicates
from loomnote.llm.common import documents, staged
from loomnote.llm.mixing import mixed
from loomnote.llm.packing import pack
from loomnote.llm.queries import toxicity_chain
from loomnote.llm.toxicity import without_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic."""
    return without_toxic(docs, toxicity_chain(spark, docs, sf_dir), "toxic", threshold=0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): that with the least id.

    Of rows of one id, or of none, the least by the hash of the text stays; of rows that are alike in both, the least by the other columns.
    """
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):  # names that no column of the documents has
        mark += "_"
    id_, key_, times_, row_ = (f"{mark}{x}" for x in ("id", "key", "times", "row"))
    kept = near_duplicates(docs, k=5, least=80).where("kept").groupBy("component", F.col("doc_id").alias(id_), F.col("text_key").alias(key_)).agg(F.count("*").alias(times_))
    first = F.min(F.struct(F.col(id_).isNull().alias("none"), id_, key_, times_)).alias("first")
    found = kept.where("component is not null").groupBy("component").agg(first).select(*(F.col(f"first.{x}") for x in (id_, key_, times_)))
    found = found.unionAll(kept.where("component is null").select(id_, key_, times_))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(found, docs["doc_id"].eqNullSafe(found[id_]) & (key == found[key_]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.where(F.col(times_) == 1).select(columns)
    # As JSON any row can be compared with another, whatever types its columns have.
    one = F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(row_)
    repeated = kept.where(F.col(times_) > 1).groupBy(id_, key_).agg(one).select(f"{row_}.*")
    return once.unionAll(repeated)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents as often as they are taken."""
    return mixed(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=0)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", keep_one_of_each), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The classifier, the hashes of the mix and the tokenizer have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
