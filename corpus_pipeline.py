"""From raw documents to packed sequences: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; ``run`` writes what each returns as Parquet into the
shared folder and reads it back. All but the last keep the columns of ``documents``, whatever they are called, and their order;
an empty table stays empty; repeated rows are documents of their own until the near duplicates go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkfold.llm import chosen_path, langid, packing, substrings
from inkfold.session import written

#: Least share that the predicted language must have.
LEAST_SCORE = 0.5


def _boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """A document's columns in one struct beside its text, so that no operator's names can meet theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), *more)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: none predicted, or none with half of the weight. Null and letterless texts go, and so does
    everything if no row has text, language and id to learn from."""
    model = langid.fit(docs, F.lit(True))
    # a text that is a string goes to the workers once, beside the other columns and not among them
    once = {c for c in docs.columns if c.lower() == "text" and docs.schema[c].dataType == StringType()}
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in once]).alias("row"), F.col("text").cast("string").alias("text"))
    got = langid.predict(boxed, model).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return got.select(*[F.col("text").alias(c) if c in once else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the one with the least doc_id (a repeated row once; null ids last)."""
    stay = chosen_path.near_classes(docs).where("keep").select("key")
    keyed = _boxed(docs, chosen_path.row_key().alias("key"))
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of passages that start elsewhere too; documents that had words and lose all of them go. n_chars follows."""
    got = substrings.dedup(docs, with_text=True)
    left = got.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    row = F.col("row")
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(F.col("row.text")).cast(docs.schema["n_chars"].dataType))
    return left.select(row.alias("row")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: No SQL: language identification is trained, and the packing is a plan.
ORACLE_SQL = None
