"""A training-corpus pipeline over the documents table.

Stages, each a function of (spark, docs, sf_dir), whose result is written as
Parquet and read again as the next one's ``docs``:

1. toxicity - documents whose toxic probability reaches the threshold go;
2. simhash - one document of each near-duplicate group stays;
3. decontamination - documents that the contamination rule marks go;
4. pii - personal data, spans with a score of ``pii.LIKELY`` or more, is replaced
   by its kind in brackets;
5. bpe - texts become token ids, and the ids are decoded again.

All but the last return the columns of ``docs``, extra ones included, whatever
their names. Texts of any length are read whole. Of rows equal in id and
fingerprint one passes stage 2; a document whose probability ties with the
threshold goes. A null text
is no text: it is not toxic, not contaminated, keeps its null in stage 4 and has
no ids; null texts and empty ones are copies of each other in stage 2. Rows with
a null doc_id pass stage 2. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, fm_index, pii, simhash, toxicity
from tessella.llm.common import read_table, scratch_path
from tessella.llm.queries import digest


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents."""
    chain = toxicity.train(docs, read_table(spark, sf_dir, "labels"), toxicity.categories_of_labels())
    scored = toxicity.score(docs, chain, docs.columns)
    return scored.filter(F.col("res.p_toxic") < toxicity.THRESHOLD).select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    found = fm_index.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), docs.columns)
    return found.filter(~fm_index.contaminated()).select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; ``n_chars`` follows a changed text."""
    likely = pii.find_pii(docs, docs.columns).select("row", pii.likely(F.col("spans")).alias("spans"))
    found = likely.select(
        "row", pii.masked(F.col("row.text"), F.col("spans")).alias("masked"), (F.size("spans") > 0).alias("changed")
    )
    fresh = {
        "text": F.col("masked"),
        "n_chars": F.when(F.col("changed"), F.length("masked").cast("long")).otherwise(F.col("row.n_chars")),
    }
    # read out under names of its own first: a column of docs may be called like one of these
    named = found.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(f"_{k}") for k, c in enumerate(docs.columns)])
    return named.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digest(bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ["doc_id"]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained classifier decides stage 1, which SQL cannot express.
ORACLE_SQL = None
