"""The registered query of each training-data operator, with production parameters.

A query reads its whole table, applies the operator and derives the digest
columns from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, conversations, embedding_dedup, fm_index, hmm, html_main, merkle, pii, quality, records, simhash, toxicity, warc
from tessella.llm.common import crc_bucket, read_table, scratch_path
from tessella.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return hmm.score(read_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(read_table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(list(pii.BASE)))
    named = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind))
    return found.select(
        "row.doc_id",
        *[number(kind).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
        F.size(pii.likely(F.col("spans"))).cast("long").alias("n_likely"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the classifier chain."""
    docs = read_table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, read_table(spark, sf_dir, "labels"), toxicity.categories_of_labels())
    scored = toxicity.score(docs, chain, ["doc_id"])
    return scored.select("row.doc_id", "res.*", (F.col("res.p_toxic") >= toxicity.THRESHOLD).alias("toxic"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter(crc_bucket("doc_id") != 0)
    scored = quality.score(docs, quality.train(docs, labels), ["doc_id"])
    return scored.select(
        "row.doc_id",
        F.coalesce(crc_bucket(F.col("row.doc_id")) == 0, F.lit(False)).alias("held_out"),
        "res.score",
        (F.col("res.score") >= 0.3).cast("int").alias("predicted"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = fm_index.find_contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"]
    )
    ids = F.array_sort(F.transform("res.item_ids", lambda i: i.cast("string")))
    return found.select(
        "row.doc_id",
        "res.n_words",
        fm_index.hit_words().alias("n_hit"),
        F.size("res.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        fm_index.contaminated().alias("contaminated"),
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_main.extract(read_table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("row.page_id", "row.url", "res.text", F.length("res.text").cast("long").alias("n_chars"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of embeddings."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as binary records and read back."""
    path = scratch_path(spark, "records")
    records.write_records(
        read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    return records.layout(spark, path)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents by SimHash."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents")
    return digest(bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ["doc_id"]))


def digest(decoded: DataFrame) -> DataFrame:
    """The digest columns of encoded and decoded documents."""
    return decoded.select(
        "row.doc_id",
        "res.n_tokens",
        F.sha2("res.ids", 256).alias("ids_sha256"),
        F.sha2("res.decoded", 256).alias("decoded_sha256"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and the cheapest repair."""
    given = read_table(spark, sf_dir, "conversations")
    done = conversations.repair(conversations.damage(given))
    ids = given.select("conv_id").distinct().withColumn("ck", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = ids.join(done.summary.join(conversations.repaired(done, digests=True), "ck"), "ck", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of the documents, and what it says of tampered rows."""
    docs = read_table(spark, sf_dir, "documents")
    named = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    tampered = F.coalesce(crc_bucket("doc_id", 7) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    rows = docs.select("doc_id", "lang", merkle.leaf(*named(F.col("n_chars"))).alias("leaf"), F.when(tampered, merkle.leaf(*named(more))).alias("forged"))
    built = merkle.build(rows, F.col("lang"), ["doc_id"], F.col("leaf"), ["doc_id", "forged"])
    folded = built.withColumn("folded_root", merkle.fold(F.coalesce("row.forged", "leaf")))
    return folded.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to web archives, found again by URL through the capture index and read back."""
    pages, path = read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    warc.build_index(spark, path)
    captures = warc.lookup(spark, path, pages.select(warc.url_key("url")))
    return warc.fetch(spark, path, captures, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm": op1_hmm,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_token_records": op5_token_records,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_main_text": op8_main_text,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_conversations": op11_conversations,
    "op12_merkle": op12_merkle,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op11_conversations": OP11_SQL, "op12_merkle": OP12_SQL, "op13_warc": OP13_SQL}
