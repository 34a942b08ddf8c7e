"""Claims of texts against what a project has: symbols, files and configuration keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import written
from tessella.operators.matching import contained

# How a claim names a symbol, a file and a key.
CALL = r"(\w+)\(\)"
NAMED = r"(?:the|a|an)\s+(\w+)\s+(?:class|interface|type|function|method)"
FILE = r"`([^`]+\.(?:ts|js|tsx|jsx|json|yaml|yml))`"
KEY = r"`([^`]+)`\s+(?:option|setting|key|config)"


def validate_claims(claims: DataFrame, symbols: DataFrame, files: DataFrame, keys: DataFrame) -> DataFrame:
    """Each claim's verdict: id, valid, status, reason, evidence (array of kind, value, confidence).

    ``claims``: id, text, evidence (array of kind, value; what its author put forward). ``symbols``,
    ``files`` and ``keys`` have one column ``name``. A symbol that a claim names is verified by a
    symbol of that name, inferred from one that holds the name, else the claim is unsupported; the
    reason tells the last such name. Files are verified by a path that holds them, keys by name;
    names and keys in any case. Where all that finds nothing, the author's own symbols must exist,
    to the letter, or the claim is contradicted. A claim with no evidence at all is inferred.
    Of equal ids one counts.
    """
    given = "array<struct<kind:string,value:string>>"
    c = claims.groupBy("id").agg(F.max(F.struct(F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("evidence", F.array().cast(given)).cast(given).alias("own"))).alias("c")).select("id", "c.*")
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(1))
    tagged = lambda kind, values: F.transform(values, lambda v, k: F.struct(F.lit(kind).alias("kind"), v.alias("value"), k.alias("at")))
    named = F.concat(tagged("symbol", F.array_distinct(F.concat(every(CALL), every(NAMED)))), tagged("file", every(FILE)), tagged("config", every(KEY)))
    refs = written(c.select("id", F.explode(named).alias("r")).select("id", "r.*"))
    wanted = refs.select("kind", "value").distinct()
    exact = lambda df, kind: wanted.filter(F.col("kind") == kind).join(df.select(F.lower("name").alias("value")).distinct(), "value").select("kind", "value", F.lit("verified").alias("confidence"))
    held = lambda df, name, kind, sure: contained(df.select(name.alias("name")).distinct(), "name", "name", wanted.filter(F.col("kind") == kind), "value").select(F.lit(kind).alias("kind"), "value", F.lit(sure).alias("confidence")).distinct()
    known = exact(symbols, "symbol").unionByName(held(symbols, F.lower("name"), "symbol", "inferred")).unionByName(held(files, F.col("name"), "file", "verified")).unionByName(exact(keys, "config"))
    best = known.groupBy("kind", "value").agg(F.max("confidence").alias("confidence"))  # verified comes after inferred
    met = refs.join(best, ["kind", "value"], "left")
    found = F.when(F.col("confidence").isNotNull(), F.struct("kind", "value", "confidence"))
    lost = F.when(F.col("confidence").isNull() & (F.col("kind") == "symbol"), F.struct("at", "value"))
    by_claim = met.groupBy("id").agg(F.array_sort(F.collect_list(found)).alias("found"), F.max(lost)["value"].alias("lost"))
    own = c.select("id", F.posexplode("own").alias("at", "o")).filter("o.kind = 'symbol'").select("id", "at", F.col("o.value").alias("value"))
    sure = own.join(symbols.select(F.col("name").alias("value")).distinct().withColumn("there", F.lit(True)), "value", "left")
    put = sure.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("there"), F.struct(F.lit("symbol").alias("kind"), "value", F.lit("verified").alias("confidence"))))).alias("put"),
        F.max(F.when(F.col("there").isNull(), F.struct("at", "value")))["value"].alias("false"),
    )
    none = F.array().cast("array<struct<kind:string,value:string,confidence:string>>")
    all_ = c.select("id").join(by_claim, "id", "left").join(put, "id", "left").select("id", F.coalesce("found", none).alias("found"), "lost", F.coalesce("put", none).alias("put"), "false")
    asks = F.size("found") == 0
    wrong = F.when(asks, F.col("false"))
    evidence = F.when(asks, F.col("put")).otherwise(F.col("found"))
    status = F.when(wrong.isNotNull(), "contradicted").when(F.col("lost").isNotNull(), "unsupported").when(F.size(evidence) == 0, "inferred").otherwise("verified")
    reason = (
        F.when(wrong.isNotNull(), F.concat(F.lit('Claimed evidence "'), wrong, F.lit('" not found.'))).when(F.col("lost").isNotNull(), F.concat(F.lit('Symbol "'), "lost", F.lit('" not found in project.')))
        .when(F.size(evidence) == 0, "No direct evidence found; claim may be inferential.").otherwise("Claim is supported by project evidence.")
    )
    return all_.select("id", status.isin("verified", "inferred").alias("valid"), status.alias("status"), reason.alias("reason"), evidence.alias("evidence"))


def summarize_claims(verdicts: DataFrame) -> DataFrame:
    """One row: total, a count for each status, and the share that is verified or inferred, 1 of none."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("verified", "inferred", "unsupported", "contradicted")]
    share = F.when(F.col("total") > 0, (F.col("verified") + F.col("inferred")) / F.col("total")).otherwise(1.0)
    return verdicts.agg(F.count("*").alias("total"), *counts).withColumn("rate", share)
