"""Full-text search: an inverted index as a table and ranked queries over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X

# Boosts of the fields.
BOOSTS = {"title": 2.0, "category": 1.5, "content": 1.0}
K1, B = 1.2, 0.7
PREFIX_WEIGHT = 0.375
FUZZY_WEIGHT = 0.45


def tokens(c: Column | str) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(X.col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def inverted_index(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``term``, key, ``field``, ``tf``, ``length`` for each field (name to column)."""
    out = None
    for field, column in fields.items():
        # the tokens are a column of their own: beside a generator they would be computed for each term again
        split = docs.select(key, F.lit(field).alias("field"), tokens(column).alias("_tokens"))
        rows = split.select(key, "field", F.size("_tokens").alias("length"), F.explode("_tokens").alias("term"))
        counted = rows.groupBy("term", key, "field", "length").agg(F.count("*").alias("tf"))
        out = counted if out is None else out.unionByName(counted)
    return out


def search(index: DataFrame, key: str, queries: DataFrame, n_docs: int, fuzzy: float = 0.2, prefix: bool = True) -> DataFrame:
    """Scores of documents for queries (query): BM25 over fields with boosts; prefixes and close terms count less.

    A query's words meet index terms on equality, or on the first letter for
    prefixes and close terms; only distinct terms are compared, not postings.
    """
    words = queries.select("query", F.explode(F.array_distinct(tokens("query"))).alias("word"))
    terms = index.groupBy("term", "field").agg(F.count("*").alias("df"), F.avg("length").alias("mean"))
    vocabulary = index.select("term").distinct().withColumn("first", F.substring("term", 1, 1))
    near = words.withColumn("first", F.substring("word", 1, 1)).join(vocabulary, "first")
    allowed = F.round(F.length("word") * fuzzy)
    distance = F.levenshtein("word", "term")
    weight = F.when(F.col("term") == F.col("word"), 1.0)
    if prefix:
        longer = F.length("term") - F.length("word")
        weight = weight.when(F.col("term").startswith(F.col("word")), PREFIX_WEIGHT * F.length("term") / (F.length("term") + 0.3 * longer))
    weight = weight.when(distance <= allowed, FUZZY_WEIGHT * F.length("term") / (F.length("term") + distance))
    matched = near.withColumn("weight", weight).filter("weight is not null").select("query", "term", "weight")
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv]), F.col("field"))
    means = terms.groupBy("field").agg(F.avg("mean").alias("mean"))
    postings = index.join(matched, "term").join(terms.select("term", "field", "df"), ["term", "field"]).join(means, "field")
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return postings.groupBy("query", key).agg(F.sum(F.col("weight") * boost * idf * tf).alias("score"))
