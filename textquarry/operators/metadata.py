"""The metadata store as relational queries over the stored chunks.

Null arrays have no elements, null keys match nothing, repeated rows are separate rows, and an empty table gives an empty
result (or one row of zeros where a summary is asked for).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import strip
from textquarry.sources.files import coerce_source_type


def point_lookup(chunks: DataFrame, key: str, value) -> DataFrame:
    return chunks.where(F.col(key) == F.lit(value))


def by_source_type(chunks: DataFrame, kind: str) -> DataFrame:
    return chunks.where(coerce_source_type(F.col("source_type")) == kind)


def by_source_path(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("source_path") == path)


def with_element(chunks: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose array has the value, case-sensitively."""
    return chunks.where(F.array_contains(column, value))


def relationships_of(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return point_lookup(chunks, "chunk_id", chunk_id).select("chunk_id", "tags", "ref_names", "code_symbols", "parent_section")


def distinct_elements(chunks: DataFrame, column: str) -> DataFrame:
    """``value``: each element once."""
    return chunks.select(F.explode(column).alias("value")).where(F.col("value").isNotNull()).distinct()


def discover_tags(chunks: DataFrame) -> DataFrame:
    """``tag``: trimmed, not blank, each once, in order."""
    return chunks.select(F.explode("tags").alias("t")).select(strip(F.col("t")).alias("tag")).where(F.col("tag") != "").distinct().orderBy("tag")


def embedding_compatible(chunks: DataFrame, provider: str, model: str) -> DataFrame:
    """``compatible``: whether all rows have this provider and model; true for no rows."""
    same = (F.col("embedding_provider") == provider) & (F.col("embedding_model") == model)
    return chunks.agg(F.coalesce(F.bool_and(F.coalesce(same, F.lit(False))), F.lit(True)).alias("compatible"))


def embedding_info(chunks: DataFrame) -> DataFrame:
    """``embedding_provider, embedding_model, chunks``."""
    return chunks.groupBy("embedding_provider", "embedding_model").agg(F.count(F.lit(1)).alias("chunks"))


def stats_by_type(chunks: DataFrame) -> DataFrame:
    """``source_type, chunks, files, characters``."""
    return chunks.groupBy(coerce_source_type(F.col("source_type")).alias("source_type")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_path").alias("files"), F.coalesce(F.sum(F.length("chunk_text")), F.lit(0)).alias("characters"))


def _elements(chunks: DataFrame) -> DataFrame:
    kinds = ("tags", "ref_names", "code_symbols")
    parts = [chunks.select(F.lit(k).alias("kind"), F.explode(k).alias("value")) for k in kinds]
    # Distinct before the union: what is shuffled is the values, not the rows.
    return reduce(DataFrame.unionByName, [p.where(F.col("value").isNotNull()).distinct() for p in parts])


def relationship_stats(chunks: DataFrame) -> DataFrame:
    """``kind, distinct_values`` of tags, references and symbols."""
    return _elements(chunks).groupBy("kind").agg(F.count(F.lit(1)).alias("distinct_values"))


def unique_entities(chunks: DataFrame) -> DataFrame:
    """``entities``: distinct values of all three together."""
    return _elements(chunks).select("value").distinct().agg(F.count(F.lit(1)).alias("entities"))


def remove_chunks(chunks: DataFrame, removed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows whose key isn't among the removed ones; null keys stay."""
    return chunks.join(removed.select(key).distinct(), key, "left_anti")


def latest_versions(chunks: DataFrame) -> DataFrame:
    """One row per path, place and text: the last indexed. What an upsert would have kept of files indexed twice."""
    keys = ["source_path", "start_char", "text_hash"]
    hashed = chunks.withColumn("text_hash", F.sha2(F.coalesce("chunk_text", F.lit("")), 256))
    return hashed.groupBy(*keys).agg(F.max(F.struct("created_at", "vec_id")).alias("last"), F.count(F.lit(1)).alias("versions")).select("source_path", "start_char", F.col("last.vec_id").alias("vec_id"), "versions")
