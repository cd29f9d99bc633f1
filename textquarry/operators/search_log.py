"""Statistics of logged searches: repeated rows of a query count once, as first logged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import strip


def first_logged(log: DataFrame) -> DataFrame:
    """One row per query: the one logged first (nulls last). The whole row travels as one value, so no sort is needed."""
    rest = [c for c in log.columns if c != "query_id"]
    order = F.struct(F.col("logged_at").isNull(), "logged_at", *[F.col(c) for c in rest if c != "logged_at"])
    return log.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("query_id", "r.*")


def search_log_stats(log: DataFrame) -> DataFrame:
    """Per mode: searches, errors, error and success rate, mean and longest time of the successful ones."""
    ok = F.col("error_code").isNull()
    per = first_logged(log).groupBy(F.coalesce("search_mode", F.lit("unknown")).alias("search_mode")).agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(~ok).alias("errors"), F.round(F.avg(F.when(ok, F.col("elapsed_ms"))), 4).alias("mean_ms"), F.max(F.when(ok, F.col("elapsed_ms"))).alias("longest_ms")
    )
    return per.withColumn("error_rate", F.round(F.col("errors") / F.col("searches"), 6)).withColumn("success_rate", F.round(1 - F.col("errors") / F.col("searches"), 3))


def slow_searches(log: DataFrame, threshold_ms: float = 1000) -> DataFrame:
    """``query_id, search_mode, elapsed_ms, shown_query`` of successful searches over the threshold."""
    shown = F.when(F.length("query_text") > 50, F.concat(F.left("query_text", F.lit(50)), F.lit("..."))).otherwise(F.col("query_text"))
    return first_logged(log).where(F.col("error_code").isNull() & (F.col("elapsed_ms") > threshold_ms)).select("query_id", F.coalesce("search_mode", F.lit("unknown")).alias("search_mode"), "elapsed_ms", shown.alias("shown_query"))


def query_analysis(log: DataFrame, default_k: int = 5, most_k: int = 50) -> DataFrame:
    """Per query: normalised text, characters, words, whether blank, and the k that a search would use."""
    clean = strip(F.coalesce("query_text", F.lit("")))
    words = F.size(F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != ""))
    k = F.when(F.col("top_k").isNull() | (F.col("top_k") < 1), default_k).otherwise(F.least(F.col("top_k"), F.lit(most_k)))
    return first_logged(log).select("query_id", F.lower(clean).alias("normalized_query"), F.length(F.coalesce("query_text", F.lit(""))).cast("long").alias("char_count"), words.cast("long").alias("word_count"), (clean == "").alias("blank"), k.cast("long").alias("used_k"))
