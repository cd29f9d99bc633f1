"""Rank, explanation, confidence and position of search results, as columns.

Null scores count as missing. Terms are the lower-case words of the query; an empty query matches no term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_results(hits: DataFrame, key: str = "vec_id", score: str = "score") -> DataFrame:
    """``rank`` from 1, best score first, ties to the smaller key. For the few rows of a search."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("long"))


def ranking_info(ranked: DataFrame, score: str = "score") -> DataFrame:
    """``total_results, top_percentile, relative_score`` of ranked rows."""
    whole = Window.partitionBy()
    total = F.count(F.lit(1)).over(whole)
    best = F.max(score).over(whole)
    return ranked.withColumn("total_results", total).withColumn("top_percentile", F.round((total - F.col("rank") + 1) / total * 100, 1)).withColumn("relative_score", F.when(best > 0, F.round(F.col(score) / best, 3)))


def match_type(vector: Column, keyword: Column, score: Column) -> Column:
    """By the scores that are there, else by the size of the one score."""
    return (
        F.when(vector.isNotNull() & keyword.isNotNull(), "hybrid").when(vector.isNotNull(), "semantic").when(keyword.isNotNull(), "keyword")
        .when(score >= 0.95, "exact").when(score >= 0.7, "semantic").otherwise("keyword")
    )


def matched_terms(text: Column, query: str) -> Column:
    """The query's words that occur in the text, even inside words; repeated words are kept."""
    terms = query.lower().split()
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)) if terms else F.array().cast("array<string>")


def clamped(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 3)


def confidence(vector: Column, keyword: Column, score: Column) -> dict[str, Column]:
    """``semantic, keyword, exact_match, overall`` between 0 and 1."""
    base = F.least(F.lit(1.0), score)
    return {
        "semantic_confidence": clamped(F.when(vector.isNotNull(), F.least(F.lit(1.0), vector)).otherwise(base * 0.7)),
        "keyword_confidence": clamped(F.when(keyword.isNotNull(), F.least(F.lit(1.0), keyword)).otherwise(base * 0.5)),
        "exact_match_confidence": F.when(score >= 0.95, 1.0).otherwise(0.0),
        "overall_confidence": clamped(base),
    }


def relevance_reason(kind: Column, terms: Column) -> Column:
    """One sentence or two on why a result is there."""
    # The wording of the reasons.
    n = F.size(terms)
    return (
        F.when(kind == "exact", "Contains exact match of query terms")
        .when((kind == "keyword") & (n > 0), F.concat(F.lit("Matches "), n.cast("string"), F.lit(" query terms")))
        .when(kind == "semantic", "Semantically similar to query")
        .when((kind == "hybrid") & (n > 0), F.concat(F.lit("Combined keyword and semantic matching. Matches "), n.cast("string"), F.lit(" terms")))
        .when(kind == "hybrid", "Combined keyword and semantic matching")
        .otherwise("Relevance determined by search algorithm")
    )


def position(start: Column, end: Column, first_line: Column | None = None, last_line: Column | None = None) -> dict[str, Column]:
    """``start_char, end_char, char_length``, and with lines ``line_start, line_end, line_count``; lengths only where both ends are known."""
    chars = {"start_char": start, "end_char": end, "char_length": end - start}
    if first_line is None or last_line is None:
        return chars
    # The greatest of both skips nulls, so the count is asked for only where both lines are known.
    count = last_line - first_line + 1
    return chars | {"line_start": first_line, "line_end": last_line, "line_count": F.when(count.isNotNull(), F.greatest(F.lit(1), count))}


def routed_metadata(fields: dict[str, Column]) -> Column:
    """The fields as one struct of ``content``, ``source``, ``processing`` and the rest, by how their names begin."""
    # Beginnings of names and the part they belong to.
    parts = {"content": ("word_", "char_", "line_", "chunk_index"), "source": ("file_", "source_", "created_"), "processing": ("embedding_", "model_", "processing_")}
    placed = {name: next((part for part, starts in parts.items() if name.startswith(starts)), "") for name in fields}
    inner = [F.struct(*[fields[n].alias(n) for n in fields if placed[n] == part]).alias(part) for part in parts if part in placed.values()]
    return F.struct(*inner, *[fields[n].alias(n) for n in fields if not placed[n]])


def explain(hits: DataFrame, query: str, text: str = "chunk_text") -> DataFrame:
    """Ranked hits (with ``vector_score, keyword_score, score`` and their text) with everything above."""
    vector, keyword, score = F.col("vector_score"), F.col("keyword_score"), F.col("score")
    out = ranking_info(rank_results(hits)).withColumn("match_type", match_type(vector, keyword, score)).withColumn("terms", matched_terms(F.col(text), query))
    return out.withColumns(confidence(vector, keyword, score)).withColumn("reason", relevance_reason(F.col("match_type"), F.col("terms")))
