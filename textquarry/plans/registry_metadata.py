"""Queries of the metadata store."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.arrays import as_text
from textquarry.operators import metadata, vector
from textquarry.plans import sql as q
from textquarry.runtime import table
from textquarry.sources.files import coerce_source_type

PATH, PROVIDER, MODEL = "handbook/operations/CHANGELOG.md", "sentence_transformers", "all-MiniLM-L6-v2"


def _c(s, d):
    return table(s, d, "chunks")


def _common(s, d, column):
    """The most frequent element of an array column, for a lookup that finds something in any table."""
    row = _c(s, d).select(F.explode(column).alias("v")).groupBy("v").count().orderBy(F.desc("count"), "v").first()
    return row["v"] if row else ""


def _first_id(s, d):
    row = _c(s, d).agg(F.min("chunk_id")).first()
    return row[0] or ""


QUERIES = {
    "point_lookup": lambda s, d: metadata.point_lookup(_c(s, d), "chunk_id", _first_id(s, d)).select("vec_id", "chunk_id", "source_path"),
    "by_source_type": lambda s, d: metadata.by_source_type(_c(s, d), "code").select("vec_id", "source_path"),
    "by_source_path": lambda s, d: metadata.by_source_path(_c(s, d), PATH).select("vec_id", "start_char"),
    "find_by_tag": lambda s, d: metadata.with_element(_c(s, d), "tags", _common(s, d, "tags")).select("vec_id"),
    "find_by_reference": lambda s, d: metadata.with_element(_c(s, d), "ref_names", _common(s, d, "ref_names")).select("vec_id"),
    "find_by_symbol": lambda s, d: metadata.with_element(_c(s, d), "code_symbols", _common(s, d, "code_symbols")).select("vec_id"),
    "chunk_relationships": lambda s, d: metadata.relationships_of(_c(s, d), _first_id(s, d)).select("chunk_id", as_text(F.col("tags")).alias("tags"), as_text(F.col("ref_names")).alias("ref_names"), as_text(F.col("code_symbols")).alias("code_symbols"), "parent_section"),
    "all_tags": lambda s, d: metadata.distinct_elements(_c(s, d), "tags"),
    "all_references": lambda s, d: metadata.distinct_elements(_c(s, d), "ref_names"),
    "all_code_symbols": lambda s, d: metadata.distinct_elements(_c(s, d), "code_symbols"),
    "discover_tags": lambda s, d: metadata.discover_tags(_c(s, d)),
    "embedding_compat": lambda s, d: metadata.embedding_compatible(_c(s, d), PROVIDER, MODEL),
    "embedding_info": lambda s, d: metadata.embedding_info(_c(s, d)),
    "stats_by_type": lambda s, d: metadata.stats_by_type(_c(s, d)),
    "relationship_stats": lambda s, d: metadata.relationship_stats(_c(s, d)),
    "unique_entities": lambda s, d: metadata.unique_entities(_c(s, d)),
    "remove_chunks": lambda s, d: metadata.remove_chunks(_c(s, d), _c(s, d).where(F.col("source_path") == PATH)).select("vec_id", "chunk_id"),
    "latest_versions": lambda s, d: metadata.latest_versions(_c(s, d)),
    "source_type_coerce": lambda s, d: _c(s, d).groupBy(F.coalesce("source_type", F.lit("(null)")).alias("stored"), coerce_source_type(F.col("source_type")).alias("source_type")).agg(F.count(F.lit(1)).alias("chunks")),
    "index_memory": lambda s, d: vector.index_info(table(s, d, "chunk_vectors"), 64),
    "validate_dimension": lambda s, d: vector.dimension_report(table(s, d, "chunk_vectors"), "embedding_model"),
}


def _sql_common(column: str) -> str:
    return f"(SELECT v FROM (SELECT unnest({column}) AS v FROM chunks) GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)"


_KIND = "CASE WHEN source_type IN ('code', 'document') THEN source_type ELSE 'document' END"
_ELEMENTS = " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest({k}) AS value FROM chunks" for k in ("tags", "ref_names", "code_symbols"))

SQL = {
    "point_lookup": "SELECT vec_id, chunk_id, source_path FROM chunks WHERE chunk_id = (SELECT min(chunk_id) FROM chunks)",
    "by_source_type": f"SELECT vec_id, source_path FROM chunks WHERE {_KIND} = 'code'",
    "by_source_path": f"SELECT vec_id, start_char FROM chunks WHERE source_path = '{PATH}'",
    "find_by_tag": f"SELECT vec_id FROM chunks WHERE list_contains(tags, {_sql_common('tags')})",
    "find_by_reference": f"SELECT vec_id FROM chunks WHERE list_contains(ref_names, {_sql_common('ref_names')})",
    "find_by_symbol": f"SELECT vec_id FROM chunks WHERE list_contains(code_symbols, {_sql_common('code_symbols')})",
    "chunk_relationships": f"SELECT chunk_id, {q.as_text('tags')} AS tags, {q.as_text('ref_names')} AS ref_names, {q.as_text('code_symbols')} AS code_symbols, parent_section FROM chunks WHERE chunk_id = (SELECT min(chunk_id) FROM chunks)",
    "all_tags": "SELECT DISTINCT value FROM (SELECT unnest(tags) AS value FROM chunks) WHERE value IS NOT NULL",
    "all_references": "SELECT DISTINCT value FROM (SELECT unnest(ref_names) AS value FROM chunks) WHERE value IS NOT NULL",
    "all_code_symbols": "SELECT DISTINCT value FROM (SELECT unnest(code_symbols) AS value FROM chunks) WHERE value IS NOT NULL",
    "discover_tags": f"SELECT DISTINCT tag FROM (SELECT {q.strip('t')} AS tag FROM (SELECT unnest(tags) AS t FROM chunks)) WHERE tag <> '' ORDER BY tag",
    "embedding_compat": f"SELECT coalesce(bool_and(coalesce(embedding_provider = '{PROVIDER}' AND embedding_model = '{MODEL}', false)), true) AS compatible FROM chunks",
    "embedding_info": "SELECT embedding_provider, embedding_model, count(*) AS chunks FROM chunks GROUP BY 1, 2",
    "stats_by_type": f"SELECT {_KIND} AS source_type, count(*) AS chunks, count(DISTINCT source_path) AS files, coalesce(sum(length(chunk_text)), 0)::BIGINT AS characters FROM chunks GROUP BY 1",
    "relationship_stats": f"SELECT kind, count(DISTINCT value) AS distinct_values FROM ({_ELEMENTS}) WHERE value IS NOT NULL GROUP BY kind",
    "unique_entities": f"SELECT count(DISTINCT value) AS entities FROM ({_ELEMENTS})",
    "remove_chunks": f"SELECT vec_id, chunk_id FROM chunks WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE source_path = '{PATH}' AND chunk_id IS NOT NULL)",
    "latest_versions": "SELECT source_path, start_char, arg_max(vec_id, (created_at, vec_id)) AS vec_id, count(*) AS versions FROM chunks GROUP BY source_path, start_char, coalesce(chunk_text, '')",
    "source_type_coerce": f"SELECT coalesce(source_type, '(null)') AS stored, {_KIND} AS source_type, count(*) AS chunks FROM chunks GROUP BY 1, 2",
    "index_memory": "SELECT count(embedding) AS total_vectors, 64::BIGINT AS dimension, CASE WHEN count(embedding) = 0 THEN 0 ELSE count(embedding) * 64 * 4 + 1048576 END::BIGINT AS memory_bytes FROM chunk_vectors",
    "validate_dimension": """WITH s AS (SELECT embedding_model, len(embedding) AS dimension, count(*) AS rows FROM chunk_vectors WHERE embedding IS NOT NULL GROUP BY 1, 2)
        SELECT embedding_model, dimension, rows, dimension = first_value(dimension) OVER (PARTITION BY embedding_model ORDER BY rows DESC, dimension DESC) AS valid FROM s""",
}
