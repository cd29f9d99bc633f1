"""The two plans of the engine: from loaded files to stored chunks, and from a query to explained results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.config import Config
from textquarry.functions.arrays import ordered_set
from textquarry.functions.text import preview
from textquarry.operators import chunking, keyword, ranking, relationships, vector
from textquarry.operators.embedding import Embedder, quarantine_blank
from textquarry.operators.recursive_split import recursive_split
from textquarry.runtime import cut, numbered
from textquarry.sources.files import source_type

Hook = Callable[[DataFrame], DataFrame]


def chunk_files(files: DataFrame, config: Config) -> DataFrame:
    """``relative_path, chunk_no, chunk_text, start_char, end_char, parent_section, source_type, file_extension`` of loaded files.

    Known languages are cut recursively, other code at its boundaries, documents at headers and, where a section is too
    long, recursively.
    """
    keys = ["relative_path"]
    typed = files.where(F.col("text").isNotNull()).select("relative_path", "file_extension", "text", source_type(F.col("file_extension")).alias("source_type"))
    typed = typed.withColumn("chunker", chunking.chunker_of(F.col("source_type"), F.col("file_extension")))
    size, lap = config.chunk_size, config.chunk_overlap
    language = recursive_split(typed.where("chunker = 'language'"), "text", "relative_path", size, lap, "file_extension").withColumn("parent_section", F.lit(None).cast("string"))
    code = chunking.code_chunks(typed.where("chunker = 'code'"), "text", keys, size, lap).withColumn("parent_section", F.lit(None).cast("string"))
    sections = chunking.header_sections(typed.where("chunker = 'document'"), "text", keys)
    long = F.length("chunk_text") > 4 * size
    named = sections.where(long).select(F.struct("relative_path", "chunk_no", "start_char", "parent_section").alias("_at"), "chunk_text")
    parts = recursive_split(named.withColumn("_key", F.to_json("_at", {"ignoreNullFields": "false"})), "chunk_text", "_key", size, lap)
    at = F.from_json("_key", "relative_path string, chunk_no int, start_char int, parent_section string")
    parts = parts.withColumn("_at", at).select("_at.relative_path", F.col("_at.chunk_no").alias("_section"), F.col("chunk_no").alias("_part"), "chunk_text", (F.col("_at.start_char") + F.col("start_char")).alias("start_char"), (F.col("_at.start_char") + F.col("end_char")).alias("end_char"), "_at.parent_section")
    columns = ["relative_path", "_section", "_part", "chunk_text", "start_char", "end_char", "parent_section"]
    flat = [d.withColumn("_section", F.col("chunk_no")).withColumn("_part", F.lit(0)) for d in (language, code, sections.where(~long))]
    every = reduce(DataFrame.unionByName, [d.select(columns) for d in (*flat, parts)])
    # Chunks are counted through their file, whichever chunker they come from: any number of sections of any number of parts.
    number = (F.row_number().over(Window.partitionBy("relative_path").orderBy("_section", "_part")) - 1).cast("long")
    return every.withColumn("chunk_no", number).drop("_section", "_part").join(typed.drop("text"), "relative_path")


def index_files(files: DataFrame, config: Config, embedder: Embedder, next_vec_id: int = 0, after_chunking: Hook | None = None, after_loading: Hook | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored chunks, rows set aside because they are blank). Ids go on densely from ``next_vec_id`` in order of path and place.

    Tags that the user gave are kept apart (``user_tags``) from those found in the text (``tags``). The hooks change the
    loaded files and the chunks; files loaded by the page bring ``page_number`` and ``total_pages``.
    """
    files = after_loading(files) if after_loading else files
    chunks = chunk_files(files, config)
    chunks = after_chunking(chunks) if after_chunking else chunks
    good, blank = quarantine_blank(chunks, "chunk_text")
    if config.enable_relationships:
        found = relationships.relationships(F.col("chunk_text"), F.col("chunker"), F.col("file_extension"), F.col("parent_section"), config.max_relationships_per_chunk)
        good = good.withColumn("_r", found)
    else:
        none = F.array().cast("array<string>")
        good = good.withColumn("_r", F.struct(none.alias("refs"), none.alias("symbols"), none.alias("tags")))
    pages = [(F.col(c) if c in files.columns else F.lit(None)).cast("int").alias(c) for c in ("page_number", "total_pages")]
    given = files.select("relative_path", ordered_set(F.col("tags")).alias("user_tags"), "mime_type", "filename_stem", *pages)
    numbered_rows = numbered(good.join(given, "relative_path"), ["relative_path", "chunk_no", "start_char"], "vec_id", next_vec_id)
    embedded = embedder.embed(numbered_rows, "chunk_text")
    stored = embedded.select(
        "vec_id", F.sha2(F.concat_ws("\u0001", "relative_path", F.col("chunk_no").cast("string"), "chunk_text"), 256).alias("chunk_id"), F.col("relative_path").alias("source_path"), "source_type", "chunk_text", "start_char", "end_char",
        F.current_timestamp().alias("created_at"), "file_extension", F.lit(embedder.provider).alias("embedding_provider"), F.lit(embedder.model).alias("embedding_model"), "user_tags", F.col("_r.tags").alias("tags"), F.col("_r.refs").alias("ref_names"), F.col("_r.symbols").alias("code_symbols"),
        "parent_section", F.struct("mime_type", F.col("relative_path"), "filename_stem", F.col("chunk_no").alias("chunk_index"), F.col("parent_section").alias("chunk_name"), "page_number", "total_pages").alias("metadata"), "embedding",
    )
    return stored, blank


def search(chunks: DataFrame, vectors: DataFrame, keywords: keyword.KeywordIndex | None, query: str, query_vector: list[float], k: int = 5, weight: float = 0.3, score_mode: str = "similarity", repeated: bool = False) -> DataFrame:
    """Ranked and explained results, best first: twice k candidates by vector, blended with keyword scores, k of them kept.

    Without a keyword index the vectors alone decide. The texts are read only for the k results.
    """
    hits = cut(vector.vector_topk(vectors, query_vector, 2 * k, repeated=repeated))
    if score_mode == "compat":
        hits = vector.compat_scores(hits, clamp=keywords is None)
    else:
        hits = hits.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    if keywords:
        best = keyword.hybrid_topk(hits, keyword.keyword_scores(keywords, query), k, weight)
    else:
        best = hits.orderBy(F.desc("score"), "vec_id").limit(k).select("vec_id", F.col("score").alias("vector_score"), F.lit(None).cast("double").alias("keyword_score"), "score")
    about = [c for c in ("created_at", "file_extension", "embedding_provider", "embedding_model") if c in chunks.columns]
    found = vector.lookup(best, chunks.select("vec_id", "chunk_id", "source_path", "source_type", "chunk_text", "start_char", "end_char", "parent_section", *about))
    found = found.withColumn("structured", ranking.routed_metadata({"char_count": F.length("chunk_text"), "source_type": F.col("source_type")} | {c: F.col(c) for c in about})).drop(*about)
    return ranking.explain(found, query).withColumn("preview", preview(F.col("chunk_text"))).orderBy("rank")


def latest_per_path(files: DataFrame, order: list[str]) -> DataFrame:
    """The last load of each path by the order columns."""
    newest = Window.partitionBy("source_path").orderBy(*[F.desc_nulls_last(c) for c in order])
    return files.where(F.col("source_path").isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
