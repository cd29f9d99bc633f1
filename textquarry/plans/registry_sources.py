"""Queries over loads of files: filters, routing, metadata of paths, tags, clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.arrays import as_text
from textquarry.functions.text import newlines
from textquarry.plans import pipeline
from textquarry.plans import sql as q
from textquarry.runtime import table
from textquarry.sources import files

INCLUDE, EXCLUDE = ["*.py", "*.[jt]s", "*/docs/*"], ["*/vendor/*", "*_data.*"]
DIRECTORIES = ["vendor*", "node_modules", "gen"]


def _files(s, d):
    return table(s, d, "source_files")


QUERIES = {
    "crawl_filter": lambda s, d: files.crawl_filter(_files(s, d), "source_path", INCLUDE, EXCLUDE).select("file_id", "source_path"),
    "exclude_dirs": lambda s, d: files.exclude_dirs(_files(s, d), "source_path", DIRECTORIES).select("file_id", "source_path"),
    "route_files": lambda s, d: _files(s, d).groupBy(files.route(files.extension_of(F.col("source_path")), F.col("mime_type")).alias("loader")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_chars").alias("size_chars")),
    "path_metadata": lambda s, d: _files(s, d).select("file_id", files.extension_of(F.col("source_path")).alias("file_extension"), files.stem_of(F.col("source_path")).alias("filename_stem"), F.substring_index("source_path", "/", 1).alias("base"), F.regexp_replace("source_path", "^[^/]*/", "").alias("relative_path")),
    "parse_tags": lambda s, d: _files(s, d).select("file_id", as_text(files.parse_tags(F.col("user_tags"))).alias("tags"), as_text(files.parse_tags(F.col("user_tags"), distinct=False)).alias("all_tags")),
    "latest_loads": lambda s, d: pipeline.latest_per_path(_files(s, d), ["recorded_at", "file_id"]).select("source_path", "file_id", "load_status"),
    "clean_markdown": lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.md5(files.clean_markdown(newlines(F.col("text")))).alias("text_md5"), F.length(files.clean_markdown(newlines(F.col("text")))).cast("long").alias("n_chars")),
    "source_type_infer": lambda s, d: _files(s, d).select("file_id", files.source_type(F.lower(F.regexp_replace("file_extension", r"^\.", ""))).alias("source_type")),
}

_NAME = "regexp_extract(source_path, '[^/]*$')"
_EXT = f"lower(coalesce(nullif(regexp_extract({_NAME}, '^[^.].*?\\.([^.]+)$', 1), ''), ''))"

SQL = {
    "crawl_filter": "SELECT file_id, source_path FROM source_files WHERE (source_path LIKE '%.py' OR regexp_full_match(source_path, '(?s).*\\.[jt]s') OR source_path LIKE '%/docs/%') AND NOT (source_path LIKE '%/vendor/%' OR regexp_full_match(source_path, '(?s).*_data\\..*'))",
    "exclude_dirs": "SELECT file_id, source_path FROM source_files WHERE source_path IS NOT NULL AND len(list_filter(string_split(source_path, '/')[:-2], lambda p: starts_with(p, 'vendor') OR p IN ('node_modules', 'gen'))) = 0",
    "route_files": f"""WITH f AS (SELECT *, {_EXT} AS ext FROM source_files)
        SELECT CASE WHEN ext = 'pdf' OR coalesce(mime_type, '') = 'application/pdf' THEN 'pdf' WHEN ext IN ({q.listed(files.TEXT_EXTENSIONS)}) OR coalesce(mime_type, '') LIKE 'text/%' THEN 'text' ELSE 'skip' END AS loader,
        count(*) AS files, sum(size_chars)::BIGINT AS size_chars FROM f GROUP BY 1""",
    "path_metadata": f"""SELECT file_id, {_EXT} AS file_extension, regexp_replace({_NAME}, '^(.+)\\.[^.]+$', '\\1') AS filename_stem, split_part(source_path, '/', 1) AS base, regexp_replace(source_path, '^[^/]*/', '') AS relative_path FROM source_files""",
    "parse_tags": f"""WITH t AS (SELECT file_id, list_filter(list_transform(string_split(coalesce(user_tags, ''), ','), lambda x: {q.strip("x")}), lambda x: x <> '') AS a FROM source_files)
        SELECT file_id, {q.as_text(q.ordered_set("a"))} AS tags, {q.as_text("a")} AS all_tags FROM t""",
    "latest_loads": "SELECT source_path, file_id, load_status FROM source_files WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY recorded_at DESC NULLS LAST, file_id DESC) = 1",
    "clean_markdown": f"""WITH t AS (SELECT doc_id, string_split(regexp_replace({q.newlines("text")}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, {q.strip(f"array_to_string(list_filter(lines, lambda x: NOT regexp_full_match({q.strip('x')}, 'Page [0-9]+')), chr(10))")} AS clean FROM t)
        SELECT doc_id, md5(clean) AS text_md5, length(clean) AS n_chars FROM c""",
    "source_type_infer": f"SELECT file_id, CASE WHEN lower(regexp_replace(file_extension, '^\\.', '')) IN ({q.listed(files.CODE_EXTENSIONS)}) THEN 'code' ELSE 'document' END AS source_type FROM source_files",
}
