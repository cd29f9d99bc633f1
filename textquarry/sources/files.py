"""Reading files: crawl filters, routing, decoding, metadata of paths and tags.

All functions take and return DataFrames or columns; nulls in, nulls out, and no function drops columns of its input.
"""

from __future__ import annotations

import mimetypes
import os
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import glob_regex, matches_any, newlines, strip

# Extensions read as text.
TEXT_EXTENSIONS = (
    "txt md markdown rst tex py js ts jsx tsx java cpp c h hpp cs go rs swift kt scala rb php pl sh bash "
    "json yaml yml toml ini cfg xml html htm css scss sass sql r m mat"
).split()
# Extensions that make a chunk code.
CODE_EXTENSIONS = "py js ts jsx tsx java cpp c h hpp cs go rs swift kt scala rb php".split()
#: Directories from which a folder is walked in parallel, names handed on at once, bytes of content handed on at once.
WALKS, LISTED_ROWS, LOADED_BYTES = 200, 10_000, 32 << 20


def crawl_filter(files: DataFrame, path: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose relative path matches an include glob (if there is any) and no exclude glob."""
    c = F.col(path)
    kept = files.where(c.isNotNull())
    if include:
        kept = kept.where(matches_any(c, include))
    return kept.where(~matches_any(c, exclude)) if exclude else kept


def exclude_dirs(files: DataFrame, path: str, globs: list[str]) -> DataFrame:
    """Rows that lie below no directory, at any depth, whose name matches a glob."""
    parts = F.split(F.col(path), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return files.where(F.col(path).isNotNull() & ~F.exists(dirs, lambda d: d.rlike("|".join(map(glob_regex, globs))))) if globs else files


def extension_of(path: Column) -> Column:
    """The lower-case extension without its dot; empty for none, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"[^.].*?\.([^.]+)$|^[^.]+\.([^.]+)$", 1))


def stem_of(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]+$", "")


def route(extension: Column, mime: Column) -> Column:
    """Which loader reads a file: pdf, text, or skip."""
    ext = F.lower(F.coalesce(extension, F.lit("")))
    return F.when((ext == "pdf") | (F.coalesce(mime, F.lit("")) == "application/pdf"), "pdf").when(ext.isin(TEXT_EXTENSIONS) | F.coalesce(mime, F.lit("")).startswith("text/"), "text").otherwise("skip")


def mime_type(extension: Column) -> Column:
    """The registered media type of an extension without dot; null for none."""
    registered = mimetypes.MimeTypes().types_map[True]
    return F.create_map(*[F.lit(x) for e, t in sorted(registered.items()) for x in (e[1:], t)])[extension]


def parse_tags(tags: Column, distinct: bool = True) -> Column:
    """The trimmed non-empty parts of a comma list, in order; once each if distinct; none for null."""
    parts = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), strip), lambda t: t != "")
    return F.array_distinct(parts) if distinct else parts


def source_type(extension: Column) -> Column:
    """``code`` or ``document`` of an extension without dot; anything else, null too, is a document."""
    return F.when(extension.isin(CODE_EXTENSIONS), "code").otherwise("document")


def coerce_source_type(kind: Column) -> Column:
    """A stored type as one of the two known ones; legacy, misspelt and null types become documents."""
    return F.when(kind.isin("code", "document"), kind).otherwise("document")


def clean_markdown(text: Column) -> Column:
    """Without bare page lines and runs of blank lines, stripped."""
    folded = F.regexp_replace(text, r"\n{3,}", "\n\n")
    lines = F.filter(F.split(folded, "\n"), lambda line: ~F.trim(strip(line)).rlike(r"^Page \d+$"))
    return strip(F.array_join(lines, "\n"))


def _shown(path: bytes) -> str:
    """A path as text; bytes that aren't UTF-8 are escaped."""
    return path.decode("utf-8", "backslashreplace")


def _subdirectories(directory: bytes) -> list[bytes]:
    with os.scandir(directory) as entries:
        return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))


def _listed(root: bytes, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The regular files in each directory, and below it if it is ``deep``; linked files count, linked directories aren't entered."""
    columns = ["at", "full_path", "relative_path", "length"]
    rows: list[tuple] = []
    for pdf in batches:
        for directory, deep in zip(pdf["directory"], pdf["deep"]):
            todo = [bytes(directory)]
            while todo:
                here = todo.pop()
                if deep:
                    todo += _subdirectories(here)
                with os.scandir(here) as entries:
                    for e in entries:
                        if e.is_file():
                            rows.append((e.path, _shown(e.path), _shown(os.path.relpath(e.path, root)), e.stat().st_size))
                            if len(rows) == LISTED_ROWS:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
    yield pd.DataFrame(rows, columns=columns)


def _loaded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The listed files with their bytes, a bounded number of bytes at a time."""
    for pdf in batches:
        start, held, contents = 0, 0, []
        for n, path in enumerate(pdf["at"], 1):
            with open(bytes(path), "rb") as f:
                contents.append(f.read())
            held += len(contents[-1])
            if held >= LOADED_BYTES or n == len(pdf):
                yield pdf.iloc[start:n].assign(content=contents)
                start, held, contents = n, 0, []


def list_files(spark: SparkSession, base: str, include: list[str] | None = None, exclude: list[str] | None = None, exclude_directories: list[str] | None = None, max_file_size_mb: int | None = None) -> DataFrame:
    """The text files below a local (or everywhere mounted) folder, or the one file: ``at, full_path, relative_path, length``.

    Hidden and underscore names are listed like all others; Spark's own sources skip them. The driver looks for directories
    only, and for no more than are needed to spread the walk over tasks. Empty files, larger ones than the limit (if there
    is one), and those that are neither text nor attribute files, are left out.
    """
    root = os.fsencode(os.path.abspath(re.sub(r"^file:/*", "/", base)))
    schema = "at binary, full_path string, relative_path string, length long"
    if os.path.isfile(root):
        files = spark.createDataFrame([(root, _shown(root), _shown(os.path.basename(root)), os.path.getsize(root))], schema)
    else:
        done, todo = [], [root]
        while todo and len(todo) < WALKS:
            done, todo = done + todo, [d for t in todo for d in _subdirectories(t)]
        walks = spark.createDataFrame([(d, False) for d in done] + [(d, True) for d in todo], "directory binary, deep boolean")
        files = walks.repartition(2 * spark.sparkContext.defaultParallelism, "directory").mapInPandas(partial(_listed, root), schema)
    files = files.where(F.col("length") >= 1)
    files = files if max_file_size_mb is None else files.where(F.col("length") <= max_file_size_mb * (1 << 20))
    files = crawl_filter(exclude_dirs(files, "relative_path", exclude_directories or []), "relative_path", include, exclude)
    ext = extension_of(F.col("relative_path"))
    mime = F.when(F.substring_index("relative_path", "/", -1) == ".gitattributes", "text/plain").otherwise(mime_type(ext))
    return files.where(route(ext, mime) == "text")


def read_files(spark: SparkSession, base: str, include: list[str] | None = None, exclude: list[str] | None = None, exclude_directories: list[str] | None = None, max_file_size_mb: int = 10, tags: str = "") -> DataFrame:
    """Text files below a folder: ``relative_path, full_path, file_extension, filename_stem, mime_type, size_bytes, tags, text``.

    The files of ``list_files``, read in tasks; bytes that aren't UTF-8 are read as Latin-1. Larger files than the limit
    aren't read; ``list_files`` without a limit shows which they are.
    """
    listed = list_files(spark, base, include, exclude, exclude_directories, max_file_size_mb)
    # A fixed number of tasks: by the size of the names alone, adaptive execution would read all files in one.
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = listed.repartition(tasks, "full_path").mapInPandas(_loaded, "at binary, full_path string, relative_path string, length long, content binary")
    ext = extension_of(F.col("relative_path"))
    utf8 = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(
        "relative_path", "full_path", ext.alias("file_extension"), stem_of(F.col("relative_path")).alias("filename_stem"), mime_type(ext).alias("mime_type"), F.col("length").alias("size_bytes"), parse_tags(F.lit(tags)).alias("tags"), newlines(text).alias("text")
    )
