"""Cutting texts into chunks: token windows, header sections, code boundaries, and the dispatch between them.

Every operator keeps the columns named as key and adds ``chunk_no, chunk_text, start_char, end_char``. Null and blank
texts give no chunk. Line ends must be line feeds (``functions.text.newlines``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import BLANKS, split_words
from textquarry.runtime import dealt

#: Words are estimated at so many tokens each.
TOKENS_PER_WORD = 1.3
#: Characters of pieces handed on at once.
BATCH_CHARS = 8 << 20

_BLANK = re.compile(f"[{BLANKS}]+")
# How headers, definitions and members begin.
_HEADER = re.compile(f"#{{1,6}}[{BLANKS}]+(.+)")
_DEFINES = ("def ", "class ", "function ", "const ", "var ", "let ")
_MEMBERS = ("public ", "private ", "protected ")


def _window_sizes(chunk_size: int, overlap: int) -> tuple[int, int]:
    width, lap = int(chunk_size / TOKENS_PER_WORD), int(overlap / TOKENS_PER_WORD)
    return width, max(width - lap, 1)


def _cut_texts(df: DataFrame, text: str, keys: list[str], columns: str, pieces: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """The keys with the pieces that a function makes of each text, in batches of bounded size; null and blank texts give none."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields] + [columns])
    names = [c.split()[0] for c in columns.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at: list[int] = []
            rows: list[tuple] = []
            held = 0

            def batch() -> pd.DataFrame:
                return pd.concat([pdf[keys].iloc[at].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

            for i, t in enumerate(pdf["_text"]):
                for row in pieces(t):
                    at.append(i)
                    rows.append(row)
                    held += len(row[1])
                    if held > BATCH_CHARS:
                        yield batch()
                        at, rows, held = [], [], 0
            yield batch()

    return dealt(df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))).mapInPandas(cut, schema)


def token_windows(df: DataFrame, text: str, keys: list[str], chunk_size: int = 512, overlap: int = 50) -> DataFrame:
    """Overlapping windows of words; offsets refer to the words joined by single blanks. Linear in the text, no shuffle."""
    width, step = _window_sizes(chunk_size, overlap)

    def pieces(t: str) -> Iterator[tuple]:
        words = [w for w in _BLANK.split(t) if w]
        start = 0
        for k, first in enumerate(range(0, max(len(words) - width + step, min(len(words), 1)), step) if width > 0 else ()):
            chunk = " ".join(words[first : first + width])
            yield k, chunk, start, start + len(chunk)
            start += sum(map(len, words[first : first + step])) + step

    return _cut_texts(df, text, keys, "chunk_no int, chunk_text string, start_char int, end_char int", pieces)


def header_sections(df: DataFrame, text: str, keys: list[str], min_section_chars: int = 50) -> DataFrame:
    """Sections under Markdown headers, with ``parent_section``. Short sections but the last are dropped.

    A text with at most one section left comes out whole, its section null. Linear in the text, no shuffle.
    """

    def pieces(t: str) -> list[tuple]:
        if not t.strip(BLANKS):
            return []
        found: list[tuple[int, str | None]] = [(0, None)]  # places and heads of the sections
        at = 0
        for line in t.split("\n"):
            if "#" in line and (m := _HEADER.match(line.strip(BLANKS))) and (head := m[1].strip(BLANKS)):
                if at == 0:
                    found.clear()
                found.append((at, head))
            at += len(line) + 1
        ends = [a - 1 for a, _ in found[1:]] + [len(t)]
        kept = [(t[a:b], a, b, head) for (a, head), b in zip(found, ends) if b == len(t) or len(t[a:b].replace("\n", " ").strip(BLANKS)) > min_section_chars]
        if len(kept) <= 1:
            kept = [(t, 0, len(t), None)]
        return [(k, *row) for k, row in enumerate(kept)]

    return _cut_texts(df, text, keys, "chunk_no int, chunk_text string, start_char int, end_char int, parent_section string", pieces)


def _is_boundary(line: str) -> bool:
    s = line.strip(BLANKS)
    return s.startswith(_DEFINES) or s.startswith(_MEMBERS) and ("function" in line or "class" in line or "def" in line)


def code_parts(df: DataFrame, text: str, keys: list[str], min_lines: int = 5) -> DataFrame:
    """Code split before definitions that follow more than ``min_lines`` lines, with the number of parts. Linear in the text, no shuffle.

    Texts without a split come out as one part.
    """

    def pieces(t: str) -> list[tuple]:
        if not t.strip(BLANKS):
            return []
        cuts, have, at = [0], 0, 0
        for line in t.split("\n"):
            if have > min_lines and _is_boundary(line):
                cuts.append(at)
                have = 0
            have += 1
            at += len(line) + 1
        ends = [c - 1 for c in cuts[1:]] + [len(t)]
        return [(k, t[a:b], a, b, len(cuts)) for k, (a, b) in enumerate(zip(cuts, ends))]

    return _cut_texts(df, text, keys, "chunk_no int, chunk_text string, start_char int, end_char int, n_parts int", pieces)


def code_chunks(df: DataFrame, text: str, keys: list[str], chunk_size: int = 512, overlap: int = 50) -> DataFrame:
    """Code parts; texts without a split and parts over the size as token windows, offsets shifted by the part."""
    parts = code_parts(df, text, keys)
    large = (F.col("n_parts") == 1) | (F.size(split_words(F.col("chunk_text"))) * TOKENS_PER_WORD > chunk_size)
    small = parts.where(~large).select(*keys, F.col("chunk_no").alias("_p"), F.lit(0).alias("_q"), "chunk_text", "start_char", "end_char")
    renamed = parts.where(large).select(*keys, F.col("chunk_no").alias("_p"), F.col("start_char").alias("_base"), F.col("chunk_text").alias("_t"))
    cut = token_windows(renamed, "_t", [*keys, "_p", "_base"], chunk_size, overlap)
    cut = cut.select(*keys, "_p", F.col("chunk_no").alias("_q"), "chunk_text", (F.col("_base") + F.col("start_char")).alias("start_char"), (F.col("_base") + F.col("end_char")).alias("end_char"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_p", "_q")) - 1
    return small.unionByName(cut).select(*keys, number.alias("chunk_no"), "chunk_text", "start_char", "end_char")


def chunker_of(kind: Column, extension: Column) -> Column:
    """The chunker of a file: ``language``, ``code`` or ``document``."""
    # Code extensions with separators of their own language.
    languages = "py js ts jsx tsx java cpp c cs go rs swift kt scala rb php".split()
    return F.when((kind == "code") & extension.isin(languages), "language").when(kind == "code", "code").otherwise("document")
